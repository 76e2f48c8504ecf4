"""Quality rules with built-in functions: counts within a text, and how often lines recur across a host's documents.

A line that more than ``most`` distinct documents of a host hold is boilerplate there and is taken away; a document that
loses more than ``share`` of its words that way is depleted. Documents of one host with the same text are one document,
so a text does not become boilerplate by being copied whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.llm.common import SPACE_CLASS, SPACES, by_shuffle, named, plain_names, text_hash
from cuespan.session import work_table

# The symbols that count, and what a line with a word has.
SYMBOLS = "[#*$%&|<>]"
WORD_CHARACTER = "[^\\x20\\x09-\\x0D]"


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))


def repeated_words(windows: Column, last: int = 3) -> Column:
    """Words in windows found more than once, from ``windows``: (hash, place) of each window of ``last`` words, sorted.

    Places of recurring windows in order; each covers ``last`` words, less what the next one covers as well.
    """
    recurring = F.filter(windows, lambda w, i: (w["h"] == F.get(windows, i - 1)["h"]) | (w["h"] == F.get(windows, i + 1)["h"]))
    return F.sort_array(F.transform(recurring, lambda w: w["at"]))


def normal_line(line: Column) -> Column:
    """Lower case, single spaces at word gaps."""
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACES)), SPACE_CLASS, " "))


def text_rules(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per row: doc_id, host, text_key, the counts of the text, and ``lines``: (hash, words) of each distinct normalised line.

    A line is normalised by lower case and single spaces at word gaps; lines without a word do not count.
    """
    text = F.coalesce(named(text_col), F.lit(""))
    rows = docs.select(named(id_col).alias("doc_id"), named(host_col).cast("string").alias("host"), text.alias("text"))
    rows = rows.withColumn("text_key", text_hash(F.col("text"))).withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("filled", F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD_CHARACTER)))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    hashes = F.transform(
        F.slice("words", 3, F.greatest(F.lit(0), F.size("words") - 2)), lambda w, i: F.xxhash64(F.get(F.col("words"), i), F.get(F.col("words"), i + 1), w)
    )
    rows = rows.withColumn("hashes", hashes)
    # Most texts have no recurring window: only the others are sorted.
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    rows = rows.withColumn("windows", F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), none).otherwise(placed))
    rows = rows.withColumn("places", repeated_words(F.col("windows")))
    covered = F.aggregate(
        F.transform("places", lambda at, i: F.least(F.lit(3), F.coalesce(F.get(F.col("places"), i + 1) - at, F.lit(3)))), F.lit(0), lambda total, n: total + n
    )
    lines = F.transform("filled", normal_line)
    normal = F.transform(lines, lambda line: F.struct(F.xxhash64(line).alias("hash"), F.size(F.split(line, " ")).alias("words")))
    return rows.select(
        "doc_id", "host", "text_key", "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), normal.alias("lines"),
    )


def judged(docs: DataFrame, most: int, share: float, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, DataFrame]:
    """(report, common): the rows of ``quality_report``; and host, text_key and hash of each boilerplate line of each distinct text."""
    rows = work_table(text_rules(docs, id_col, text_col, host_col).withColumn("host", F.coalesce("host", F.lit(""))))
    lines = rows.select("host", "text_key", F.explode("lines").alias("line"))
    lines = lines.groupBy("host", "text_key", F.col("line.hash").alias("hash")).agg(F.max("line.words").alias("words"), F.count(F.lit(1)).alias("times"))
    # Copies have been added up: a line stands `times` over the number of copies in each of them.
    copies = rows.where(F.size("lines") > 0).groupBy("host", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    lines = work_table(lines)
    common = lines.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("host", "hash")
    common = work_table(lines.join(work_table(common), ["host", "hash"], "left_semi"))
    removed = common.groupBy("host", "text_key").agg(F.sum(F.col("words") * F.col("times")).alias("all_words"))
    removed = work_table(removed.join(copies, ["host", "text_key"]).select("host", "text_key", F.expr("all_words div copies").alias("n_removed")))
    out = rows.drop("lines").join(removed, ["host", "text_key"], "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_removed") > F.col("n_words") * share
    report = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        "n_removed", "host", "text_key",
    )
    return report, common.select("host", "text_key", "hash")


def quality_report(
    docs: DataFrame, most: int = 100, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed, and its keys host and text_key.

    ``base_failed``: fewer than 50 words, or more than half of the words in recurring windows of three. ``kept``: not that, and not
    depleted. Null text counts as empty (and fails); documents of null hosts share one host. An empty table gives no rows.
    """
    return judged(docs, most, share, id_col, text_col, host_col)[0]


def kept_documents(
    docs: DataFrame, most: int = 100, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """``docs`` without the rejected documents, and without boilerplate lines in the others; both depend on host and text only.

    A text without boilerplate stays as it is; lines are those between line feeds, and lines without a word are never boilerplate.
    """
    report, common = judged(docs, most, share, id_col, text_col, host_col)
    rejected = report.where(~F.col("kept")).select("host", "text_key").distinct().withColumn("_rejected", F.lit(True))
    # A text's list holds no more than its own lines; that of a rejected text is not needed.
    lists = common.join(by_shuffle(rejected), ["host", "text_key"], "left_anti").groupBy("host", "text_key").agg(F.collect_list("hash").alias("_common"))
    changes = rejected.withColumn("_common", F.lit(None).cast("array<bigint>")).unionByName(lists.withColumn("_rejected", F.lit(False)))
    changes = work_table(changes.withColumnsRenamed({"host": "_host", "text_key": "_text_key"}))
    plain, text, host = plain_names(docs, text_col, host_col)
    same = (F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col("_host")) & (text_hash(F.col(text)) == F.col("_text_key"))
    out = plain.join(by_shuffle(changes), same, "left").where(F.col("_rejected").isNull() | ~F.col("_rejected"))
    gone = lambda line: line.rlike(WORD_CHARACTER) & F.array_contains(F.col("_common"), F.xxhash64(normal_line(line)))
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~gone(line)), "\n")
    kept = F.when(F.col("_common").isNull(), F.col(text)).otherwise(rest).alias(text)
    return out.select(*(kept if c == text else c for c in plain.columns)).toDF(*docs.columns)
