"""Secret scans with built-in functions: fixed shapes, and a battery of randomness tests on other long tokens.

A token of the encodings' characters is given the smallest alphabet it fits. All three tests give evidence against writing, each in
standard errors from what writing has: chi-squared by the rate of equal pairs, as a multiple of the alphabet's (mean ``TEXT_RATE``), and by
how rare the letters are; runs by the changes between small letters, capitals and digits; serial correlation by pairs of neighbouring
letters that writing seldom has. From their sum comes the probability that writing looks so. Per class of length, tokens are taken as
secrets at a controlled rate of false discoveries (Benjamini and Hochberg), over all distinct tokens of the corpus. Chi-squared, runs and
serial correlation must not speak against chance either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.common import by_shuffle, only, plain_names, text_hash
from cuespan.session import work_table

# The shapes of secrets, which must match as they stand.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Tokens that the battery looks at.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Pieces of tokens that are tested as well, as a key may stand behind a path or a name.
PIECES = [r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9+]{20,}"]
KINDS = ["assign", "access", "hex", "random"]
#: Name, pattern, characters in the order of their values; the first that fits holds. Digits alone are writing.
ENCODINGS = [
    ("digits", "^[0-9/_+-]+$", ""),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex upper", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("small letters", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("capitals", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36 upper", "^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64 url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("all signs", "^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]
#: Tenths of nats that each letter from a to z tells in writing (mean of English, German, French and Spanish), and their mean and deviation there.
SURPRISES = [24, 41, 34, 31, 19, 43, 40, 35, 26, 56, 53, 31, 36, 26, 28, 39, 51, 27, 26, 27, 31, 45, 45, 62, 49, 53]
SURPRISE, SURPRISE_DEVIATION = 28.7, 7.4
#: The 180 commonest pairs of letters (counted on English documentation of Python and the invented four-language texts of sf0.01), and the share of pairs in writing that are others, at most.
PAIRS = (
    "aa ab ac ad ae ai al am an ap ar as at au be bl bo ca ce ch ci ck cl co ct da de di do ea eb ec ed ee ef ei el em en eo ep eq er es et "
    "eu ev ex ez fa fi fo ga ge ha he hh hi ho hs ht ia ic ie if ig il im in io ip ir is it ja ke la le lf li ll lo ls ly ma me mi mo mp na "
    "nb nc nd ne ng nh ni nl nn no nr ns nt nu oa oc od of oi ol om on oo op or os ot ou pa pe pf pi pl po pr pt qu ra rb rc re rg ri rm rn "
    "ro rr rs rt ru sa sc se sh si sm so sr ss st su ta te th ti to tr ts tt tu ty tz ua ue ui ul un uo up ur us ut ux va ve vi wh wi xt zu"
)
ODD_PAIRS = 0.25
#: Changes of kind (a capital after a small letter, a letter beside a digit) per neighbouring characters in writing, at most.
CHANGE = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
CHANGES = 0.15
#: Standard deviation of the sum of the four standard scores in writing, where they go together by 0.35 on average.
SUM_DEVIATION = 2.86
#: Equal pairs in writing, as a multiple of those of even letters.
TEXT_RATE = 1.7
#: Matches that are added up at a time.
PART = 256
#: Standard errors beyond which runs, serial correlation or chi-squared speak against chance.
LIMIT = 3.3


def spans(text: Column, pattern: str, kind: int, value_group: int | None = None, least: int = 0) -> Column:
    """(start, kind, end) of the leftmost non-overlapping matches, in code points; ``value_group`` must have ``least`` characters.

    The pieces between matches and the matches, in turn, add up to the places.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), lambda x: F.length(x)) if value_group else found
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + x["gap"]
        last = first + x["found"]
        one = F.array(F.struct(first.alias("start"), F.lit(kind).alias("kind"), last.alias("end")))
        return F.struct(last.alias("at"), F.when(x["value"] >= least, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    def part(state: Column, number: Column, matches: Column) -> Column:
        return F.aggregate(
            F.slice(matches, number * PART + 1, F.lit(PART)), F.struct(state["at"].alias("at"), none.alias("out")), step,
            lambda inner: F.struct(inner["at"].alias("at"), F.concat(state["out"], inner["out"]).alias("out")),
        )

    def placed(matches: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.size(matches) / PART).cast("int"))
        return F.aggregate(numbers, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, n: part(s, n, matches), lambda s: s["out"])

    matches = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found"), values.alias("value")), lambda x: x["found"].isNotNull())
    # The list of matches is bound once; it is added up part by part, as lists grow by copying.
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(matches), placed), F.lit(0))).otherwise(none)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, ``base`` (spans of the fixed shapes) and ``tokens`` (start, end, token) for the battery; null texts as empty."""
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    rows = rows.select(
        "doc_id", text_hash(text).alias("text_key"), "text", spans(text, ASSIGN, 0, 2, 12).alias("assign"), spans(text, ACCESS, 1).alias("access"),
        spans(text, HEX, 2).alias("hex"), spans(text, TOKEN, 3).alias("token"),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    pieces = F.array_distinct(F.concat("token", *(spans(text, pattern, 3) for pattern in PIECES)))
    rows = rows.select("doc_id", "text_key", "text", base.alias("base"), F.when(F.size("token") > 0, pieces).otherwise(F.col("token")).alias("token"))
    apart = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    tokens = F.transform(apart, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.substring(F.col("text"), t["start"] + 1, t["end"] - t["start"]).alias("token")))
    return rows.select("doc_id", "text_key", "base", tokens.alias("tokens"))


def normal_tail(z: Column) -> Column:
    """P(Z <= z) for the standard normal, to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z < 0, upper).otherwise(1 - upper)


def battery(tokens: DataFrame) -> DataFrame:
    """Distinct tokens (column ``token``) with alphabet size ``k``, length ``n``, ``rate``, ``p_text`` and the standard errors of the three tests."""
    alphabet = F.coalesce(*(F.when(F.col("token").rlike(p), F.lit(chars)) for _, p, chars in ENCODINGS), F.lit(""))
    rows = tokens.withColumn("alphabet", alphabet).where(F.col("alphabet") != "")
    rows = rows.withColumn("codes", F.expr("transform(filter(split(token, ''), c -> c <> ''), c -> instr(alphabet, c) - 1)"))
    rows = rows.withColumn("n", F.size("codes").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    rows = rows.withColumn("pairs", F.expr("aggregate(array_distinct(codes), 0D, (s, c) -> s + size(filter(codes, x -> x = c)) * (size(filter(codes, x -> x = c)) - 1D))"))
    rows = rows.withColumn("rate", F.expr("k * pairs / (n * (n - 1))"))
    rows = rows.withColumn("w_pairs", F.expr(f"({TEXT_RATE} - rate) / sqrt(2 * {TEXT_RATE} * (k - 1) / (n * (n - 1)))"))
    rows = rows.withColumn("low", F.lower("token")).withColumn("bare", F.regexp_replace("token", "[^A-Za-z0-9]", ""))
    told = F.transform(F.split(F.regexp_replace("low", "[^a-z]", ""), ""), lambda c: F.get(F.array(*map(F.lit, SURPRISES)), F.ascii(c) - 97))
    rows = rows.withColumn("told", F.filter(told, lambda x: x.isNotNull()))
    rows = rows.withColumn("w_letters", F.expr(f"IF(size(told) = 0, 0D, (aggregate(told, 0, (s, x) -> s + x) - {SURPRISE} * size(told)) / ({SURPRISE_DEVIATION} * sqrt(size(told))))"))
    spread = f"sqrt(greatest(1, length(bare) - 1) * {CHANGES * (1 - CHANGES)})"
    rows = rows.withColumn("changes", F.regexp_count("bare", F.lit(CHANGE)))
    rows = rows.withColumn("w_changes", F.expr(f"(changes - (length(bare) - 1) * {CHANGES}) / {spread}"))
    neighbours = F.transform(F.sequence(F.lit(1), F.length("low") - 1), lambda i: F.substring(F.col("low"), i, F.lit(2)))
    rows = rows.withColumn("couples", F.filter(neighbours, lambda x: x.rlike("^[a-z]{2}$")))
    rows = rows.withColumn("odd", F.size(F.filter("couples", lambda x: F.instr(F.lit(PAIRS), x) == 0)))
    rows = rows.withColumn("w_couples", F.expr(f"(odd - size(couples) * {ODD_PAIRS}) / sqrt(greatest(1, size(couples)) * {ODD_PAIRS * (1 - ODD_PAIRS)})"))
    rows = rows.withColumn("p_text", normal_tail(F.expr(f"-(w_pairs + w_letters + w_changes + w_couples) / {SUM_DEVIATION}")))
    # Chi-squared is k / n * sum of squared counts - n, with k - 1 degrees of freedom: Wilson and Hilferty's cube root makes it normal.
    rows = rows.withColumn("chi", F.expr("k * (pairs + n) / n - n"))
    rows = rows.withColumn("z_chi", F.expr("(pow(chi / (k - 1), 1D / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1)))"))
    # Runs of values in the upper and lower half of the alphabet.
    rows = rows.withColumn("upper", F.expr("transform(codes, c -> c * 2 >= k)")).withColumn("n1", F.expr("CAST(size(filter(upper, u -> u)) AS DOUBLE)"))
    rows = rows.withColumn("runs", F.expr("1D + size(filter(upper, (u, i) -> i > 0 AND u <> get(upper, i - 1)))")).withColumn("n0", F.expr("n - n1"))
    rows = rows.withColumn("mean_runs", F.expr("1 + 2 * n0 * n1 / n"))
    rows = rows.withColumn("z_runs", F.expr("IF(n0 * n1 = 0, 99D, (runs - mean_runs) / sqrt(greatest(1e-9, (mean_runs - 1) * (mean_runs - 2) / (n - 1))))"))
    rows = rows.withColumn("mean", F.expr("aggregate(codes, 0D, (s, c) -> s + c) / n"))
    rows = rows.withColumn("var", F.expr("aggregate(codes, 0D, (s, c) -> s + pow(c - mean, 2))"))
    rows = rows.withColumn("lagged", F.expr("aggregate(transform(codes, (c, i) -> IF(i = 0, 0D, (c - mean) * (get(codes, i - 1) - mean))), 0D, (s, x) -> s + x)"))
    rows = rows.withColumn("z_serial", F.expr("IF(var = 0, 99D, lagged / var * sqrt(n))"))
    return rows.select("token", "k", "n", "rate", "p_text", "z_chi", "z_runs", "z_serial")


def discoveries(tokens: DataFrame, rate: float = 0.05) -> DataFrame:
    """The distinct tokens taken as secrets at a false discovery rate of ``rate`` within each class of length (under 32, under 64, longer)."""
    tested = battery(tokens.select("token").distinct())
    tested = tested.withColumn("class", F.when(F.col("n") < 32, 0).when(F.col("n") < 64, 1).otherwise(2))
    tested = work_table(tested.withColumn("step", F.least(F.lit(400), F.floor(-10 * F.log10(F.greatest(F.col("p_text"), F.lit(1e-40))))).cast("int")))
    # Probabilities in steps of a tenth of a power of ten, each counted at its upper end: at most 401 rows a class.
    steps = tested.groupBy("class", "step").agg(F.count(F.lit(1)).alias("count"))
    smaller = Window.partitionBy("class").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("below", F.sum("count").over(smaller)).withColumn("all", F.sum("count").over(Window.partitionBy("class")))
    cuts = steps.where(F.pow(F.lit(10.0), -F.col("step") / 10) <= rate * F.col("below") / F.col("all")).groupBy("class").agg(F.min("step").alias("cut"))
    passed = tested.join(F.broadcast(cuts), "class").where(F.col("step") >= F.col("cut"))
    return passed.where((F.col("z_chi") <= LIMIT) & (F.abs("z_runs") <= LIMIT) & (F.abs("z_serial") <= LIMIT)).select("token")


def secret_spans(docs: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, found): doc_id, text_key, base spans of all documents; and text_key, ``random`` (the battery's spans, if any) of each text that has some.

    A span is (start, kind, end) with kind 0 to 3 as in ``KINDS``; spans of the battery that a base span holds are left out.
    Null and empty texts have no spans; equal texts are tested once; an empty table gives no rows.
    """
    rows = work_table(scan(docs, id_col, text_col))
    near = rows.where(F.size("tokens") > 0).select("text_key", "tokens").dropDuplicates(["text_key"]).select("text_key", F.explode("tokens").alias("t")).select("text_key", "t.*")
    near = work_table(near)
    secret = work_table(discoveries(near, rate))
    span = F.struct("start", F.lit(3).alias("kind"), "end")
    found = near.join(secret, "token").groupBy("text_key").agg(F.array_sort(F.collect_set(span)).alias("random"))
    # Of pieces and wholes the largest stand: what an earlier span holds, or one of the same start, is left out.
    def largest(state: Column, s: Column) -> Column:
        last = F.element_at(state, -1)
        return (
            F.when((F.size(state) > 0) & (s["end"] <= last["end"]), state)
            .when((F.size(state) > 0) & (s["start"] == last["start"]), F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(s))).otherwise(F.concat(state, F.array(s)))
        )

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = found.withColumn("random", F.aggregate("random", none, largest))
    return rows.select("doc_id", "text_key", "base"), found


def joined(spans_of: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans_of, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, **options: object) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (``secret_spans`` has the rules)."""
    rows, found = secret_spans(docs, **options)
    out = rows.join(work_table(found), "text_key", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def count(kind: int) -> Column:
        # A function of one argument: Spark would give a second one the place in the list.
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(kind) for kind in range(3)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", F.coalesce("random", none)))).alias("spans"))


def without_secrets(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` with ``mark`` in place of every span, overlapping ones together; texts without one, null included, stay as they are."""
    rows, found = secret_spans(docs, text_col=text_col, **options)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    base = rows.where(F.size("base") > 0).select("text_key", "base").dropDuplicates(["text_key"])
    every = base.join(found, "text_key", "full").select(F.col("text_key").alias("_text_key"), F.array_sort(F.concat(F.coalesce("base", none), F.coalesce("random", none))).alias("_spans"))
    plain, name = plain_names(docs, text_col)
    text = F.col(name)
    out = plain.join(by_shuffle(work_table(every)), text_hash(text) == F.col("_text_key"), "left")

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_spans", start, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))
    return out.withColumn(name, F.when(F.col("_spans").isNull(), text).otherwise(clean)).select(*plain.columns).toDF(*docs.columns)
