"""Subtitle corpora to cue tables.

Each document is one row; everything up to the duplicate check happens inside the row,
so a corpus is read without a shuffle. docs: (doc_id, text); cues: (doc_id, pos,
start_ms, end_ms, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions.text import strip
from cuespan.functions.timecode import idiv
from cuespan.session import work_table
from cuespan.sources.decode import decode_corpus, read_raw

# How long the last timed line lasts, and how close two equal cues may start.
LAST_LINE_MS = 4000
SAME_START_MS = 100

CLOCK = r"^(\d+):(\d+):(\d+(?:\.\d*)?)(?::.*)?$"
TIMED_LINE = r"^\[(\d+):(\d+(?:\.\d+)?)\]([^\n]*)"


def read_documents(spark, path: str, glob: str = "*") -> DataFrame:
    """One row per file, whole text."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob)
    return files.load(path).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def _newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _clock(text: Column) -> Column:
    """``h:m:s.f`` to ms, null when it does not read as one."""
    thousandths = lambda p: F.round(F.get(p, F.lit(2)).cast("double") * 1000).cast("bigint")
    total = lambda p: F.get(p, F.lit(0)).cast("bigint") * 3_600_000 + F.get(p, F.lit(1)).cast("bigint") * 60_000 + thousandths(p)
    return _once(text, lambda t: F.when(t.rlike(CLOCK), _once(F.split(t, ":"), total)))


def drop_repeats(cues: DataFrame, key: str = "doc_id", *, same_ms: int = SAME_START_MS) -> DataFrame:
    """Of cues with equal text that start in the same tenth of a second, the first in file order stays."""
    tenth = idiv(F.col("start_ms") + same_ms // 2, same_ms)
    rest = [c for c in cues.columns if c not in (key, "text")]
    first = cues.groupBy(key, tenth.alias("_tenth"), "text").agg(F.min_by(F.struct(*rest), F.col("pos")).alias("_first"))
    return first.select(key, "_first.*", "text").select(*cues.columns)


def ingest_srt(docs: DataFrame) -> DataFrame:
    """Numbered blocks. A block whose times cannot be read ends its document."""
    blocks = F.transform(F.split(strip(_newlines(F.col("text"))), "\n\n"), lambda b: F.split(strip(b), "\n"))
    rows = docs.select("doc_id", F.filter(blocks, lambda b: (F.size(b) >= 3) & F.get(b, F.lit(1)).contains("-->")).alias("blocks"))

    def cue(b: Column) -> Column:
        times = F.split(F.replace(F.get(b, F.lit(1)), F.lit(","), F.lit(".")), "-->")
        return F.struct(
            _clock(strip(F.get(times, F.lit(0)))).alias("start_ms"), _clock(strip(F.get(times, F.lit(1)))).alias("end_ms"),
            strip(F.array_join(F.slice(b, 3, F.greatest(F.size(b), F.lit(3))), " ")).alias("text"),
        )

    cues = rows.select("doc_id", F.transform("blocks", cue).alias("cues"))
    unread = F.array_position(F.transform("cues", lambda c: c.start_ms.isNull() | c.end_ms.isNull()), True)
    kept = F.when(unread > 0, F.slice("cues", 1, (unread - 1).cast("int"))).otherwise(F.col("cues"))
    flat = cues.select("doc_id", F.posexplode(kept).alias("pos", "cue")).select("doc_id", "pos", "cue.*")
    return drop_repeats(flat)


def ingest_ass(docs: DataFrame) -> DataFrame:
    """``Dialogue:`` lines; style tags and line-break marks go, unreadable times are skipped.

    Each step over the lines is its own array stage, so nothing is read twice.
    """
    lines = F.transform(F.split(_newlines(F.col("text")), "\n"), lambda s, i: F.struct(
        i.alias("pos"), F.split(strip(s), ",", 10).alias("f")))
    spoken = F.filter(lines, lambda r: (F.size(r.f) >= 10) & F.get(r.f, F.lit(0)).startswith("Dialogue:"))

    def cue(r: Column) -> Column:
        plain = F.regexp_replace(strip(F.get(r.f, F.lit(9))), r"\{[^\n]*?\}", "")
        return F.struct(
            r.pos.alias("pos"), _clock(strip(F.get(r.f, F.lit(1)))).alias("start_ms"),
            _clock(strip(F.get(r.f, F.lit(2)))).alias("end_ms"), strip(F.regexp_replace(plain, r"\\[Nnh]", " ")).alias("text"),
        )

    cues = docs.select("doc_id", F.inline(F.transform(spoken, cue)))
    return drop_repeats(cues.filter((F.col("text") != "") & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()))


def ingest_lrc_cues(docs: DataFrame) -> DataFrame:
    """Lines with one leading time. A line ends where the next one starts, blank ones included."""
    lines = F.filter(F.transform(F.split(_newlines(F.col("text")), "\n"), strip), lambda s: s.rlike(TIMED_LINE))

    def timed(line: Column, pos: Column) -> Column:
        seconds = F.round(F.regexp_extract(line, TIMED_LINE, 2).cast("double") * 1000).cast("bigint")
        return F.struct(
            (F.regexp_extract(line, TIMED_LINE, 1).cast("bigint") * 60_000 + seconds).alias("start_ms"),
            pos.alias("pos"), strip(F.regexp_extract(line, TIMED_LINE, 3)).alias("text"),
        )

    rows = docs.select("doc_id", F.array_sort(F.transform(lines, timed)).alias("cues"))
    ended = F.transform("cues", lambda c, i: F.struct(
        c.start_ms.alias("start_ms"), i.alias("pos"), c.text.alias("text"),
        F.coalesce(F.get(F.col("cues"), i + 1).start_ms, c.start_ms + LAST_LINE_MS).alias("end_ms"),
    ))
    flat = rows.select("doc_id", F.explode(ended).alias("c")).select("doc_id", "c.pos", "c.start_ms", "c.end_ms", "c.text")
    return drop_repeats(flat.filter(F.col("text") != ""))




def subtitle_files(spark, folder: str) -> Callable[[str], DataFrame]:
    """(path, content) of the files of one suffix in ``folder``; files of other suffixes are not read."""

    def of(suffix: str) -> DataFrame:
        glob = "*." + "".join(f"[{c}{c.upper()}]" for c in suffix)
        path = F.regexp_replace("doc_id", "^file:/+", "/")
        return read_raw(spark, folder, glob).select(path.alias("path"), "content")

    return of


def ingest_resolved(resolved: DataFrame, contents: Callable[[str], DataFrame]) -> DataFrame:
    """Cues of every video from the file that was resolved for it: (video_id, pos, start_ms, end_ms, text).

    ``resolved``: (video_id, subtitle_path); ``contents(suffix)``: (path, content) of ``ass``, ``srt`` or ``lrc`` files. A file is
    decoded and parsed once, however many videos use it, by the parser of its suffix; one whose suffix is ``ASS`` in capitals has none.
    """
    # One short row per video, asked for once per suffix and once at the end.
    used = work_table(resolved.where(F.col("subtitle_path").isNotNull()).select("video_id", F.col("subtitle_path").alias("doc_id")))
    wanted = used.select(F.col("doc_id").alias("path")).distinct()

    def documents(suffix: str, here: Column) -> DataFrame:
        raw = contents(suffix).where(here).join(wanted.where(here), "path")
        return decode_corpus(raw.select(F.col("path").alias("doc_id"), "content"))

    path, low = F.col("path"), F.lower("path")
    cues = ingest_ass(documents("ass", path.endswith(".ass")))
    cues = cues.unionByName(ingest_srt(documents("srt", low.endswith(".srt")))).unionByName(ingest_lrc_cues(documents("lrc", low.endswith(".lrc"))))
    return used.join(cues, "doc_id").select("video_id", "pos", "start_ms", "end_ms", "text")
