"""Lyric corpora to timed lines. docs: (doc_id, text, duration_ms); lines: (doc_id, line_no, start_ms, end_ms, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions.text import is_credit_text, lines_of, strip
from cuespan.functions.timecode import idiv

TAG = r"\[(\d{2}):(\d{2})[.:](\d{2,3})?\]"
# What marks pasted text as timed lyrics.
TIMED_MARKS = ("[00:", "[01:")


def _tag_ms(tag: Column) -> Column:
    part = lambda i: F.regexp_extract(tag, TAG, i)
    digits = part(3)
    fraction = (
        F.when(F.length(digits) == 3, digits.cast("bigint"))
        .when(F.length(digits) == 2, digits.cast("bigint") * 10)
        .otherwise(F.lit(0).cast("bigint"))
    )
    return part(1).cast("bigint") * 60_000 + part(2).cast("bigint") * 1000 + fraction


def ingest_lyrics_lrc(docs: DataFrame) -> DataFrame:
    """One row per time tag. Credit lines go first; a line ends at the next start, the last at the song's end."""

    def tagged(line: Column, pos: Column) -> Column:
        return F.struct(
            pos.alias("pos"), F.regexp_extract_all(line, F.lit(f"({TAG})"), F.lit(1)).alias("tags"),
            strip(F.regexp_replace(line, TAG, "")).alias("text"),
        )

    def timed(row: Column) -> Column:
        return F.transform(row.tags, lambda tag, i: F.struct(
            _tag_ms(tag).alias("start_ms"), row.pos.alias("pos"), i.alias("tag_no"), row.text.alias("text")))

    sung = F.filter(
        F.transform(lines_of(F.col("text")), tagged), lambda row: (F.size(row.tags) > 0) & ~is_credit_text(row.text)
    )
    rows = docs.select("doc_id", "duration_ms", F.array_sort(F.flatten(F.transform(sung, timed))).alias("lines"))
    ended = F.transform("lines", lambda c, i: F.struct(
        i.cast("bigint").alias("line_no"), c.start_ms.alias("start_ms"),
        F.coalesce(F.get(F.col("lines"), i + 1).start_ms, F.col("duration_ms")).alias("end_ms"), c.text.alias("text"),
    ))
    return rows.select("doc_id", F.inline(ended))


def ingest_lyrics_txt(docs: DataFrame) -> DataFrame:
    """Plain lines spread evenly over the song, on the 10 ms grid."""
    lines = F.filter(F.transform(lines_of(F.col("text")), strip), lambda s: ~is_credit_text(s))
    rows = docs.select("doc_id", "duration_ms", lines.alias("lines")).select("*", F.size("lines").cast("bigint").alias("n"))
    edge = lambda i: idiv(i * F.col("duration_ms") + 5 * F.col("n"), 10 * F.col("n")) * 10
    spread = rows.select("doc_id", "duration_ms", "n", F.posexplode("lines").alias("line_no", "text"))
    i = F.col("line_no").cast("bigint")
    return spread.select("doc_id", i.alias("line_no"), edge(i).alias("start_ms"), edge(i + 1).alias("end_ms"), "text")


def route_lyrics(docs: DataFrame, preparsed: DataFrame | None = None) -> DataFrame:
    """Timed or plain reading per document; rows parsed before win.

    A named file goes by its extension, pasted text (no ``file_name``) by its content.
    """
    if preparsed is not None:
        docs = docs.join(preparsed.select("doc_id").distinct(), "doc_id", "left_anti")
    marked = F.lit(False)
    for mark in TIMED_MARKS:
        marked = marked | F.col("text").contains(mark)
    timed = F.when(F.col("file_name").isNotNull(), F.lower("file_name").endswith(".lrc")).otherwise(marked)
    out = ingest_lyrics_lrc(docs.filter(timed)).unionByName(ingest_lyrics_txt(docs.filter(~timed)))
    return out if preparsed is None else out.unionByName(preparsed)
