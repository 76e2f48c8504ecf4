"""Subtitle and lyric documents rendered from the whole text of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.plans.fixtures import table

STEP_MS = 2350


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _start(i: Column) -> Column:
    return i.cast("bigint") * STEP_MS + 1200


def _hms(t: Column, mark: str, digits: int) -> Column:
    fraction = t % 1000 if digits == 3 else _div(t % 1000, 10)
    return F.format_string(f"%02d:%02d:%02d{mark}%0{digits}d", _div(t, 3_600_000), _div(t % 3_600_000, 60_000), _div(t % 60_000, 1000), fraction)


def _ms(t: Column) -> Column:
    return F.format_string("%02d:%02d.%02d", _div(t, 60_000), _div(t % 60_000, 1000), _div(t % 1000, 10))


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "text").select("doc_id", "lang", F.split("text", "\n").alias("lines"))


def srt_docs(spark, d) -> DataFrame:
    """Numbered blocks; some without times, some repeated, and some with a time that cannot be read."""

    def block(line: Column, i: Column) -> Column:
        t, n = _start(i), F.length(line)
        arrow = F.when(n % 7 == 0, " to ").otherwise(" --> ")
        begin = F.when(n % 97 == 0, "0x:00:01,000").otherwise(_hms(t, ",", 3))
        one = F.concat((i + 1).cast("string"), F.lit("\n"), begin, arrow, _hms(t + 1900, ",", 3), F.lit("\n"), line)
        return F.when(line.startswith("T"), F.concat(one, F.lit("\r\n\r\n"), one)).otherwise(one)

    return _lines(spark, d).select("doc_id", F.array_join(F.transform("lines", block), "\r\n\r\n").alias("text"))


def ass_docs(spark, d) -> DataFrame:
    """Dialogue lines with style tags and break marks; every second line is a layered pair."""

    def row(line: Column, i: Column) -> Column:
        t, n = _start(i), F.length(line)
        begin = F.when(n % 13 == 0, "0:0x:00.00").otherwise(_hms(t, ".", 2))
        text = F.concat(F.lit("{\\pos(1,2)}"), F.replace(line, F.lit(". "), F.lit("\\N")))
        one = F.concat(F.lit("Dialogue: 0,"), begin, F.lit(","), _hms(t + 1900, ".", 2), F.lit(",Default,,0,0,0,,"), text)
        return F.when(i % 2 == 0, F.concat(one, F.lit("\n"), one)).otherwise(F.concat(one, F.lit("\nComment: 0,x")))

    return _lines(spark, d).select("doc_id", F.concat(F.lit("[Events]\n"), F.array_join(F.transform("lines", row), "\n")).alias("text"))


def lrc_docs(spark, d) -> DataFrame:
    """Timed lines; some blank, some credits, some with two times, one header line."""

    def row(line: Column, i: Column) -> Column:
        t, n = _start(i), F.length(line)
        tag = F.concat(F.lit("["), _ms(t), F.lit("]"))
        second = F.concat(F.lit("["), _ms(t + 60_000), F.lit("]"))
        return (
            F.when(n % 5 == 0, tag)
            .when(n % 5 == 1, F.concat(tag, F.lit("Written by: "), line))
            .when(n % 5 == 2, F.concat(tag, second, F.lit(" "), line))
            .otherwise(F.concat(tag, line))
        )

    return _lines(spark, d).select(
        "doc_id", F.concat(F.lit("[ar:someone]\n"), F.array_join(F.transform("lines", row), "\n")).alias("text"),
        (F.size("lines").cast("bigint") * STEP_MS + 90_000).alias("duration_ms"),
    )


def txt_docs(spark, d) -> DataFrame:
    """The plain text with a credit line on top."""
    return _lines(spark, d).select(
        "doc_id", F.concat(F.lit("Composed by A/B\n"), F.array_join("lines", "\n")).alias("text"),
        (F.size("lines").cast("bigint") * STEP_MS + 90_001).alias("duration_ms"),
    )


def lyric_docs(spark, d) -> DataFrame:
    """English documents as timed lyrics, the others plain; French ones as named files."""
    lang = _lines(spark, d).select("doc_id", "lang")
    timed = lrc_docs(spark, d).join(lang.filter("lang IN ('en', 'es')"), "doc_id")
    plain = txt_docs(spark, d).join(lang.filter("lang NOT IN ('en', 'es')"), "doc_id")
    both = timed.unionByName(plain)
    name = F.when(F.col("lang") == "fr", "song.txt").when(F.col("lang") == "es", "song.LRC")
    return both.select("doc_id", name.alias("file_name"), "text", "duration_ms")
