"""Cache keys and other stable text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_key(prompt: Column, motion: Column, allow_op: Column, lyric: Column, concept: Column, tone: Column) -> Column:
    """One key for single and batch matching, with the opening-scene flag."""
    flag = F.when(allow_op, "True").otherwise("False")
    text = F.concat(
        F.trim(prompt), F.lit(" | "), motion, F.lit(" | op="), flag, F.lit(" | lyric="), F.coalesce(lyric, F.lit("")),
        F.lit(" | concept="), F.coalesce(concept, F.lit("")), F.lit(" | tone="), F.coalesce(tone, F.lit("")),
    )
    return F.md5(text)


def texts_key(texts: Column) -> Column:
    """Key of a list of texts, run together."""
    return F.md5(F.array_join(texts, ""))


def media_key(path: Column, start: Column, duration: Column, volume: Column) -> Column:
    return F.md5(F.concat_ws("_", path, start.cast("string"), duration.cast("string"), volume.cast("string")))


def json_text(text: Column) -> Column:
    """A JSON string, non-ASCII kept."""
    return F.concat(F.lit('"'), _json_escape(text), F.lit('"'))


def json_text_list(texts: Column) -> Column:
    """A JSON list of strings with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(texts, json_text), ", "), F.lit("]"))


def _json_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def quoted_url(path: Column) -> Column:
    """Percent-quoted path with ``/`` kept."""
    out = F.url_encode(path)
    return F.replace(F.replace(F.replace(out, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def file_url(path: Column) -> Column:
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    rooted = F.when(F.substring(slashed, 2, 1) == ":", F.concat(F.lit("/"), slashed)).otherwise(slashed)
    return F.concat(F.lit("file://localhost"), quoted_url(rooted))


def xml_text(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
