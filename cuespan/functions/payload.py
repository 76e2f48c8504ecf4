"""Model replies: fenced JSON to columns, with the defaults for what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNOTATION_SCHEMA = (
    "summary string, tags array<string>, visual_style string, motion_intensity string, "
    "key_objects array<string>, emotion_flow string, mad_score string, scene_type string"
)

# What a missing key means, and what stands in for a reply that cannot be read.
REPLY_DEFAULTS = {
    "summary": "", "visual_style": "", "motion_intensity": "medium", "emotion_flow": "",
    "mad_score": 5, "scene_type": "dialogue",
}
PLACEHOLDER = {
    "visual_style": "Unknown", "motion_intensity": "medium", "emotion_flow": "neutral",
    "mad_score": 5, "scene_type": "dialogue",
}


def unfenced(reply: Column) -> Column:
    """Drop a leading ```json fence and a trailing fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```json", ""), r"```$", ""))


def parsed_annotation(reply: Column) -> Column:
    """Annotation struct with defaults; null when the reply is not a JSON object."""
    body = unfenced(reply)
    raw = F.from_json(body, ANNOTATION_SCHEMA)
    empty = F.array().cast("array<string>")
    # A score may come as text or with decimals, which are cut off.
    score = raw["mad_score"].try_cast("double").try_cast("int")
    fields = [
        F.coalesce(score if name == "mad_score" else raw[name], empty if name in ("tags", "key_objects") else F.lit(REPLY_DEFAULTS[name])).alias(name)
        for name in ("summary", "tags", "visual_style", "motion_intensity", "key_objects", "emotion_flow", "mad_score", "scene_type")
    ]
    readable = F.is_valid_json(body) if hasattr(F, "is_valid_json") else F.json_object_keys(body).isNotNull()
    return F.when(readable, F.struct(*fields))


def tenths_label(start_ms: Column, end_ms: Column) -> Column:
    """``Segment 1.0s - 2.5s``, half-up to a tenth."""

    def tenths(value: Column) -> Column:
        t = F.call_function("div", value + 50, F.lit(100))
        return F.concat(F.call_function("div", t, F.lit(10)).cast("string"), F.lit("."), (t % 10).cast("string"))

    return F.concat(F.lit("Segment "), tenths(start_ms), F.lit("s - "), tenths(end_ms), F.lit("s"))


def placeholder_annotation(start_ms: Column, end_ms: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(
        tenths_label(start_ms, end_ms).alias("summary"), empty.alias("tags"),
        F.lit(PLACEHOLDER["visual_style"]).alias("visual_style"),
        F.lit(PLACEHOLDER["motion_intensity"]).alias("motion_intensity"), empty.alias("key_objects"),
        F.lit(PLACEHOLDER["emotion_flow"]).alias("emotion_flow"), F.lit(PLACEHOLDER["mad_score"]).alias("mad_score"),
        F.lit(PLACEHOLDER["scene_type"]).alias("scene_type"),
    )


def text_list(text: Column) -> Column:
    """JSON text to an array of strings; empty when missing."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def ranked_ids(reply: Column) -> Column:
    """A reply that should be a JSON object from a prompt's place in the call to its list of ids; anything else is null."""
    return F.from_json(unfenced(reply), "map<string, array<bigint>>")


def rate(text: Column) -> Column:
    """``num/den`` or a plain number to a frame rate; 30 for a zero denominator or no number."""
    parts = F.split(text, "/")
    num, den = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.coalesce(F.when(F.size(parts) == 2, F.when(den == 0, 30.0).otherwise(num / den)).otherwise(num), F.lit(30.0))
