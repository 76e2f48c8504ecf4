"""Opening/ending marks, reuse of earlier annotations, and the final annotation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.functions.payload import placeholder_annotation
from cuespan.operators.intervals import points_in_spans

# Length of an opening or ending, and how far apart matching scenes may lie.
THEME_MS = 92_000
REUSE_MS = 1500
COPIED = ("summary", "tags", "visual_style", "motion_intensity", "key_objects", "emotion_flow")
# Words of the opening and ending songs, in the cue text.
OPENING_WORDS = ("心臓こじ开けて", "さらっと食べて", "撬开心脏", "平静食用之")
ENDING_WORDS = (
    "どうでもいい流な夜", "どうでもいいような夜", "无所谓的夜晚", "响めき煌めき", "伴着回响与璀璨", "響めき煌めき",
)


def _said(words: Sequence[str]):
    hit = F.lit(False)
    for word in words:
        hit = hit | F.col("text").contains(word)
    return hit


def mark_themes(
    segments: DataFrame,
    cues: DataFrame,
    *,
    opening: Sequence[str] = OPENING_WORDS,
    ending: Sequence[str] = ENDING_WORDS,
    length_ms: int = THEME_MS,
) -> DataFrame:
    """Flag segments whose middle lies in the opening, else in the ending, of their video.

    Each starts at the first cue with one of its words; ``relative_ms`` counts from there.
    """
    starts = cues.select("video_id", "start_ms", _said(opening).alias("op"), _said(ending).alias("ed")).filter("op OR ed")
    starts = starts.groupBy("video_id").agg(
        F.min(F.when(F.col("op"), F.col("start_ms"))).alias("op_at"),
        F.min(F.when(F.col("ed"), F.col("start_ms"))).alias("ed_at"),
    )
    twice = F.col("start_ms") + F.col("end_ms")
    within = lambda at: F.coalesce(twice.between(2 * F.col(at), 2 * F.col(at) + 2 * length_ms), F.lit(False))
    is_op = within("op_at")
    is_ed = ~is_op & within("ed_at")
    relative = F.when(is_op, F.col("start_ms") - F.col("op_at")).when(is_ed, F.col("start_ms") - F.col("ed_at"))
    return segments.join(starts, "video_id", "left").select(
        *segments.columns, is_op.alias("is_op"), is_ed.alias("is_ed"),
        F.coalesce(relative, F.lit(0)).cast("bigint").alias("relative_ms"),
    )


def theme_starts(segments: DataFrame) -> DataFrame:
    """First opening and first ending start per video, one row per kind."""
    return _theme_rows(segments).groupBy("video_id", "kind").agg(F.min("start_ms").alias("theme_ms"))


def _theme_rows(segments: DataFrame) -> DataFrame:
    kinds = F.filter(
        F.array(F.when(F.col("is_op"), "op"), F.when(F.col("is_ed"), "ed")), lambda k: k.isNotNull()
    )
    return segments.select("video_id", "segment_id", "start_ms", F.explode(kinds).alias("kind"))


def reusable_segments(asked: DataFrame, segments: DataFrame, *, within_ms: int = REUSE_MS) -> DataFrame:
    """For each asked (video_id, kind, relative_ms), the lowest segment id of another video that fits.

    A donor fits when it has the same kind and starts less than ``within_ms`` away,
    counted from the first such scene of its video. Donors are first reduced to two rows
    per (kind, relative time): the lowest id, and the lowest id of a different video. The
    band join then runs over distinct times only, whatever the number of videos.
    """
    rows = _theme_rows(segments)
    rows = rows.join(theme_starts(segments), ["video_id", "kind"]).select(
        "kind", (F.col("start_ms") - F.col("theme_ms")).alias("donor_ms"), "segment_id", "video_id"
    )
    per_video = rows.groupBy("kind", "donor_ms", "video_id").agg(F.min("segment_id").alias("segment_id"))
    first = per_video.groupBy("kind", "donor_ms").agg(F.min(F.struct("segment_id", "video_id")).alias("a"))
    second = per_video.join(first, ["kind", "donor_ms"]).filter(F.col("video_id") != F.col("a.video_id"))
    second = second.groupBy("kind", "donor_ms").agg(F.min(F.struct("segment_id", "video_id")).alias("a"))
    donors = first.unionByName(second)
    times = asked.select("kind", "relative_ms").distinct()
    at, low, high = F.col("donor_ms"), F.col("relative_ms") - (within_ms - 1), F.col("relative_ms") + (within_ms - 1)
    near = points_in_spans(donors, times, ["kind"], at, low, high, at.between(low, high), bucket_ms=within_ms)
    best = near.groupBy("kind", "relative_ms").agg(F.min("a").alias("best"))
    other = near.join(best, ["kind", "relative_ms"]).filter(F.col("a.video_id") != F.col("best.video_id"))
    other = other.groupBy("kind", "relative_ms").agg(F.min("a").alias("other"))
    found = best.join(other, ["kind", "relative_ms"], "left")
    donor = F.when(F.col("best.video_id") != F.col("video_id"), F.col("best.segment_id")).otherwise(F.col("other.segment_id"))
    return asked.join(found, ["kind", "relative_ms"], "left").select(*asked.columns, donor.alias("donor_id"))


def reuse_annotations(marked: DataFrame, segments: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Copy ``fields`` from the reusable scene; rows without one keep ``donor_id`` null."""
    kind = F.when(F.col("is_op"), "op").when(F.col("is_ed"), "ed")
    asked = marked.filter(F.col("is_op") | F.col("is_ed")).withColumn("kind", kind)
    found = reusable_segments(asked, segments)
    donors = segments.select(F.col("segment_id").alias("donor_id"), *[F.col(f).alias(f"donor_{f}") for f in fields])
    return found.join(donors, "donor_id", "left")


def annotation_rows(segments: DataFrame, reused: DataFrame, fresh: DataFrame) -> DataFrame:
    """Annotation struct per segment: the reused one, else the fresh one, else a placeholder.

    ``reused`` and ``fresh`` are (segment_id, annotation).
    """
    a = reused.select("segment_id", F.col("annotation").alias("_reused"))
    b = fresh.join(a, "segment_id", "left_anti").select("segment_id", F.col("annotation").alias("_fresh"))
    joined = segments.join(a, "segment_id", "left").join(b, "segment_id", "left")
    source = F.when(F.col("_reused").isNotNull(), "reused").when(F.col("_fresh").isNotNull(), "fresh").otherwise("placeholder")
    return joined.select(
        *segments.columns, source.alias("source"),
        F.coalesce("_reused", "_fresh", placeholder_annotation(F.col("start_ms"), F.col("end_ms"))).alias("annotation"),
    )
