"""Candidate segments for prompts: eligibility, ranking lists, nearest frames, containing segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.functions.keys import match_key
from cuespan.functions.timecode import idiv
from cuespan.operators.intervals import first_at, nearest
from cuespan.operators.scans import numbered

# Fixed values of the matching rules.
MIN_SCORE = 6
CANDIDATES = 5
BATCH_LINES = 20
MISSING_FRAME_BASE = 9999


def eligible_segments(segments: DataFrame, *, allow_op: bool = False) -> DataFrame:
    """Segments good enough to use. A missing score counts as 5 and so never passes."""
    kept = segments.filter((F.col("mad_score") >= MIN_SCORE) & ~F.col("is_ed"))
    return kept if allow_op else kept.filter(~F.col("is_op"))


def with_videos(segments: DataFrame, videos: DataFrame) -> DataFrame:
    return segments.join(videos.select("video_id", "original_path", "proxy_path", "duration_ms"), "video_id")


def nearest_keyframes(segments: DataFrame, keyframes: DataFrame) -> DataFrame:
    """The keyframe closest to each segment's middle, the lower id on a tie; a stand-in when there is none."""
    asked = segments.withColumn("mid2", F.col("start_ms") + F.col("end_ms"))
    frames = keyframes.select("video_id", (F.col("t_ms") * 2).alias("t2"), "keyframe_id", "frame_path", "motion_score")
    hit = nearest(
        asked, frames, ["video_id"], "mid2", "t2", ["keyframe_id", "frame_path", "motion_score"],
        tie=F.col("keyframe_id"), tie_field="keyframe_id", chunk_ms=1_200_000,
    )
    return hit.select(
        *segments.columns,
        F.coalesce("hit.keyframe_id", MISSING_FRAME_BASE + F.col("segment_id")).alias("keyframe_id"),
        F.coalesce("hit.frame_path", F.lit("")).alias("frame_path"),
        F.coalesce("hit.motion_score", F.lit(0.0)).alias("motion_score"),
    )


def containing_segments(candidates: DataFrame, segments: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Struct ``segment`` of the first segment (earliest start, lowest id) around each candidate's time."""
    spans = segments.withColumn("_after", F.col("end_ms") + 1)
    kind = (spans, "start_ms", "_after", ["start_ms", "segment_id"], ["segment_id", "start_ms", "end_ms", *fields])
    return first_at(candidates, {"segment": kind}, ["video_id"], "t_ms")


def drop_opening_ids(ranks: DataFrame, segments: DataFrame, allowed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Take opening scenes out of the ranked lists of lines that may not use them; ranks close up."""
    flagged = ranks.join(allowed.select(*key).withColumn("_ok", F.lit(True)), list(key), "left")
    listed = flagged.select(*key, F.col("_ok").isNotNull().alias("_ok"), F.posexplode("segment_ids").alias("pos", "segment_id"))
    opening = segments.filter("is_op").select("segment_id", F.lit(True).alias("_op"))
    kept = listed.join(opening, "segment_id", "left").filter(F.col("_ok") | F.col("_op").isNull())
    lists = kept.groupBy(*key).agg(
        F.expr("transform(array_sort(collect_list(struct(pos, segment_id))), x -> x.segment_id)").alias("segment_ids")
    )
    empty = F.array().cast("array<bigint>")
    return ranks.select(*key).join(lists, list(key), "left").withColumn("segment_ids", F.coalesce("segment_ids", empty))


def ranked_candidates(ranks: DataFrame, pool: DataFrame, key: Sequence[str], *, limit: int | None = None) -> DataFrame:
    """One row per listed segment of the pool; with ``limit``, of the first so many of each list. Unknown ids vanish and keep their rank gap."""
    listed = ranks.select(*key, F.posexplode("segment_ids").alias("rank", "segment_id"))
    listed = listed if limit is None else listed.filter(F.col("rank") < limit)
    score = (100 - 10 * F.col("rank")).cast("int")
    return listed.join(pool, "segment_id").withColumn("score", score)


def fallback_ids(segments: DataFrame, *, limit: int = CANDIDATES, cut_first: bool = False, allow_op: bool = False) -> DataFrame:
    """Ranked stand-ins when no ranking came back: the first ``limit`` eligible segments.

    ``cut_first`` keeps an older order: the first ``limit`` of all good segments, and only then endings (and openings)
    are taken out, so fewer may be left.
    """
    if not cut_first:
        first = eligible_segments(segments, allow_op=allow_op).orderBy("segment_id").limit(limit)
    else:
        first = segments.filter(F.col("mad_score") >= MIN_SCORE).orderBy("segment_id").limit(limit)
        first = first.filter(~F.col("is_ed"))
        first = first if allow_op else first.filter(~F.col("is_op"))
    ids = first.agg(F.array_sort(F.collect_list("segment_id")).alias("ids"))
    return ids.select(F.posexplode("ids").alias("rank", "segment_id"))


def line_batches(lines: DataFrame, slots: DataFrame, *, size: int = BATCH_LINES) -> DataFrame:
    """Lines without a slot, numbered into batches of ``size`` per song."""
    filled = slots.select("song_id", F.col("slot_no").alias("line_no"))
    empty = lines.select("song_id", "line_no").join(filled, ["song_id", "line_no"], "left_anti")
    rows = numbered(empty, ["song_id"], ["line_no"], idiv(F.col("line_no"), 4096), "n")
    return rows.select("song_id", "line_no", idiv(F.col("n"), size).alias("batch_no"))


def build_prompts(lines: DataFrame, plan: DataFrame, *, motion: str = "any") -> DataFrame:
    """Prompt per line: the plan's visual prompt and motion where given, else the lyric and the default."""
    given = plan.select(
        "song_id", F.col("index").alias("line_no"), "section_name", "visual_prompt", "motion_preference",
        "narrative_concept", "emotional_tone",
    )
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return lines.join(given, ["song_id", "line_no"], "left").select(
        "song_id", "line_no",
        F.coalesce(filled("visual_prompt"), F.col("text")).alias("prompt"),
        F.coalesce(filled("motion_preference"), F.lit(motion)).alias("motion"),
        F.col("text").alias("lyric"),
        F.coalesce("narrative_concept", F.lit("")).alias("concept"),
        F.coalesce("emotional_tone", F.lit("")).alias("tone"),
    )


def with_match_key(prompts: DataFrame, *, allow_op: bool = False) -> DataFrame:
    return prompts.withColumn(
        "query_hash",
        match_key(F.col("prompt"), F.col("motion"), F.lit(allow_op), F.col("lyric"), F.col("concept"), F.col("tone")),
    )
