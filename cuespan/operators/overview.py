"""Material overviews and plan tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.functions.text import base_name

# Scene types with their labels in report order, and the sizes of the reports.
SCENE_LABELS = {"emotional": "情感特写", "atmospheric": "氛围空镜", "action": "高动能动作", "dialogue": "日常对话/互动"}
PER_SCENE, SCENE_SCORE, SUMMARY_CHARS = 5, 7, 50
TOP_LINES = 15
SAMPLE_VIDEOS, SAMPLE_SEGMENTS, SHOWN_SEGMENTS = 10, 50, 30


def material_overview(segments: DataFrame) -> DataFrame:
    """Per scene type that has any, the best summaries as one report line: (position, scene_type, line)."""
    known = F.create_map(*[x for name, label in SCENE_LABELS.items() for x in (F.lit(name), F.lit(label))])
    good = segments.filter((F.col("mad_score") >= SCENE_SCORE) & F.col("scene_type").isin(*SCENE_LABELS))
    w = Window.partitionBy("scene_type").orderBy(F.desc("mad_score"), "segment_id")
    best = good.select("scene_type", "mad_score", "segment_id", "summary").withColumn("rank", F.row_number().over(w))
    best = best.filter((F.col("rank") <= PER_SCENE)).filter(F.coalesce("summary", F.lit("")) != "")
    lists = best.groupBy("scene_type").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("summary", 1, SUMMARY_CHARS).alias("s")))).alias("items"))
    joined = F.array_join(F.transform("items", lambda x: x.s), "；")
    position = F.array_position(F.array(*[F.lit(s) for s in SCENE_LABELS]), F.col("scene_type")).cast("int")
    return lists.select(
        position.alias("position"), "scene_type",
        F.concat(F.lit("- "), "scene_type", F.lit("（"), known[F.col("scene_type")], F.lit("）："), joined).alias("line"),
    )


def top_dialogue(segments: DataFrame, *, limit: int = TOP_LINES) -> DataFrame:
    """The best emotional scenes in which something is said."""
    said = segments.filter((F.col("scene_type") == "emotional") & (F.col("transcript") != ""))
    return said.orderBy(F.col("mad_score").desc_nulls_last(), "segment_id").limit(limit).select(
        "segment_id", "transcript", "summary", F.coalesce("mad_score", F.lit(5)).alias("mad_score")
    )


def library_profile(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """A short sample of the library as text rows: (kind, position, line)."""
    names = videos.orderBy("video_id").limit(SAMPLE_VIDEOS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("video_id", "original_path"))), lambda v: F.concat(F.lit("- "), base_name(v.original_path))).alias("lines")
    ).select(F.lit("video").alias("kind"), F.posexplode("lines").alias("position", "line"))
    scene = lambda s: F.concat(
        F.lit("Scene: "), s.summary, F.lit(" | Style: "), s.visual_style, F.lit(" | Tags: "), F.array_join(s.tags, ", ")
    )
    shown = segments.orderBy("segment_id").limit(SAMPLE_SEGMENTS).orderBy("segment_id").limit(SHOWN_SEGMENTS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "summary", "visual_style", "tags"))), scene).alias("lines")
    ).select(F.lit("scene").alias("kind"), F.posexplode("lines").alias("position", "line"))
    return names.unionByName(shown)


def sections(plan: DataFrame) -> DataFrame:
    """Distinct section names per song with the attributes of their first line, in first-use order."""
    named = plan.filter(F.coalesce("section_name", F.lit("")) != "")
    first = named.groupBy("song_id", "section_name").agg(
        F.min("index").alias("first_index"), F.min_by(F.struct("mood_arc", "narrative_concept", "visual_pacing"), "index").alias("a")
    )
    filled = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit("")).alias(c)
    return first.select("song_id", "section_name", "first_index", filled("mood_arc"), filled("narrative_concept"), filled("visual_pacing"))


PLAN_SCHEMA = (
    "sections array<struct<section_name: string, mood_arc: string, narrative_concept: string, visual_pacing: string, "
    "lines: array<struct<index: bigint, lyric: string, visual_prompt: string, motion_preference: string, emotional_tone: string>>>>"
)


def flatten_plan(plans: DataFrame, parsed: Column) -> DataFrame:
    """One row per planned line with its section's fields; a missing index counts as 0."""
    sections_ = plans.select("song_id", F.posexplode(parsed.sections).alias("section_no", "s"))
    rows = sections_.select("song_id", "section_no", "s", F.posexplode("s.lines").alias("place", "l"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "song_id", "section_no", "place", F.coalesce("l.index", F.lit(0).cast("bigint")).alias("index"), "l.lyric", "l.visual_prompt",
        "l.motion_preference", "l.emotional_tone", text(F.col("s.section_name")).alias("section_name"), text(F.col("s.mood_arc")).alias("mood_arc"),
        text(F.col("s.narrative_concept")).alias("narrative_concept"), text(F.col("s.visual_pacing")).alias("visual_pacing"),
    )
