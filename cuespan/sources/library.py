"""Library files: discovery, subtitle resolution, listings, index state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions.keys import quoted_url
from cuespan.functions.payload import text_list
from cuespan.functions.text import base_name, folder_of, render_name, without_extension

# Video suffixes, and same-name subtitle suffixes in order of preference.
VIDEO_SUFFIXES = ("mp4", "mkv", "mov", "avi")
SUBTITLE_SUFFIXES = (".srt", ".lrc", ".ass", ".chs.ass", ".cht.ass")
UNSUPPORTED = (".mkv", ".avi", ".mov", ".flv")
VIDEO_URL = "/api/video_file?path="
# Where a file name holds its episode number, in order, and the marks of Chinese scripts.
VIDEO_EPISODES = (r"-\s*(\d{1,2})", r"\b(\d{1,2})\b")
SUBTITLE_EPISODES = (r"[eE](\d{1,2})", r"-\s*(\d{1,2})", r"\b(\d{1,2})\b")
SIMPLIFIED, TRADITIONAL = (".chs.", "简体", "sc"), (".cht.", "繁体", "tc")


def list_files(spark, folder: str) -> DataFrame:
    """(path, size_bytes, modified_at) of the files directly in ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def discover_library(files: DataFrame) -> DataFrame:
    """Distinct video files; the suffix is all lower or all upper case."""
    names = "|".join([*VIDEO_SUFFIXES, *[s.upper() for s in VIDEO_SUFFIXES]])
    return files.filter(F.col("path").rlike(rf"\.(?:{names})$")).dropDuplicates(["path"])


def episode_of_video(name: Column) -> Column:
    return _first_number(name, VIDEO_EPISODES)


def episode_of_subtitle(name: Column) -> Column:
    return _first_number(name, SUBTITLE_EPISODES)


def _first_number(name: Column, patterns: tuple[str, ...]) -> Column:
    found = [F.regexp_extract(name, p, 1) for p in patterns]
    return F.coalesce(*[F.when(f != "", f) for f in found]).cast("int")


def match_episodes(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Subtitle of the same episode number in the video's folder or its ``subtitles`` folder.

    Simplified Chinese first, then traditional, then the first listed (the subfolder
    comes before the folder, then path order).
    """
    path, low = F.col("path"), F.lower("path")
    usable = files.filter(low.rlike(r"\.(?:ass|srt|lrc)$")).select("path").distinct()
    folder = folder_of(path)
    nested = folder.endswith("/subtitles")
    places = F.when(nested, F.array(
        F.struct(F.regexp_replace(folder, "/subtitles$", "").alias("folder"), F.lit(0).alias("place")),
        F.struct(folder.alias("folder"), F.lit(1).alias("place")),
    )).otherwise(F.array(F.struct(folder.alias("folder"), F.lit(1).alias("place"))))
    marked = lambda marks: low.contains(marks[0]) | path.contains(marks[1]) | low.contains(marks[2])
    script = F.when(marked(SIMPLIFIED), 0).when(marked(TRADITIONAL), 1).otherwise(2)
    subtitles = usable.select(
        "path", episode_of_subtitle(base_name(path)).alias("episode"), script.alias("script"), F.inline(places)
    ).filter(F.col("episode").isNotNull())
    # The best one per folder and episode before the join: one row a key.
    best = subtitles.groupBy("folder", "episode").agg(F.min_by("path", F.struct("script", "place", "path")).alias("subtitle_path"))
    asked = videos.select(
        "video_id", folder_of(F.col("original_path")).alias("folder"), episode_of_video(base_name(F.col("original_path"))).alias("episode")
    )
    return asked.join(best, ["folder", "episode"]).select("video_id", "subtitle_path")


def resolve_subtitles(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Same-name subtitle in suffix order, else the episode match, else null."""
    wanted = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("suffix")) for i, s in enumerate(SUBTITLE_SUFFIXES)])
    asked = videos.select("video_id", without_extension(F.col("original_path")).alias("root"), F.inline(wanted))
    asked = asked.select("video_id", "rank", F.concat("root", "suffix").alias("path"))
    same = asked.join(files.select("path").distinct(), "path").groupBy("video_id").agg(F.min_by("path", "rank").alias("subtitle_path"))
    rest = videos.join(same, "video_id", "left_anti")
    found = same.select("*", F.lit("same name").alias("found_by")).unionByName(
        match_episodes(rest, files).select("*", F.lit("episode").alias("found_by"))
    )
    return videos.select("video_id").join(found, "video_id", "left")


def list_videos(videos: DataFrame, files: DataFrame, *, folder: str, backup: str) -> DataFrame:
    """Preferred picture (.bak render, render, proxy, original) and sound (backup render, else the picture)."""
    render = render_name(F.col("original_path"), folder)
    rows = videos.select("*", F.concat(render, F.lit(".bak")).alias("_bak"), render.alias("_render"),
                         render_name(F.col("original_path"), backup).alias("_backup"))
    present = files.select("path").distinct()
    for name in ("_bak", "_render", "_backup"):
        rows = rows.join(present.select(F.col("path").alias(name), F.lit(True).alias(f"{name}_there")), name, "left")
    there = lambda n: F.when(F.col(f"{n}_there"), F.col(n))
    proxy = F.when(F.col("proxy_path") != "", F.col("proxy_path"))
    picture = F.coalesce(there("_bak"), there("_render"), proxy, F.col("original_path"))
    sound = F.coalesce(there("_backup"), picture)
    url = lambda c: F.concat(F.lit(VIDEO_URL), quoted_url(c))
    return rows.select(*videos.columns, url(picture).alias("proxy_url"), url(sound).alias("original_audio_proxy_url"))


def source_choice(slots: DataFrame, files: DataFrame, *, folder: str, backup: str) -> DataFrame:
    """File a slot is rendered from.

    Only containers a browser cannot play are replaced: with the original sound by the
    backup render where there is one, without it by the render proxy.
    """
    path = F.col("video_path")
    rows = slots.withColumn("_backup", render_name(path, backup))
    present = files.select(F.col("path").alias("_backup"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(present, "_backup", "left")
    odd = F.lit(False)
    for suffix in UNSUPPORTED:
        odd = odd | F.lower(path).endswith(suffix)
    with_sound = F.when(F.col("_there"), F.col("_backup")).otherwise(path)
    chosen = F.when(~odd, path).when(F.col("use_original_audio"), with_sound).otherwise(render_name(path, folder))
    return rows.select(*slots.columns, chosen.alias("source_path"))


def list_cues(cues: DataFrame) -> DataFrame:
    """Cues of every video in start order; file order is kept by partition."""
    return cues.repartitionByRange("video_id", "start_ms").sortWithinPartitions("video_id", "start_ms", "cue_id")


def list_segments(segments: DataFrame) -> DataFrame:
    """Segments in start order with their JSON columns read."""
    rows = segments.withColumn("tags", text_list(F.col("tags_json"))).drop("tags_json")
    return rows.repartitionByRange("video_id", "start_ms").sortWithinPartitions("video_id", "start_ms", "segment_id")


def index_state(videos: DataFrame, keyframes: DataFrame, segments: DataFrame) -> DataFrame:
    """What indexing still has to do per video: full, backfill, annotate or skip."""
    frames = keyframes.groupBy("video_id").agg(F.count("*").alias("frames"))
    scenes = segments.groupBy("video_id").agg(F.count("*").alias("scenes"))
    rows = videos.join(frames, "video_id", "left").join(scenes, "video_id", "left")
    state = (
        F.when(F.col("frames").isNull(), "full")
        .when(~F.coalesce("asr_processed", F.lit(False)), "backfill")
        .when(F.col("scenes").isNull(), "annotate")
        .otherwise("skip")
    )
    return rows.select("video_id", state.alias("state"))
