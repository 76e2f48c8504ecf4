"""Render plans: one nested document per song, written and read back as JSON lines.

A document is one row by its format, so its size is that of its song.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.operators.scans import dealt

PLAN_SCHEMA = (
    "slots array<struct<startTime: double, endTime: double, videoPath: string, clipStart: double, clipDuration: double, "
    "keepAudio: boolean, transcript: string, speaker: string, transition: string>>, "
    "dialogueClips array<struct<startTime: double, endTime: double, videoPath: string, clipStart: double, clipDuration: double, transcript: string>>, "
    "lyrics array<struct<start: double, end: double, text: string, beats: array<double>>>, "
    "musicVolume double, dialogueVolume double, duration double"
)


def _seconds(name: str, alias: str) -> Column:
    return (F.col(name) / 1000.0).alias(alias)


def _listed(rows: DataFrame, order: str, fields: list[Column], name: str) -> DataFrame:
    """Ordered array ``name`` per song."""
    item = F.struct(F.col(order).alias("_at"), F.struct(*fields).alias("item"))
    lists = rows.groupBy("song_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return lists.select("song_id", F.transform("_items", lambda x: x.item).alias(name))


def render_plans(slots: DataFrame, clips: DataFrame, lines: DataFrame, *, music: float = 1.0, dialogue: float = 1.0) -> DataFrame:
    """(song_id, plan): plan is the camelCase document, times in seconds. lines carry ``beats``."""
    time = [_seconds("start_ms", "startTime"), _seconds("end_ms", "endTime"), F.col("video_path").alias("videoPath"),
            _seconds("clip_start_ms", "clipStart"), _seconds("clip_duration_ms", "clipDuration")]
    shots = _listed(slots, "slot_no", [*time, F.col("keep_audio").alias("keepAudio"), F.col("transcript"), F.col("speaker"), F.col("transition")], "slots")
    spoken = _listed(clips, "clip_no", [*time, F.col("transcript")], "dialogueClips")
    beats = F.transform("beats", lambda b: b / 1000.0).alias("beats")
    sung = _listed(lines, "line_no", [_seconds("start_ms", "start"), _seconds("end_ms", "end"), F.col("text"), beats], "lyrics")
    total = slots.groupBy("song_id").agg((F.max_by("end_ms", "slot_no") / 1000.0).alias("duration"))
    rows = shots.join(spoken, "song_id", "full_outer").join(sung, "song_id", "full_outer").join(dealt(total), "song_id", "left")
    listed = [F.coalesce(c, F.array()).alias(c) for c in ("slots", "dialogueClips", "lyrics")]
    return rows.select("song_id", F.struct(
        *listed, F.lit(music).alias("musicVolume"), F.lit(min(dialogue, 1.0)).alias("dialogueVolume"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
    ).alias("plan"))


def as_documents(plans: DataFrame) -> DataFrame:
    return plans.select("song_id", F.to_json("plan").alias("document"))


def write_render_plans(plans: DataFrame, path: str) -> None:
    """One JSON line per song, in folders by nothing but Spark's own partitions."""
    plans.select("song_id", "plan.*").write.mode("overwrite").json(path)


def read_render_plans(spark: SparkSession, path: str) -> DataFrame:
    """(song_id, plan) from files of JSON lines that name their song."""
    files = spark.read.schema(f"song_id bigint, {PLAN_SCHEMA}").json(path)
    return files.select("song_id", F.struct(*(c for c in files.columns if c != "song_id")).alias("plan"))


def read_plan_files(spark: SparkSession, path: str) -> DataFrame:
    """(song_id, plan) from files of one JSON document each, in any layout of white space; the file's name stands for the song."""
    files = spark.read.schema(PLAN_SCHEMA).option("multiLine", True).json(path)
    return files.select(F.input_file_name().alias("song_id"), F.struct(*files.columns).alias("plan"))


def parse_documents(documents: DataFrame) -> DataFrame:
    return documents.select("song_id", F.from_json("document", PLAN_SCHEMA).alias("plan"))


def _ms(name: str) -> Column:
    return F.round(F.col(name) * 1000).cast("bigint")


def plan_slots(plans: DataFrame) -> DataFrame:
    rows = plans.select("song_id", F.posexplode_outer("plan.slots").alias("place", "s")).filter("s IS NOT NULL")
    return rows.select(
        "song_id", "place", _ms("s.startTime").alias("start_ms"), _ms("s.endTime").alias("end_ms"),
        F.col("s.videoPath").alias("video_path"), _ms("s.clipStart").alias("clip_start_ms"), _ms("s.clipDuration").alias("clip_duration_ms"),
        F.col("s.keepAudio").alias("keep_audio"), "s.transcript", "s.speaker", "s.transition",
    )


def plan_beats(plans: DataFrame) -> DataFrame:
    """Lyric lines with one row per beat; a line without beats keeps one row."""
    lines = plans.select("song_id", F.posexplode("plan.lyrics").alias("place", "l"))
    rows = lines.select("song_id", "place", "l", F.explode_outer("l.beats").alias("beat"))
    return rows.select(
        "song_id", "place", _ms("l.start").alias("start_ms"), _ms("l.end").alias("end_ms"), "l.text", _ms("beat").alias("beat_ms")
    )
