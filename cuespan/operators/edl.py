"""Edit-decision rows: every clip of every track in frames, with numbered source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.functions.timecode import frames_of, idiv
from cuespan.operators.scans import numbered

# The shortest source length that is declared, and the audio channels.
SOURCE_LEAST_MS = 1_000_000
CHANNELS, CHANNELS_WITH_DIALOGUE = 4, 6


def _ordered(slots: DataFrame, clips: DataFrame) -> DataFrame:
    """Slots (part 0) then dialogue clips (part 1), each with its place in its list."""
    fields = ["song_id", "video_path", "start_ms", "end_ms", "clip_start_ms", "clip_duration_ms", "keep_audio"]
    shots = numbered(slots, ["song_id"], ["slot_no"], idiv(F.col("slot_no"), 4096), "place")
    spoken = numbered(clips, ["song_id"], ["clip_no"], idiv(F.col("clip_no"), 4096), "place").withColumn("keep_audio", F.lit(True))
    return shots.select(*fields, "place", F.lit(0).alias("part")).unionByName(spoken.select(*fields, "place", F.lit(1).alias("part")))


def file_registry(slots: DataFrame, clips: DataFrame) -> DataFrame:
    """Distinct sources per song, numbered from 1 by first use: (song_id, video_path, part, place, file_no)."""
    return _registry(_ordered(slots, clips))


def _registry(rows: DataFrame) -> DataFrame:
    first = rows.groupBy("song_id", "video_path").agg(F.min(F.struct("part", "place")).alias("first"))
    first = first.select("song_id", "video_path", "first.*")
    chunk = F.col("part").cast("bigint") * (1 << 40) + idiv(F.col("place"), 4096)
    counted = numbered(first, ["song_id"], ["part", "place"], chunk, "n")
    return counted.select("song_id", "video_path", "part", "place", (F.col("n") + 1).alias("file_no"))


def edl_rows(slots: DataFrame, clips: DataFrame) -> DataFrame:
    """One row per clip item. A kept audio or dialogue clip gives a left and a right row.

    The first item that uses a file defines it. ``channels`` counts a song's audio outputs.
    """
    rows = _ordered(slots, clips)
    files = _registry(rows)
    used = files.select("song_id", "video_path", "file_no", F.struct("part", "place").alias("first"))
    span = F.col("end_ms") - F.col("start_ms")
    length = F.when(F.col("clip_duration_ms") != 0, F.col("clip_duration_ms")).otherwise(span)
    picture = F.when(F.col("part") == 0, F.array(F.lit("video")))
    sound = F.when(F.col("part") == 1, F.array(F.lit("independent-l"), F.lit("independent-r"))).when(
        F.col("keep_audio"), F.array(F.lit("audio-l"), F.lit("audio-r"))
    )
    empty = F.array().cast("array<string>")
    tracks = F.concat(F.coalesce(picture, empty), F.coalesce(sound, empty))
    items = rows.join(used, ["song_id", "video_path"]).select(
        "song_id", "place", "part", "video_path", "file_no", "first", F.explode(tracks).alias("track"),
        frames_of(F.col("start_ms")).alias("start_f"), frames_of(F.col("end_ms")).alias("end_f"),
        frames_of(F.col("clip_start_ms")).alias("in_f"), frames_of(F.col("clip_start_ms") + span).alias("out_f"),
        frames_of(F.greatest(length, F.lit(SOURCE_LEAST_MS).cast("bigint"))).alias("source_f"),
    )
    defines = (F.struct("part", "place") == F.col("first")) & F.col("track").isin("video", "independent-l")
    spoken = clips.select("song_id").distinct().withColumn("_spoken", F.lit(True))
    return items.join(spoken, "song_id", "left").select(
        "song_id", "track", F.col("place").alias("item_no"), "video_path", "file_no", defines.alias("defines_file"),
        "start_f", "end_f", "in_f", "out_f", "source_f",
        F.when(F.col("_spoken"), CHANNELS_WITH_DIALOGUE).otherwise(CHANNELS).alias("channels"),
    )


def music_rows(slots: DataFrame, clips: DataFrame, music: DataFrame) -> DataFrame:
    """The music track as rows of :func:`edl_rows`: left and right from the start of the song to the end of its last slot.

    music: (song_id, audio_path). The file is defined by the left row and has number 0; a song without slots has music of no length.
    """
    last = slots.groupBy("song_id").agg(F.max_by("end_ms", "slot_no").alias("_end"))
    spoken = clips.select("song_id").distinct().withColumn("_spoken", F.lit(True))
    rows = music.join(last, "song_id", "left").join(spoken, "song_id", "left")
    whole, none = frames_of(F.coalesce("_end", F.lit(0).cast("bigint"))), F.lit(0).cast("bigint")
    return rows.select("song_id", "audio_path", whole.alias("_whole"), "_spoken", F.explode(F.array(F.lit("music-l"), F.lit("music-r"))).alias("track")).select(
        "song_id", "track", none.alias("item_no"), F.col("audio_path").alias("video_path"), none.alias("file_no"), (F.col("track") == "music-l").alias("defines_file"),
        none.alias("start_f"), F.col("_whole").alias("end_f"), none.alias("in_f"), F.col("_whole").alias("out_f"), F.col("_whole").alias("source_f"),
        F.when(F.col("_spoken"), CHANNELS_WITH_DIALOGUE).otherwise(CHANNELS).alias("channels"),
    )
