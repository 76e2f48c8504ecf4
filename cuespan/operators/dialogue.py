"""Dialogue rules: timing, keeping source audio, speakers, volumes, slot checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions.timecode import CLIP_MARGIN_MS, seconds_to_ms, unit_volume

#: Names in order, each with the words that tell it in a summary and in a transcript.
Speakers = Mapping[str, tuple[Sequence[str], Sequence[str]]]
UNKNOWN = "unknown"
# Sections that count as a climax, and the scores that keep audio.
CLIMAX_WORDS = ("chorus", "副歌", "intro", "outro")
CLIMAX_SCORE, EMOTION_SCORE, DEFAULT_SCORE = 8, 9, 5


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def dialogue_mode(independent: Column, keep_audio: Column) -> Column:
    return F.when(independent, "independent").when(keep_audio, "linked").otherwise("off")


def dialogue_timing(children: DataFrame) -> DataFrame:
    """Song time and source time of independent dialogue, each kept within the song and the source.

    children: line_start_ms, line_end_ms, song_ms, and, each possibly null, offset_start_ms,
    offset_end_ms, clip_start_ms, clip_duration_ms, video_duration_ms, dialogue_start_ms,
    dialogue_end_ms, dialogue_clip_start_ms.
    """
    least = F.lit(CLIP_MARGIN_MS).cast("bigint")
    offset = F.coalesce("offset_start_ms", _zero())
    shown_at = F.col("line_start_ms") + offset
    line_ms = F.col("line_end_ms") - F.col("line_start_ms")
    shown = F.greatest(least, F.coalesce(F.col("clip_duration_ms"), F.coalesce(F.col("offset_end_ms"), line_ms) - offset))
    source = F.greatest(_zero(), F.coalesce("dialogue_clip_start_ms", "clip_start_ms", _zero()))
    left = F.when(F.col("video_duration_ms") != 0, F.greatest(least, F.col("video_duration_ms") - source)).otherwise(shown)
    start = F.greatest(_zero(), F.least(F.col("song_ms"), F.coalesce(F.col("dialogue_start_ms"), shown_at)))
    rows = children.select("*", start.alias("d_start_ms"), source.alias("d_clip_start_ms"), left.alias("_left"), shown.alias("_shown"))
    s = F.col("d_start_ms")
    end = F.greatest(s + least, F.least(
        F.col("song_ms"), s + F.col("_left"), F.coalesce(F.col("dialogue_end_ms"), s + F.least(F.col("_shown"), F.col("_left")))
    ))
    return rows.withColumn("d_end_ms", end).withColumn("d_duration_ms", F.col("d_end_ms") - s).drop("_left", "_shown")


def dialogue_track(children: DataFrame) -> DataFrame:
    """Independent dialogue of all children that have a source, with its timing."""
    said = children.filter(F.col("dialogue_independent") & F.coalesce(F.col("video_path") != "", F.lit(False)))
    rows = dialogue_timing(said)
    return rows.select(
        "song_id", "slot_no", "child_no",
        F.concat_ws("-", F.lit("dialogue"), F.col("slot_no").cast("string"), F.col("child_no").cast("string")).alias("clip_id"),
        F.coalesce(F.when(F.col("dialogue_video_path") != "", F.col("dialogue_video_path")), F.col("video_path")).alias("video_path"),
        F.col("d_start_ms").alias("start_ms"), F.col("d_end_ms").alias("end_ms"),
        F.col("d_clip_start_ms").alias("clip_start_ms"), F.col("d_duration_ms").alias("clip_duration_ms"),
        F.coalesce("transcript", F.lit("")).alias("transcript"), F.coalesce("speaker", F.lit(UNKNOWN)).alias("speaker"),
    )


def keeps_audio(transcript: Column, score: Column, scene: Column, section: Column) -> Column:
    """Spoken scenes keep their audio: in a climax when emotional or strong, else only when both."""
    low = F.lower(F.coalesce(section, F.lit("")))
    climax = F.lit(False)
    for word in CLIMAX_WORDS:
        climax = climax | low.contains(word)
    strength = F.coalesce(F.when(score != 0, score), F.lit(DEFAULT_SCORE))
    emotional = F.coalesce(scene, F.lit("")) == "emotional"
    wanted = F.when(climax, emotional | (strength >= CLIMAX_SCORE)).otherwise(emotional & (strength >= EMOTION_SCORE))
    return (F.coalesce(transcript, F.lit("")) != "") & wanted


def clip_choice(transcript: Column, segment_start: Column, candidate_time: Column) -> Column:
    """A spoken scene plays from its start, any other from the candidate's time."""
    spoken = F.coalesce(transcript, F.lit("")) != ""
    return F.greatest(_zero(), F.when(spoken, segment_start).otherwise(candidate_time))


def resolve_speaker(summary: Column, transcript: Column, speaker: Column, manual: Column, *, speakers: Speakers) -> Column:
    """A manual or known speaker stands; else the first of ``speakers`` whose words occur in summary or transcript."""
    named = F.lower(F.coalesce(speaker, F.lit(UNKNOWN)))
    known = F.when(named.isin(*speakers, UNKNOWN), named).otherwise(UNKNOWN)
    about, said = F.lower(F.coalesce(summary, F.lit(""))), F.lower(F.coalesce(transcript, F.lit("")))
    found = F.when(about == "", UNKNOWN)
    for name, (in_summary, in_transcript) in speakers.items():
        hit = F.lit(False)
        for word in in_summary:
            hit = hit | about.contains(word)
        for word in in_transcript:
            hit = hit | said.contains(word)
        found = found.when(hit, name)
    return F.when(F.coalesce(manual, F.lit(False)) | (known != UNKNOWN), known).otherwise(found.otherwise(UNKNOWN))


def volumes(slots: DataFrame) -> DataFrame:
    """Mix volumes: music as given, dialogue at most 1, and the slot's own only where audio is kept."""
    music, spoken = F.coalesce("music_volume", F.lit(1.0)), F.coalesce("dialogue_volume", F.lit(1.0))
    return slots.withColumn("music_mix", music).withColumn("dialogue_mix", F.least(spoken, F.lit(1.0))).withColumn(
        "slot_volume", F.when(F.col("keep_audio"), spoken).otherwise(1.0)
    ).withColumn("preview_volume", unit_volume(spoken))


def assigned_start(clip_start: Column, video_ms: Column, clip_ms: Column) -> Column:
    """A hand-picked clip start, kept so that the clip fits its source; as it is where the source's length is unknown."""
    given = F.greatest(_zero(), F.coalesce(clip_start, _zero()))
    # Nulls do not count in the least of values.
    latest = video_ms - clip_ms
    return F.least(F.when(latest.isNotNull(), F.greatest(_zero(), latest)), given)


def validate_slots(edits: DataFrame, text: str = "slot_json") -> DataFrame:
    """Check hand-edited slot JSON: (..., accepted, reason, video_path, clip_start_ms, clip_duration_ms)."""
    raw = F.from_json(F.col(text), "video_path string, clip_start string, clip_duration string")
    rows = edits.withColumn("_slot", raw)
    start, length = seconds_to_ms(F.col("_slot.clip_start")), seconds_to_ms(F.col("_slot.clip_duration"))
    reason = (
        F.when(F.json_object_keys(text).isNull(), "not JSON")
        .when(F.col("_slot.video_path").isNull(), "video_path is missing")
        .when(start.isNull(), "clip_start is no number")
        .when(length.isNull(), "clip_duration is no number")
    )
    return rows.select(
        *edits.columns, reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("")).alias("reason"),
        F.col("_slot.video_path").alias("video_path"), start.alias("clip_start_ms"), length.alias("clip_duration_ms"),
    )
