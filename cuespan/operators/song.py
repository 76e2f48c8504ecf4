"""Song-side operators: lyric ranges, beats per line, intro, waveform and onsets.

lines: (song_id, line_no, start_ms, end_ms, text); beats: (song_id, beat_ms).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.functions.timecode import idiv, round10
from cuespan.operators.intervals import points_in_spans
from cuespan.operators.scans import dealt

# Fixed values of the song analysis.
INTRO_LABEL = "前奏 / Intro"
INTRO_MS = 50
WAVE_POINTS = 1000
ONSET_SHARE = 0.1


def offset_lyrics(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines that touch the song's range, cut to it and counted from its start."""
    s, e = F.col("range_start_ms"), F.col("range_end_ms")
    start = F.greatest(F.lit(0).cast("bigint"), F.col("start_ms") - s)
    end = F.least(e - s, F.col("end_ms") - s)
    kept = lines.join(ranges, "song_id").filter((F.col("end_ms") > s) & (F.col("start_ms") < e) & (end > start))
    return kept.select("song_id", "line_no", round10(start).alias("start_ms"), round10(end).alias("end_ms"), "text")


def line_beats(lines: DataFrame, beats: DataFrame) -> DataFrame:
    """Array ``beats`` of the beats on a line, both ends included; empty where there is none."""
    spans = lines.select("song_id", "line_no", "start_ms", "end_ms")
    t = F.col("beat_ms")
    hits = points_in_spans(
        beats, spans, ["song_id"], t, F.col("start_ms"), F.col("end_ms"), t.between(F.col("start_ms"), F.col("end_ms"))
    )
    lists = hits.groupBy("song_id", "line_no").agg(F.array_sort(F.collect_list("beat_ms")).alias("beats"))
    return lines.join(dealt(lists), ["song_id", "line_no"], "left").withColumn(
        "beats", F.coalesce("beats", F.array().cast("array<bigint>"))
    )


def add_intro(lines: DataFrame) -> DataFrame:
    """Put an intro line before songs whose first line starts late."""
    rows = lines.withColumn("is_intro", F.lit(False))
    first = lines.groupBy("song_id").agg(F.min("start_ms").alias("first_ms"), F.min("line_no").alias("first_no"))
    intro = first.filter(F.col("first_ms") > INTRO_MS).select(
        "song_id", (F.col("first_no") - 1).alias("line_no"), F.lit(0).cast("bigint").alias("start_ms"),
        F.col("first_ms").alias("end_ms"), F.lit(INTRO_LABEL).alias("text"), F.lit(True).alias("is_intro"),
    )
    return rows.select("song_id", "line_no", "start_ms", "end_ms", "text", "is_intro").unionByName(intro)


def envelope(samples: DataFrame, *, points: int = WAVE_POINTS) -> DataFrame:
    """Peak per hop as a share of the track's peak, three decimals. samples: (track_id, pos, value)."""
    sizes = samples.groupBy("track_id").agg(
        F.greatest(F.lit(1).cast("bigint"), idiv(F.max("pos") + 1, points)).alias("hop"), F.max(F.abs("value")).alias("peak")
    )
    hops = samples.join(sizes, "track_id").groupBy("track_id", idiv(F.col("pos"), F.col("hop")).alias("point")).agg(
        F.max(F.abs("value")).alias("high"), F.first("peak").alias("peak")
    )
    level = F.when(F.col("peak") > 0, F.round(F.col("high") / F.col("peak"), 3)).otherwise(F.col("high"))
    return hops.select("track_id", "point", level.alias("level"))


def select_onsets(onsets: DataFrame, *, share: float = ONSET_SHARE) -> DataFrame:
    """Onsets stronger than ``share`` of the song's strongest. onsets: (song_id, t_ms, strength)."""
    peaks = onsets.groupBy("song_id").agg(F.max("strength").alias("peak"))
    strength = F.when(F.col("peak") > 0, F.col("strength") / F.col("peak")).otherwise(F.col("strength"))
    rows = onsets.join(peaks, "song_id").withColumn("strength", strength).drop("peak")
    return rows.filter(F.col("strength") > share).withColumn("strength", F.round("strength", 3))
