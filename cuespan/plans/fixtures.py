"""The media domain tables, derived in full from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.operators.scans import running

SCENES = ["action", "emotional", "atmospheric", "dialogue", "transition"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def video_dir(video_id: Column) -> Column:
    return F.concat(F.lit("/lib/show"), _div(video_id, 20))


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("bigint").cast("string")


def video_path(video_id: Column) -> Column:
    episode = F.lpad((video_id % 20).cast("string"), 2, "0")
    return F.concat(video_dir(video_id), F.lit("/Show - "), episode, F.lit(" [v"), video_id.cast("string"), F.lit("].mkv"))


def frames(spark, d) -> DataFrame:
    """One keyframe per event: time within the user's history, scaled 10,000 times."""
    ev = table(spark, d, "events").select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("keyframe_id"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"),
        F.col("value"), F.col("event_type"), F.col("props"),
    )
    first = ev.groupBy("video_id").agg(F.min("us").alias("us0"))
    return ev.join(first, "video_id").select(
        "video_id", "keyframe_id",
        F.floor((F.col("us") - F.col("us0")) / 10_000_000).cast("bigint").alias("t_ms"),
        (F.col("value") / 20.0).alias("motion_score"),
        "event_type", "props",
    )


def kf(spark, d) -> DataFrame:
    return frames(spark, d).select(
        "video_id", "keyframe_id", "t_ms", "motion_score",
        F.concat(F.lit("f_"), F.col("keyframe_id").cast("string"), F.lit(".jpg")).alias("frame_path"),
    )


def vid(spark, d) -> DataFrame:
    return frames(spark, d).groupBy("video_id").agg((F.max("t_ms") + 1000).alias("duration_ms")).select(
        "video_id", "duration_ms", video_path(F.col("video_id")).alias("original_path"),
        F.concat(F.lit("/proxy/v"), F.col("video_id").cast("string"), F.lit(".mp4")).alias("proxy_path"),
    )


def cue(spark, d) -> DataFrame:
    return frames(spark, d).filter(F.col("event_type").isin("view", "click")).select(
        "video_id", F.col("keyframe_id").alias("cue_id"), F.col("t_ms").alias("start_ms"),
        (F.col("t_ms") + 500 + (F.col("keyframe_id") % 5) * 300).alias("end_ms"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
    )


def seg(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint") * 100
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    scene = F.element_at(F.array(*[F.lit(s) for s in SCENES]), rank)
    return o.select(
        key.alias("segment_id"), F.col("o_custkey").alias("video_id"),
        start.alias("start_ms"), (start + 400 + (key % 7) * 100).alias("end_ms"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("summary"),
        F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('", "'), F.col("o_orderstatus"), F.lit('"]')).alias("tags_json"),
        F.concat(F.lit("style "), F.col("o_orderstatus")).alias("visual_style"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("line "), key.cast("string"))).alias("transcript"),
        (key % 13 == 0).alias("is_op"), (key % 17 == 0).alias("is_ed"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(1 + (key * 7) % 10).cast("int").alias("mad_score"),
        scene.alias("scene_type"),
    )


def lyr(spark, d) -> DataFrame:
    """Every non-blank line of every turn; 40 ms per character, back to back from 1 s."""
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").alias("song_id"), "turn", "role",
        F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "").alias("lines"),
    )
    turns = turns.select(
        "*", F.size("lines").cast("bigint").alias("n"),
        F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, s: a + F.length(s)).alias("chars"),
    )
    turns = running(
        turns, ["song_id"], ["turn"], F.floor(F.col("turn") / 512),
        {"lines_before": ("sum", F.col("n")), "chars_before": ("sum", F.col("chars"))}, inclusive=False,
    )
    rows = turns.select("song_id", "role", "lines", "lines_before", "chars_before", F.posexplode("lines").alias("pos", "text"))
    inside = F.aggregate(F.slice("lines", 1, F.col("pos")), F.lit(0).cast("bigint"), lambda a, s: a + F.length(s))
    start = 1000 + 40 * (F.col("chars_before") + inside)
    return rows.select(
        "song_id", (F.col("lines_before") + F.col("pos")).alias("line_no"), start.alias("start_ms"),
        (start + 40 * F.length("text")).alias("end_ms"), "text", "role",
    )


def song(spark, d) -> DataFrame:
    return lyr(spark, d).groupBy("song_id").agg(F.max("end_ms").alias("duration_ms"))


def beat(spark, d) -> DataFrame:
    return song(spark, d).select(
        "song_id", F.explode(F.expr("sequence(0L, duration_ms, 500L)")).alias("beat_ms")
    )


def slot_video(song_id: Column, line_no: Column) -> Column:
    return song_id + F.floor(line_no / 2).cast("bigint")


def slot(spark, d) -> DataFrame:
    """A slot on every line whose text has no comma."""
    line = F.col("line_no")
    video = slot_video(F.col("song_id"), line)
    return lyr(spark, d).filter(~F.col("text").contains(",")).select(
        "song_id", line.alias("slot_no"), "start_ms", "end_ms",
        video.alias("video_id"), video_path(video).alias("video_path"),
        (F.col("start_ms") + 3000 + (line % 3) * 30 + (F.col("song_id") % 5) * 60_000).alias("clip_start_ms"),
        (F.col("end_ms") - F.col("start_ms")).alias("clip_duration_ms"),
        (F.col("role") == "assistant").alias("keep_audio"),
        F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("transcript"),
        F.col("role").alias("speaker"),
        F.when(line % 5 == 4, "cross-fade").otherwise("none").alias("transition"),
        (F.col("role") == "system").alias("dialogue_independent"),
    )


def clip(spark, d) -> DataFrame:
    """Independent dialogue clips: one per slot spoken by the user."""
    line = F.col("slot_no")
    return slot(spark, d).filter(F.col("speaker") == "user").select(
        "song_id", line.alias("clip_no"), (F.col("start_ms") + 200).alias("start_ms"),
        (F.col("end_ms") + 400).alias("end_ms"), "video_id", "video_path",
        (F.col("clip_start_ms") + 100).alias("clip_start_ms"), (F.col("clip_duration_ms") + 200).alias("clip_duration_ms"),
        F.concat(F.lit("say "), line.cast("string")).alias("transcript"),
    )


def ranks(spark, d) -> DataFrame:
    """Per line, a ranked list of five segment ids from the whole range of them; some are unknown."""
    ids = (table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0) + 1000
    from_hash = lambda r: (F.col("song_id") * 7919 + F.col("line_no") * 104729 + r * 15485863) % ids
    return lyr(spark, d).select(
        "song_id", "line_no", F.array(*[from_hash(r) for r in range(5)]).alias("segment_ids")
    )


def cand(spark, d) -> DataFrame:
    """Three ranked candidates per line."""
    line, rank = F.col("line_no"), F.col("rank")
    return lyr(spark, d).select("song_id", "line_no", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank")).select(
        "song_id", "line_no", "rank", (F.col("song_id") + (line * (rank + 2)) % 12).alias("video_id"),
        ((line * 37 + rank * 101) % 120 * 500).alias("t_ms"),
    )


def known_slot(spark, d) -> DataFrame:
    """Slots with the duration of their source, where it is known."""
    return slot(spark, d).join(vid(spark, d).select("video_id", F.col("duration_ms").alias("video_duration_ms")), "video_id", "left")


def vec(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("keyframe_id"), F.col("label").cast("bigint").alias("video_id"),
        (F.col("vec_id") * 500).alias("t_ms"), F.col("embedding").alias("vector"),
    )


def files(spark, d) -> DataFrame:
    """Two library files per document; extension and name form follow its source and language."""
    doc = F.col("doc_id")
    source = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    folder = F.concat(F.lit("/lib/show"), _div(doc, 20), F.when(F.col("lang") == "en", "/subtitles").otherwise(""))
    episode = F.lpad((doc % 20).cast("string"), 2, "0")
    kinds = F.array(*[F.lit(x) for x in [".srt", ".lrc", ".ass", ".chs.ass", ".cht.ass", ".mkv", ".MP4", ".txt"]])
    base = table(spark, d, "documents").select(
        doc.alias("doc_id"), F.col("n_chars").alias("size_bytes"),
        F.array(
            F.concat(F.lit("/lib/show"), _div(doc, 20), F.lit("/Show - "), episode, F.lit(" [v"), doc.cast("string"), F.lit("]"),
                     F.element_at(kinds, 1 + source % 8)),
            F.concat(folder, F.lit("/Show E"), episode, F.lit(" r"), source.cast("string"),
                     F.element_at(kinds, 1 + (source + F.length("lang") + F.length("text").cast("int")) % 8)),
        ).alias("paths"),
    )
    return base.select("doc_id", "size_bytes", F.explode("paths").alias("path"))


def plan_line(spark, d) -> DataFrame:
    """A script-plan line for every turn-ending line, flattened from its section."""
    return lyr(spark, d).filter(F.col("text").contains(".")).select(
        "song_id", F.col("line_no").alias("index"),
        F.when(F.col("role") == "system", "Intro").when(F.col("role") == "user", "Verse").otherwise("Final Chorus").alias("section_name"),
        F.concat(F.lit("mood "), F.col("role")).alias("mood_arc"),
        F.when(F.col("line_no") % 4 == 0, "").otherwise(F.concat(F.lit("shot of "), F.col("role"))).alias("visual_prompt"),
        F.when(F.col("line_no") % 3 == 0, "").when(F.col("line_no") % 3 == 1, "high").otherwise("low").alias("motion_preference"),
        F.concat(F.lit("concept "), F.col("role")).alias("narrative_concept"),
        F.lit("tender").alias("emotional_tone"),
    )
