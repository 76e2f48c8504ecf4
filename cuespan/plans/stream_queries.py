"""The streaming jobs run over the given tables until everything available is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.operators import song as SO
from cuespan.plans import fixtures as X
from cuespan.plans import table_queries, timeline_queries  # noqa: F401  (their SQL is shared)
from cuespan.plans.fixtures_sql import with_tables
from cuespan.plans.registry import ORACLES, query
from cuespan.session import checkpoint_dir
from cuespan.streaming import jobs
from cuespan.streaming.assign import assign_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _work(spark) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _as_stream(spark, rows: DataFrame, work: str) -> DataFrame:
    """A derived table, written out and read back as a stream."""
    rows.write.parquet(f"{work}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{work}/in")


def _finished(q, spark, path: str) -> DataFrame:
    q.awaitTermination()
    return spark.read.parquet(path)


@query("stream_cue_dedup", with_tables("SELECT DISTINCT video_id, (start_ms + 50) // 100 AS tenth, text FROM cue"))
def stream_cue_dedup(spark, d):
    work = _work(spark)
    kept = jobs.drop_repeated_cues(_as_stream(spark, X.cue(spark, d), work)).select("video_id", "tenth", "text")
    return _finished(jobs.to_table(kept, f"{work}/out", f"{work}/state"), spark, f"{work}/out")


@query("stream_sessions", with_tables("""
    SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS cues
    FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > 2500 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_ms, cue_id) AS session_no
          FROM (SELECT *, max(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, cue_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cue))
    GROUP BY video_id, session_no"""))
def stream_sessions(spark, d):
    """All sessions: a closing row moves the watermark past the last ones."""
    work, cues = _work(spark), X.cue(spark, d)
    found = jobs.speech_sessions(_as_stream(spark, cues.union(jobs.closing_row(cues, "start_ms", "end_ms", after_ms=120_000)), work), lateness="5 seconds")
    found = found.select("video_id", "start_ms", "end_ms", "cues")
    return _finished(jobs.to_table(found, f"{work}/out", f"{work}/state"), spark, f"{work}/out")


@query("stream_motion_windows", with_tables("""
    SELECT video_id, (t_ms // 10000) * 10000 AS window_ms, count(*) AS frames, round(avg(motion_score), 6) AS mean_motion, max(motion_score) AS max_motion
    FROM kf GROUP BY video_id, t_ms // 10000"""))
def stream_motion_windows(spark, d):
    """Appended as the watermark passes them, so that state is let go; a closing row ends the last ones."""
    work, kf = _work(spark), X.kf(spark, d)
    counted = jobs.motion_windows(_as_stream(spark, kf.union(jobs.closing_row(kf, "t_ms", after_ms=7_200_000)), work)).select(
        "video_id", "window_ms", "frames", F.round("mean_motion", 6).alias("mean_motion"), "max_motion"
    )
    return _finished(jobs.to_table(counted, f"{work}/out", f"{work}/state"), spark, f"{work}/out")


@query("stream_active_at", ORACLES["active_at"])
def stream_active_at(spark, d):
    work = _work(spark)
    ticks = _as_stream(spark, X.beat(spark, d).withColumnRenamed("beat_ms", "t_ms"), work)
    q = jobs.active_stream(ticks, SO.add_intro(X.lyr(spark, d)), X.slot(spark, d), X.clip(spark, d), f"{work}/out", f"{work}/state")
    return _finished(q, spark, f"{work}/out").drop("batch")


@query("stream_progress", ORACLES["progress_latest"])
def stream_progress(spark, d):
    work = _work(spark)
    latest = jobs.latest_progress(_as_stream(spark, table_queries.log_lines(spark, d), work)).select("job_id", "seq", "percent", "overall")
    jobs.to_snapshots(latest, f"{work}/out", f"{work}/state", "update").awaitTermination()
    return jobs.newest_of(spark.read.parquet(f"{work}/out"), "job_id")


ASSIGN_STEPS = {
    "asked": """
        SELECT c.song_id, c.line_no, any_value(l.end_ms - l.start_ms) AS n, list({'r': c.rank, 'v': c.video_id, 't': c.t_ms} ORDER BY c.rank) AS os
        FROM cand c JOIN lyr l ON l.song_id = c.song_id AND l.line_no = c.line_no GROUP BY c.song_id, c.line_no""",
    "pass": """
        SELECT song_id, -1::BIGINT AS i, []::BIGINT[] AS recent, []::STRUCT(v BIGINT, s BIGINT, e BIGINT)[] AS used,
               NULL::STRUCT(r INTEGER, v BIGINT, t BIGINT) AS o, NULL::INTEGER AS tier
        FROM (SELECT DISTINCT song_id FROM asked)
        UNION ALL
        SELECT song_id, i, list_append(recent, o.v)[-4:], list_append(used, {'v': o.v, 's': greatest(0, o.t), 'e': greatest(0, o.t) + n}), o, tier
        FROM (
          SELECT *, CASE WHEN len(fresh) > 0 THEN fresh[1] WHEN len(clear) > 0 THEN clear[1] ELSE os[1] END AS o,
                 CASE WHEN len(fresh) > 0 THEN 1 WHEN len(clear) > 0 THEN 2 ELSE 3 END AS tier
          FROM (SELECT *, list_filter(clear, lambda c: NOT list_contains(recent, c.v)) AS fresh
            FROM (SELECT p.song_id, p.i + 1 AS i, p.recent, p.used, q.n, q.os,
                         list_filter(q.os, lambda c: len(list_filter(p.used, lambda u: u.v = c.v AND greatest(0, c.t) < u.e AND u.s < greatest(0, c.t) + q.n)) = 0) AS clear
                  FROM pass p JOIN asked q ON q.song_id = p.song_id AND q.line_no = p.i + 1)))""",
}


@query("stream_assign", with_tables(
    "SELECT song_id, i AS line_no, o.r AS rank, o.v AS video_id, greatest(0, o.t) AS clip_start_ms, tier FROM pass WHERE o IS NOT NULL", recursive=True, extra=ASSIGN_STEPS))
def stream_assign(spark, d):
    """Every line's candidates as prompts, chosen in line order with state per song."""
    work = _work(spark)
    offered = X.cand(spark, d).groupBy("song_id", "line_no").agg(
        F.array_sort(F.collect_list(F.struct("rank", "video_id", "t_ms"))).alias("candidates")
    )
    prompts = X.lyr(spark, d).join(offered, ["song_id", "line_no"]).select(
        "song_id", "line_no", (F.col("end_ms") - F.col("start_ms")).alias("length_ms"), "candidates"
    )
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, ROCKSDB)
    try:
        q = jobs.to_table(assign_stream(_as_stream(spark, prompts, work), timed=False), f"{work}/out", f"{work}/state")
        return _finished(q, spark, f"{work}/out")
    finally:
        spark.conf.set(store, before)


LIBRARY_STEPS = {
    "listed": r"SELECT path, min(doc_id) AS doc_id FROM files WHERE regexp_matches(path, '\.(mkv|MP4)$') GROUP BY path",
}


@query("stream_library", with_tables("""
    SELECT 0 AS batch, path, 'new' AS state, 'full' AS todo FROM listed WHERE ends_with(path, '.mkv')
    UNION ALL
    SELECT 1, path, CASE WHEN ends_with(path, '.MP4') THEN 'new' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'known' END,
           CASE WHEN ends_with(path, '.MP4') OR doc_id % 3 = 0 THEN 'full' ELSE coalesce((['skip', 'backfill', 'annotate'])[doc_id % 4 + 1], 'full') END
    FROM listed""", extra=LIBRARY_STEPS))
def stream_library(spark, d):
    """The .mkv files are listed first; in the next listing a third of them are replaced at equal size, and .MP4 files have come."""
    work = _work(spark)
    files = X.files(spark, d).groupBy("path").agg(F.min("doc_id").alias("doc_id"), F.min("size_bytes").alias("size_bytes"))
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    jobs.add_listing(files.where(F.col("path").endswith(".mkv")).withColumn("modified_at", at(1)), f"{work}/listings")
    jobs.add_listing(files.withColumn("modified_at", F.when(F.col("path").endswith(".mkv") & (F.col("doc_id") % 3 == 0), at(2)).otherwise(at(1))), f"{work}/listings")
    states = F.get(F.array(F.lit("skip"), F.lit("backfill"), F.lit("annotate")), (F.col("doc_id") % 4).cast("int"))
    q = jobs.index_library(spark, f"{work}/listings", f"{work}/out", lambda: files.select("path", states.alias("state")))
    return _finished(q, spark, f"{work}/out/found").select(F.col("batch").cast("int").alias("batch"), "path", "state", "todo")
