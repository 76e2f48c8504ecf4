"""Continuous forms of the batch operators, and the batch parts they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuespan.functions.text import progress
from cuespan.functions.timecode import idiv
from cuespan.operators import timeline as TL
from cuespan.operators.segment import SILENCE_MS
from cuespan.session import work_table
from cuespan.sources.library import discover_library
from cuespan.sources.subtitles import SAME_START_MS

LATENESS = "10 minutes"
MOTION_WINDOW = "10 seconds"


# A stream's watermark begins at the epoch, where a time of 0 would count as late.
ORIGIN_MS = 86_400_000


def event_time(df: DataFrame, column: str, name: str = "event_time") -> DataFrame:
    """Media time as a timestamp, counted from a day after the epoch."""
    return df.withColumn(name, F.timestamp_millis(F.col(column) + ORIGIN_MS))


def media_ms(timestamp: Column | str) -> Column:
    return F.unix_millis(timestamp) - ORIGIN_MS


def drop_repeated_cues(stream: DataFrame, *, lateness: str = LATENESS) -> DataFrame:
    """Unbounded cue stream without repeats. A repeat later than the lateness passes."""
    timed = event_time(stream, "start_ms").withColumn("tenth", idiv(F.col("start_ms") + SAME_START_MS // 2, SAME_START_MS))
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["video_id", "tenth", "text"])


def speech_sessions(stream: DataFrame, *, gap_ms: int = SILENCE_MS, lateness: str = LATENESS) -> DataFrame:
    """Runs of speech per video. Sessions that touch are one, so a silence of just ``gap_ms`` does not part them."""
    gap = F.concat((F.col("end_ms") - F.col("start_ms") + gap_ms).cast("string"), F.lit(" milliseconds"))
    timed = event_time(stream, "start_ms").withWatermark("event_time", lateness)
    return timed.groupBy("video_id", F.session_window("event_time", gap)).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("cues")
    )


def closing_row(rows: DataFrame, *times: str, after_ms: int) -> DataFrame:
    """One row of no video, ``after_ms`` after the last of ``times``, so that the watermark passes everything before it; it ends a finite stream."""
    last = rows.agg(F.max(F.greatest(*times) if len(times) > 1 else F.col(times[0])).alias("last")).filter("last IS NOT NULL")
    typed = {"video_id": F.lit(-1), **{t: F.col("last") + after_ms for t in times}}
    return last.select(*(typed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))


def motion_windows(frames: DataFrame, *, window: str = MOTION_WINDOW, lateness: str = LATENESS) -> DataFrame:
    """Count, mean and peak motion per video and window (``window_ms``); works on a stream and on a table."""
    timed = event_time(frames, "t_ms").withWatermark("event_time", lateness)
    counted = timed.groupBy("video_id", F.window("event_time", window)).agg(
        F.count("*").alias("frames"), F.avg("motion_score").alias("mean_motion"), F.max("motion_score").alias("max_motion")
    )
    return counted.select("video_id", media_ms(F.col("window.start")).alias("window_ms"), "frames", "mean_motion", "max_motion")


def latest_progress(lines: DataFrame) -> DataFrame:
    """Newest percentage per job. lines: (job_id, seq, line); also a stream, in update or complete mode."""
    seen = lines.select("job_id", "seq", progress(F.col("line")).alias("p")).filter("p IS NOT NULL")
    return seen.groupBy("job_id").agg(F.max_by(F.struct("seq", "p.*"), "seq").alias("last")).select("job_id", "last.*")


def newest_of(updates: DataFrame, key: str) -> DataFrame:
    """The row of each key from its last batch, of what ``to_snapshots`` has written in update mode."""
    others = [c for c in updates.columns if c not in (key, "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(key, "last.*")


def library_changes(files: DataFrame, registry: DataFrame) -> DataFrame:
    """State of each found video file against the registry: new, changed or known.

    registry: (path, size_bytes) and, where it is kept, ``modified_at``; then a file replaced by one of equal size counts as changed.
    """
    timed = "modified_at" in registry.columns
    known = registry.select("path", F.col("size_bytes").alias("_size"), *([F.col("modified_at").alias("_modified")] if timed else []))
    rows = discover_library(files).join(known, "path", "left")
    other = F.col("_size") != F.col("size_bytes")
    if timed:
        other = other | ~F.col("_modified").eqNullSafe(F.col("modified_at"))
    state = F.when(F.col("_size").isNull(), "new").when(other, "changed").otherwise("known")
    return rows.withColumn("state", state).drop("_size", "_modified")


def index_stream(
    files: DataFrame, read_registry: Callable[[], DataFrame], write_registry: Callable[[DataFrame, int], None],
    on_change: Callable[[DataFrame, int], None], checkpoint: str,
) -> StreamingQuery:
    """Index only unseen or changed files. ``on_change`` gets them (and clears the match cache).

    The writers get the batch id, so a batch run again after a failure can replace its own output.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        found = library_changes(batch, read_registry()).filter("state <> 'known'").persist()
        try:
            if not found.isEmpty():
                on_change(found, batch_id)
                write_registry(found.select("path", "size_bytes"), batch_id)
        finally:
            found.unpersist()

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LISTING = "path string, size_bytes bigint, modified_at timestamp"


def add_listing(files: DataFrame, listings: str) -> None:
    """Append one listing of the library: what ``index_library`` reads. A file source alone would not see that a known path has a new file."""
    files.select("path", F.col("size_bytes").cast("bigint").alias("size_bytes"), F.col("modified_at").cast("timestamp").alias("modified_at")).coalesce(1).write.mode("append").parquet(listings)


def registry_before(found: str, batch_id: int, spark) -> DataFrame:  # noqa: ANN001
    """(path, size_bytes, modified_at) as the batches before ``batch_id`` have left them."""
    folders = [f"{found}/batch={i}" for i in range(batch_id)]
    if not folders:
        return spark.createDataFrame([], LISTING)
    seen = spark.read.option("basePath", found).parquet(*folders).where("state <> 'known'")
    return newest_of(seen.select("path", "size_bytes", "modified_at", "batch"), "path")


def index_library(
    spark, listings: str, out: str, indexed: Callable[[], DataFrame], *, work: Callable[[DataFrame, int], None] | None = None,  # noqa: ANN001
) -> StreamingQuery:
    """Follow the listings of a library: which files are new, replaced or known, and what indexing has to do for each.

    Every batch writes ``out/found/batch=n``: path, size_bytes, modified_at, state and ``todo`` (full for new and replaced files, else
    what ``indexed()``, (path, state) of :func:`index_state`, says), and, if a file is new or replaced, ``out/cleared/batch=n``: from then
    on matches that were cached before are void (``valid_matches``). A batch sees what earlier batches have written and replaces
    its own output, so that one run again after a failure changes nothing. ``work`` gets what is to be done, with the batch id.
    """
    found = f"{out}/found"

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        newest = batch.groupBy("path").agg(F.max_by(F.struct("size_bytes", "modified_at"), "modified_at").alias("_f")).select("path", "_f.*")
        rows = library_changes(newest, registry_before(found, batch_id, session))
        todo = F.when(F.col("state") != "known", "full").otherwise(F.coalesce("_todo", F.lit("full")))
        rows = rows.join(indexed().select("path", F.col("state").alias("_todo")), "path", "left").withColumn("todo", todo).drop("_todo")
        rows.write.mode("overwrite").parquet(f"{found}/batch={batch_id}")
        done = session.read.parquet(f"{found}/batch={batch_id}")
        fresh = done.where("state <> 'known'").agg(F.count("*").alias("files")).where("files > 0")
        fresh.write.mode("overwrite").parquet(f"{out}/cleared/batch={batch_id}")
        if work is not None:
            work(done.where("todo <> 'skip'"), batch_id)

    source = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(listings)
    return source.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()


def valid_matches(cache: DataFrame, cleared: DataFrame) -> DataFrame:
    """Cached matches (with the ``batch`` they were made after) that no change of the library has made void since."""
    last = cleared.where("files > 0").agg(F.max("batch")).first()[0]
    return cache if last is None else cache.where(F.col("batch") >= last)


def active_stream(
    ticks: DataFrame, lines: DataFrame, slots: DataFrame, clips: DataFrame, out: str, checkpoint: str
) -> StreamingQuery:
    """Each batch of playhead ticks with what is active then; one folder per batch, safe to run again.

    The timeline is cut into time blocks and written once, before the first batch; batches only look up their own ticks.
    """
    spans = work_table(TL.active_answers(lines, slots, clips))

    def step(batch: DataFrame, batch_id: int) -> None:
        TL.active_among(batch, spans).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append mode into Parquet, everything available, then stop."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def to_snapshots(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """What each batch puts out, under its batch id: in complete mode the whole result, in update mode the keys that changed."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
