"""Keyed caches and child tables as snapshots: each call returns the next state of the table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.session import work_table


def cache_hits(prompts: DataFrame, cache: DataFrame, key: str = "query_hash") -> DataFrame:
    return prompts.join(cache, key)


def cache_misses(prompts: DataFrame, cache: DataFrame, key: str = "query_hash") -> DataFrame:
    return prompts.join(cache.select(key), key, "left_anti")


def match_results(prompts: DataFrame, cache: DataFrame, computed: DataFrame, key: str = "query_hash") -> DataFrame:
    """Payload per prompt from the cache, or computed for the misses; ``from_cache`` tells which."""
    hits = cache_hits(prompts, cache.select(key, "payload"), key).withColumn("from_cache", F.lit(True))
    fresh = cache_misses(prompts, cache, key).join(computed.select(key, "payload").dropDuplicates([key]), key)
    return hits.unionByName(fresh.withColumn("from_cache", F.lit(False)))


def cache_upsert(cache: DataFrame, rows: DataFrame, key: str = "query_hash", *, keep_empty: bool = True) -> DataFrame:
    """Insert or replace by key; the newest of equal keys wins. Batch results are stored only when not empty."""
    if not keep_empty:
        rows = rows.filter(F.coalesce("payload", F.lit("")) != "")
    others = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("created_at", "payload")).alias("row")).select(key, "row.*")
    return cache.join(newest.select(key), key, "left_anti").unionByName(newest)


def cache_clear(cache: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The emptied cache when anything in the library changed (else the cache), and the count of dropped rows."""
    kept = cache.filter(~changed.exists())
    dropped = cache.filter(changed.exists()).agg(F.count("*").alias("cleared"))
    return kept, dropped


def cascade_delete(video_ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given videos."""
    gone = video_ids.select("video_id").distinct()
    return {name: df.join(gone, "video_id", "left_anti") for name, df in tables.items()}


def replace_children(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """All rows of the videos in ``fresh`` replaced by its rows."""
    return table.join(fresh.select("video_id").distinct(), "video_id", "left_anti").unionByName(fresh)


def write_children(fresh: DataFrame, path: str, *, buckets: int = 256) -> None:
    """Replace the rows of the videos in ``fresh`` in a table of ``buckets`` folders, by a hash of the video.

    Only the folders that hold these videos are read and written again; the number of folders and files does not grow
    with the videos. The rest of such a folder is set aside in the shared folder before it is replaced.
    """
    spark = fresh.sparkSession
    fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int"))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        touched = fresh.select("bucket").distinct()
        old = spark.read.schema(fresh.schema).parquet(path).join(touched, "bucket", "left_semi")
        fresh = work_table(replace_children(old, fresh).select(*fresh.columns))
    fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


#: Pieces, and what stands before, between and after them.
Digest = tuple[Column, str, str, str]


def streamed_md5(rows: DataFrame, key: str, order: str, digests: Mapping[str, Digest]) -> DataFrame:
    """``key`` and, per name, the md5 of the key's pieces in order, run together; null pieces are left out.

    The rows of a key come to one task sorted and are fed to the digest batch by batch: no list or text of a whole key is made.
    """
    names = list(digests)
    frames = [(before.encode(), between.encode(), after.encode()) for _, before, between, after in digests.values()]

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, current, open_ones, begun = None, None, [], []
        done: list[tuple] = []

        def close() -> None:
            if open_ones:
                for digest, (_, _, after) in zip(open_ones, frames):
                    digest.update(after)
                done.append((current, *(digest.hexdigest() for digest in open_ones)))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * (1 + len(names))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.string()) for c in columns[1:])], [key, *names])

        for batch in batches:
            kind = batch.schema.field(key).type
            for own, *pieces in zip(batch.column(key).to_pylist(), *(batch.column(n).to_pylist() for n in names)):
                if not open_ones or own != current:
                    close()
                    current, open_ones, begun = own, [md5(before) for before, _, _ in frames], [False] * len(names)
                for i, piece in enumerate(pieces):
                    if piece is not None:
                        open_ones[i].update((frames[i][1] if begun[i] else b"") + piece.encode())
                        begun[i] = True
            yield batch_of()
        if kind is not None:
            close()
            yield batch_of()

    pieces = [column.alias(name) for name, (column, *_) in digests.items()]
    ordered = rows.select(key, F.col(order).alias("_order"), *pieces).repartition(key).sortWithinPartitions(key, "_order").drop("_order")
    schema = ", ".join([f"{key} {rows.schema[key].dataType.simpleString()}", *(f"{n} string" for n in names)])
    return ordered.mapInArrow(feed, schema)
