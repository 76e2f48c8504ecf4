"""Batch scoring with callables the user supplies: embedding, annotation, ranking."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.functions.payload import parsed_annotation, placeholder_annotation, ranked_ids
from cuespan.functions.timecode import idiv
from cuespan.operators.match import BATCH_LINES, drop_opening_ids, fallback_ids
from cuespan.operators.ranking import Scorer, rank_blocks
from cuespan.operators.scans import numbered

# Fixed values of the remote calls.
ATTEMPTS = 3
BACKOFF_BASE = 2.0
HASH_WIDTH = 64

Embedder = Callable[[pd.Series], list[np.ndarray]]


def hashing_embedder() -> Embedder:
    """Counts of words by the first md5 byte; a stand-in for a model, the same everywhere."""

    @lru_cache(1 << 16)
    def place(word: str) -> int:
        return hashlib.md5(word.encode()).digest()[0] % HASH_WIDTH

    def embed(texts: pd.Series) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(HASH_WIDTH)
            for word in (text or "").lower().split(" "):
                if word:
                    v[place(word)] += 1.0
            out.append(v)
        return out

    return embed


def embed_batch(df: DataFrame, column: str, load: Callable[[], Embedder], *, width: int = HASH_WIDTH, name: str = "vector") -> DataFrame:
    """Add an embedding of ``column``. ``load`` runs once per task; a failing batch gives zero vectors."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            try:
                vectors = model(texts)
            except Exception:  # noqa: BLE001 - any model failure means "no embedding"
                vectors = [np.zeros(width)] * len(texts)
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vectors])

    return df.withColumn(name, embed(F.col(column)))


def call_with_retries(fn, row, attempts: int, pause: Callable[[float], None]):
    """The reply, or None after the last attempt; waits 2, 4 ... seconds in between."""
    for attempt in range(1, attempts + 1):
        try:
            return fn(row)
        except Exception:  # noqa: BLE001 - the remote side may fail in any way
            if attempt < attempts:
                pause(BACKOFF_BASE**attempt)
    return None


def annotate_batch(
    segments: DataFrame, annotator: Callable[[dict], str], *, attempts: int = ATTEMPTS, pause: Callable[[float], None] = time.sleep,
    workers: int = 4, done: Accumulator | None = None,
) -> DataFrame:
    """Annotate every segment through ``annotator(row) -> reply``, ``workers`` calls at a time in each task.

    Replies are parsed in Spark. ``answered`` is false where a placeholder stands in. ``done``, an accumulator, counts
    the rows that have been through, for progress.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with ThreadPoolExecutor(workers) as pool:
                replies = list(pool.map(lambda row: call_with_retries(annotator, row, attempts, pause), batch.to_dict("records")))
            if done is not None:
                done.add(len(replies))
            yield pd.DataFrame({"segment_id": batch["segment_id"], "start_ms": batch["start_ms"], "end_ms": batch["end_ms"], "reply": replies})

    replied = segments.mapInPandas(call, "segment_id bigint, start_ms bigint, end_ms bigint, reply string")
    parsed = parsed_annotation(F.col("reply"))
    return replied.select(
        "segment_id", "start_ms", "end_ms",
        F.coalesce(parsed, placeholder_annotation(F.col("start_ms"), F.col("end_ms"))).alias("annotation"),
        parsed.isNotNull().alias("answered"),
    )


def rank_batch(prompts: DataFrame, pool: DataFrame, scorer: Scorer, *, limit: int = 5, prompts_per_call: int = 1024) -> DataFrame:
    """Ranked segment ids per prompt. The scorer sees a block of prompts against a block of the pool."""
    return rank_blocks(prompts, pool, scorer, item_id="segment_id", k=limit, prompts_per_block=prompts_per_call)


def rank_calls(
    prompts: DataFrame, shortlist: DataFrame, segments: DataFrame, allowed: DataFrame, ranker: Callable[[list[dict]], str], *,
    size: int = BATCH_LINES, attempts: int = ATTEMPTS, pause: Callable[[float], None] = time.sleep, workers: int = 4,
) -> DataFrame:
    """Segment ids per line as a model ranks them: (song_id, line_no, segment_ids, answered).

    Lines go to ``ranker`` in calls of ``size``, each with the ids of its shortlist (the exact best of ``rank_batch``, so a
    call is bounded), and the reply maps the place in the call to ids. A line without a list of its own gets the stand-ins. Openings
    are then taken out of the lists of lines that are not ``allowed`` them.
    """
    key = ["song_id", "line_no"]
    placed = numbered(prompts.join(shortlist, key, "left"), ["song_id"], ["line_no"], idiv(F.col("line_no"), 4096), "_n")
    placed = placed.withColumn("batch_no", idiv(F.col("_n"), size))
    asked = F.struct("line_no", "prompt", F.coalesce("segment_ids", F.array().cast("array<bigint>")).alias("segment_ids"))
    calls = placed.groupBy("song_id", "batch_no").agg(F.array_sort(F.collect_list(asked)).alias("asked"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[{"line_no": int(x["line_no"]), "prompt": x["prompt"], "segment_ids": [int(i) for i in x["segment_ids"]]} for x in lines] for lines in batch["asked"]]
            with ThreadPoolExecutor(workers) as pool:
                replies = list(pool.map(lambda lines: call_with_retries(ranker, lines, attempts, pause), rows))
            numbers = [[x["line_no"] for x in lines] for lines in rows]
            yield pd.DataFrame({"song_id": batch["song_id"], "lines": numbers, "reply": replies})

    kind = prompts.schema["song_id"].dataType.simpleString()
    replied = calls.mapInPandas(call, f"song_id {kind}, lines array<bigint>, reply string")
    lists = replied.select("song_id", ranked_ids(F.col("reply")).alias("_lists"), F.posexplode("lines").alias("_at", "line_no"))
    own = F.try_element_at("_lists", F.col("_at").cast("string"))
    # The stand-ins are a handful of ids.
    stand_ins = [row["segment_id"] for row in fallback_ids(segments).orderBy("rank").collect()]
    other = F.array(*map(F.lit, stand_ins)).cast("array<bigint>")
    found = lists.select("song_id", "line_no", F.coalesce(own, other).alias("segment_ids"), own.isNotNull().alias("answered"))
    kept = drop_opening_ids(found.select(*key, "segment_ids"), segments, allowed, key)
    return kept.join(found.select(*key, "answered"), key)
