"""Interval, overlap, as-of and nearest joins.

All of them join on (key, time bucket) or scan (key, time chunk), so a single hot
video or song spreads over as many tasks as it has buckets. Both sides are dealt (``dealt``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.operators.scans import dealt, running
from cuespan.session import work_table

BUCKET_MS = 10_000
CHUNK_MS = 600_000


def _bucket(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def _renamed_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.withColumnRenamed(k, f"_r_{k}")
    return df


def points_in_spans(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    at: Column,
    low: Column,
    high: Column,
    condition: Column,
    how: str = "inner",
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Join each point to the spans of its key that satisfy ``condition``.

    A span is copied to every bucket that [low, high] touches and a point lives in one
    bucket, so each pair appears once. Apart from the keys, column names must differ.
    ``condition`` must imply low <= at <= high.
    """
    left = points.withColumn("_bucket", _bucket(at, bucket_ms))
    first, last = _bucket(low, bucket_ms), _bucket(high, bucket_ms)
    right = _renamed_keys(
        spans.withColumn("_r_bucket", F.explode(F.sequence(first, F.greatest(first, last)))), keys
    )
    on = (F.col("_bucket") == F.col("_r_bucket")) & condition
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return dealt(left).join(dealt(right), on, how).drop("_bucket", "_r_bucket", *[f"_r_{k}" for k in keys])


def spans_over_points(
    spans: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    low: Column,
    high: Column,
    at: Column,
    condition: Column,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Inner form of :func:`points_in_spans` that keeps the span's columns first."""
    joined = points_in_spans(points, spans, keys, at, low, high, condition, "inner", bucket_ms)
    rest = [c for c in points.columns if c not in keys]
    return joined.select(*spans.columns, *rest)


def overlapping(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    condition: Column,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Inner join of spans that share time; a pair is kept only in its first common bucket."""
    l0, l1 = (_bucket(c, bucket_ms) for c in left_span)
    r0, r1 = (_bucket(c, bucket_ms) for c in right_span)
    a = left.withColumn("_l_first", l0).withColumn("_bucket", F.explode(F.sequence(l0, F.greatest(l0, l1))))
    b = right.withColumn("_r_first", r0).withColumn("_r_bucket", F.explode(F.sequence(r0, F.greatest(r0, r1))))
    b = _renamed_keys(b, keys)
    on = (
        (F.col("_bucket") == F.col("_r_bucket"))
        & (F.col("_bucket") == F.greatest("_l_first", "_r_first"))
        & condition
    )
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return dealt(a).join(dealt(b), on, "inner").drop(
        "_bucket", "_r_bucket", "_l_first", "_r_first", *[f"_r_{k}" for k in keys]
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    *,
    tie: Column,
    name: str = "hit",
    forward: bool = False,
    strict: bool = False,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Left as-of join: the nearest earlier (or later) right row per left row.

    Right rows are first reduced to one per (key, time), the lowest ``tie``; left rows
    to their distinct times. A chunk therefore never holds more than its milliseconds.
    """
    best = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(
        F.min_by(F.struct(F.col(right_time), *[F.col(c) for c in payload if c != right_time]), tie).alias(name)
    )
    times = left.select(*keys, F.col(left_time).alias("_t")).distinct()
    # At equal times a right row counts when it is scanned before the left row.
    right_side = 1 if strict != forward else 0
    both = best.withColumn("_side", F.lit(right_side)).unionByName(
        times.withColumn("_side", F.lit(1 - right_side)), allowMissingColumns=True
    )
    scanned = running(
        both.withColumnRenamed(name, "_own"), keys, ["_t", "_side"], _bucket(F.col("_t"), chunk_ms),
        {name: ("last", F.col("_own"))}, reverse=forward,
    )
    found = scanned.filter(F.col("_side") == 1 - right_side).select(*keys, F.col("_t").alias(left_time), name)
    return left.join(dealt(found), [*keys, left_time], "left")


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    *,
    tie: Column,
    tie_field: str,
    name: str = "hit",
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Two-sided as-of join on |right - left|; equal distances go to the lower ``tie_field``."""
    fields = [right_time, *[c for c in payload if c != right_time]]
    best = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(
        F.min_by(F.struct(*fields), tie).alias("_own")
    )
    times = left.select(*keys, F.col(left_time).alias("_t")).distinct().withColumn("_ask", F.lit(True))
    both = best.join(dealt(times), [*keys, "_t"], "full_outer")
    chunk = _bucket(F.col("_t"), chunk_ms)
    nearby = ("last", F.col("_own"))
    scanned = running(both, keys, ["_t"], chunk, {"_back": nearby}, backward={"_ahead": nearby})
    back, ahead, t = F.col("_back"), F.col("_ahead"), F.col("_t")
    back_gap = t - back[right_time]
    ahead_gap = ahead[right_time] - t
    use_back = ahead.isNull() | (back_gap < ahead_gap) | (
        (back_gap == ahead_gap) & (back[tie_field] <= ahead[tie_field])
    )
    found = scanned.filter("_ask").select(
        *keys, t.alias(left_time), F.when(back.isNotNull() & use_back, back).otherwise(ahead).alias(name)
    )
    return left.join(dealt(found), [*keys, left_time], "left")


#: Whole buckets in a row are taken together by this number, on each of so many levels: 10 s, 160 s, 43 min, 11 h.
BLOCK_FAN, BLOCK_LEVELS = 16, 4

#: Spans, the columns of their start and end, columns that order them, columns to return.
Kind = tuple[DataFrame, str, str, Sequence[str], Sequence[str]]


def _down(value: str, width: int) -> str:
    return f"((({value}) - pmod({value}, {width}L)) div {width}L)"


def _whole_blocks(first: str, stop: str) -> str:
    """SQL array of (level, block) that make up the buckets [first, stop): on each level but the uppermost fewer than two times ``BLOCK_FAN``."""
    out = []
    for level in range(BLOCK_LEVELS):
        size = BLOCK_FAN**level
        a, b = _down(f"{first} + {size - 1}", size), _down(stop, size)
        above_a, above_b = _down(f"{first} + {size * BLOCK_FAN - 1}", size * BLOCK_FAN), _down(stop, size * BLOCK_FAN)
        run = lambda x, y: f"IF({x} < {y}, sequence({x}, {y} - 1), slice(array(0L), 1, 0))"
        blocks = run(a, b)
        if level + 1 < BLOCK_LEVELS:
            blocks = f"IF({above_a} > {above_b}, {blocks}, concat({run(a, f'{BLOCK_FAN} * {above_a}')}, {run(f'{BLOCK_FAN} * {above_b}', b)}))"
        out.append(f"transform({blocks}, b -> struct({level} AS level, b AS block))")
    return f"concat({', '.join(out)})"


def answers(kinds: Mapping[str, Kind], keys: Sequence[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """What spans answer to points (:func:`first_at`), by ``keys``, ``level`` and ``block``: it does not depend on the points."""
    rows = None
    for number, (spans, low, stop, order, fields) in enumerate(kinds.values()):
        own = spans.select(*keys, F.col(low).cast("bigint").alias("_low"), F.col(stop).cast("bigint").alias("_stop"), F.struct(*order).alias(f"_order{number}"), F.struct(*fields).alias(f"_span{number}"))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    first, last = _down(f"_low + {bucket_ms - 1}", bucket_ms), _down("_stop", bucket_ms)
    # A bucket that is covered in part stands as level -1, with the span's times; a span within one bucket has one such part.
    part = f"filter(array_distinct(array({_down('_low', bucket_ms)}, {_down('_stop - 1', bucket_ms)})), b -> b < {first} OR b >= {last})"
    cells = f"concat(transform({part}, b -> struct(-1 AS level, b AS block)), IF({first} < {last}, {_whole_blocks(first, last)}, array()))"
    rows = rows.where("_low < _stop").withColumn("_at", F.explode(F.expr(cells)))
    every = range(len(kinds))
    best = [F.min_by(F.struct(f"_order{i}", f"_span{i}"), f"_order{i}").alias(f"_best{i}") for i in every]
    times = [F.when(F.col("_at.level") < 0, F.col(c)).alias(c) for c in ("_low", "_stop")]
    return rows.groupBy(*keys, "_at.level", "_at.block", *times).agg(*best).select(*keys, "level", "block", "_low", "_stop", *(f"_best{i}.*" for i in every))


def questions(points: DataFrame, keys: Sequence[str], at: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Where each distinct point looks: its bucket, and its block on every level."""
    looks = [f"struct(-1 AS level, {_down('_t', bucket_ms)} AS block)", *(f"struct({level} AS level, {_down('_t', bucket_ms * BLOCK_FAN**level)} AS block)" for level in range(BLOCK_LEVELS))]
    asked = points.select(*keys, F.col(at).cast("bigint").alias("_t")).distinct()
    return asked.withColumn("_at", F.explode(F.expr(f"array({', '.join(looks)})"))).select(*keys, "_t", "_at.*")


def first_of(points: DataFrame, spans: DataFrame, names: Sequence[str], keys: Sequence[str], at: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """:func:`first_at` with the spans' ``answers`` at hand (read twice), for many sets of points.

    What the blocks above a bucket answer is found once per bucket that has points, and stands beside the bucket's parts;
    a distinct point is dealt by its bucket and meets both there.
    """
    every, begin = range(len(names)), F.expr(f"{_down(f'CAST(`{at}` AS BIGINT)', bucket_ms)} * {bucket_ms}L").alias("_begin")
    asked = points.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("_n")).select("*", begin)
    looks = questions(points.select(*keys, begin), keys, "_begin", bucket_ms).where("level >= 0").withColumnRenamed("_t", "_begin")
    whole = dealt(looks).join(dealt(spans.where("level >= 0").drop("_low", "_stop")), [*keys, "level", "block"])
    best = [F.min_by(F.struct(f"_order{i}", f"_span{i}"), f"_order{i}").alias(f"_best{i}") for i in every]
    whole = whole.groupBy(*keys, "_begin").agg(*best).select(*keys, "_begin", *(f"_best{i}.*" for i in every))
    parts = spans.where("level < 0").withColumn("_begin", F.col("block") * bucket_ms).drop("level", "block")
    parts = _renamed_keys(parts.unionByName(whole, allowMissingColumns=True), [*keys, "_begin"])
    on = F.expr(f"_low IS NULL OR _low <= CAST(`{at}` AS BIGINT) AND CAST(`{at}` AS BIGINT) < _stop")
    for k in [*keys, "_begin"]:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    hits = dealt(asked).join(dealt(parts), on, "left")
    found = hits.groupBy(*keys, "_begin", at, "_n").agg(*(F.min_by(f"_span{i}", f"_order{i}").alias(name) for i, name in enumerate(names)))
    if sorted(points.columns) == sorted([*keys, at]):
        return found.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).select(*points.columns, *names)
    return points.join(dealt(found.drop("_begin", "_n")), [*keys, at], "left")


def first_at(points: DataFrame, kinds: Mapping[str, Kind], keys: Sequence[str], at: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``points`` with a struct per kind: ``fields`` of its first span by ``order`` with start <= ``at`` < end (null without one).

    A span is cut into its whole buckets, taken together in blocks, and the one or two buckets that it covers in part. Blocks (and
    parts of equal times) keep the first span of each kind, before anything is joined; a bucket looks at its block on each level, and a
    point at what its bucket has found and at the spans that begin or end there. So long and nested spans are neither copied to every
    bucket nor paired with every point.
    """
    return first_of(points, work_table(answers(kinds, keys, bucket_ms)), list(kinds), keys, at, bucket_ms)
