"""Ordered scans that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts every row of a key in one task. Here the
ordered rows of a key are cut into chunks (a time grid, or a range of line numbers);
the window runs per (key, chunk), and the effect of the earlier chunks comes from one
pre-aggregated row per chunk. The chunk rows can be scanned the same way again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_FAN = 4096

Scan = tuple[str, Column]


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that deals both sides by key, at every size.

    Rows made by ``explode`` count as one each in Spark's estimate, also when it plans anew between stages: a table of
    beats is taken for its table of songs, and would go whole through the driver as a broadcast.
    """
    return rows.hint("merge")


def _window_value(kind: str, expr: Column, w) -> Column:
    if kind == "sum":
        return F.sum(expr).over(w)
    if kind == "max":
        return F.max(expr).over(w)
    if kind == "last":
        return F.last(expr, ignorenulls=True).over(w)
    raise ValueError(f"unknown scan kind {kind!r}")


def _chunk_total(kind: str, expr: Column, order: Sequence[str], reverse: bool) -> Column:
    if kind == "sum":
        return F.sum(expr)
    if kind == "max":
        return F.max(expr)
    position = F.when(expr.isNotNull(), F.struct(*order))
    return F.min_by(expr, position) if reverse else F.max_by(expr, position)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    scans: Mapping[str, Scan],
    *,
    inclusive: bool = True,
    reverse: bool = False,
    backward: Mapping[str, Scan] | None = None,
    levels: int = 1,
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``last`` (last non-null) per key along ``order``.

    ``chunk`` must not decrease along ``order``; keys must not be null. ``reverse``
    scans from the end, so ``last`` with ``inclusive=False`` is lag, and lead in reverse.
    ``backward`` are further scans, against the direction of ``scans``, over the same
    exchange of rows and the same totals.
    """
    mark = f"_chunk{levels}"
    rows = df.withColumn(mark, chunk)
    every = {n: (k, e, reverse) for n, (k, e) in scans.items()} | {n: (k, e, not reverse) for n, (k, e) in (backward or {}).items()}

    def window(back: bool):  # noqa: ANN202
        ordering = [F.col(c).desc() if back else F.col(c).asc() for c in order]
        return Window.partitionBy(*keys, mark).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    local = rows.select("*", *[_window_value(k, e, window(back)).alias(f"_in_{n}") for n, (k, e, back) in every.items()])
    totals = rows.groupBy(*keys, mark).agg(*[_chunk_total(k, e, order, back).alias(f"_tot_{n}") for n, (k, e, back) in every.items()])
    carried = {f"_pre_{n}": (k, F.col(f"_tot_{n}"), back) for n, (k, _, back) in every.items()}
    if levels > 1:
        part = lambda way: {n: (k, e) for n, (k, e, back) in carried.items() if back == way}
        totals = running(
            totals, keys, [mark], F.floor(F.col(mark) / CHUNK_FAN), part(reverse), backward=part(not reverse),
            inclusive=False, reverse=reverse, levels=levels - 1,
        )
    else:
        def before(back: bool):  # noqa: ANN202
            direction = F.col(mark).desc() if back else F.col(mark).asc()
            return Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)

        totals = totals.select("*", *[_window_value(k, e, before(back)).alias(n) for n, (k, e, back) in carried.items()])
    totals = totals.select(*keys, mark, *carried)
    joined = local.join(dealt(totals), [*keys, mark], "left")
    return joined.select(
        *df.columns,
        *[_combine(k, F.col(f"_in_{n}"), F.col(f"_pre_{n}")).alias(n) for n, (k, _, _) in every.items()],
    )


def lag(df, keys, order, chunk, columns: Sequence[str], name: str = "prev", levels: int = 1) -> DataFrame:
    """The previous row's ``columns`` as struct ``name`` (null on the first row)."""
    scans = {name: ("last", F.struct(*columns))}
    return running(df, keys, order, chunk, scans, inclusive=False, levels=levels)


def lead(df, keys, order, chunk, columns: Sequence[str], name: str = "next", levels: int = 1) -> DataFrame:
    """The next row's ``columns`` as struct ``name`` (null on the last row)."""
    scans = {name: ("last", F.struct(*columns))}
    return running(df, keys, order, chunk, scans, inclusive=False, reverse=True, levels=levels)


def numbered(df, keys, order, chunk, name: str, levels: int = 1) -> DataFrame:
    """Zero-based row number per key."""
    return running(df, keys, order, chunk, {name: ("sum", F.lit(1).cast("bigint"))}, inclusive=False, levels=levels)


#: Bits that the digits of a whole number are shifted by, the highest first.
DIGITS = (48, 32, 16, 0)


def positions(rows: DataFrame, order: Sequence[str], chunk: Column) -> DataFrame:
    """Zero-based position in a total order, without sorting everything in one task.

    The first column must be a whole number. Its values get their offsets from counts, and
    the rows of one value are numbered in chunks along the other columns.
    """
    first = order[0]
    counts = rows.groupBy(first).agg(F.count("*").alias("_n"))
    # What lies before a value is found digit by digit, 16 bits each: no window holds more than 65,536 rows.
    prefix = [F.shiftright(F.col(first).cast("bigint"), shift).alias(f"_p{shift}") for shift in DIGITS]
    cells, before = counts.select(first, "_n", *prefix), None
    for level, shift in enumerate(DIGITS):
        above = [f"_p{DIGITS[level - 1]}"] if level else []
        sums = cells.groupBy(*above, f"_p{shift}").agg(F.sum("_n").alias("_m"))
        smaller = Window.partitionBy(*above).orderBy(f"_p{shift}")
        sums = sums.select(*above, f"_p{shift}", (F.sum("_m").over(smaller) - F.col("_m")).alias("_before"))
        if before is not None:
            sums = sums.join(before, above).select(f"_p{shift}", (F.col("_before") + F.col("_offset")).alias("_before"))
        before = sums.select(f"_p{shift}", F.col("_before").alias("_offset"))
    offsets = before.select(F.col("_p0").cast(rows.schema[first].dataType).alias(first), "_offset")
    numbered_rows = numbered(rows, [first], list(order[1:]), chunk, "_at")
    return numbered_rows.join(offsets, first).withColumn("position", F.col("_at") + F.col("_offset")).drop("_at", "_offset")
