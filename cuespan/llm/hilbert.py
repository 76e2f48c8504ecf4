"""Sharding along a Hilbert curve through metadata dimensions, with built-in functions only.

Dimensions are quantised to ``bits`` bits each: numbers by equal-depth limits (approximate percentiles), text by
hash. A cell of that grid has a place on the Hilbert curve, so that neighbours on the curve differ by one step in one
dimension, and a run of the curve is a compact box in every dimension: readers skip the shards whose quantised limits
exclude what they look for (``shard_limits``).

No task ever sees a whole hot cell: rows of a cell are dealt over ``SALTS`` sub-cells by a hash of the row, ranks are
taken within (cell, sub-cell), and what lies before a sub-cell comes from counts. Counts are summed per cell and then
over cells, of which the grid bounds the number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespan.llm.common import named
from cuespan.session import work_table

SALTS = 1024


def limits(docs: DataFrame, columns: list[str], bits: int) -> dict[str, list[float]]:
    """Equal-depth limits of numeric columns: at most ``2**bits - 1`` numbers each, from one scan of these columns alone."""
    if not columns:
        return {}
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = docs.agg(*(F.percentile_approx(named(c).cast("double"), shares, 10_000).alias(f"c{i}") for i, c in enumerate(columns))).first()
    return {c: list(row[f"c{i}"] or []) for i, c in enumerate(columns)}


def quantised(docs: DataFrame, dimensions: list[str], bits: int) -> list[Column]:
    """One column per dimension, 0 to ``2**bits - 1``; null is 0."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    numeric = [d for d in dimensions if isinstance(kinds[d], T.NumericType)]
    cuts = limits(docs, numeric, bits)
    out = []
    for d in dimensions:
        if d in cuts:
            steps = [F.when(named(d) > cut, 1).otherwise(0) for cut in cuts[d]]
            level = reduce(lambda a, b: a + b, steps, F.lit(0))
        else:
            level = F.shiftrightunsigned(F.xxhash64(named(d).cast("string")), 64 - bits).cast("int")
        out.append(F.when(named(d).isNull(), 0).otherwise(level))
    return out


def cell_key(levels: list[Column], bits: int) -> Column:
    """The quantised values side by side, the first in the highest bits."""
    return reduce(lambda key, level: F.shiftleft(key, bits) + level.cast("long"), levels, F.lit(0).cast("long"))


def curve_index(cells: DataFrame, key: str, dimensions: int, bits: int) -> DataFrame:
    """``cells`` with ``curve``, the place of the cell on the Hilbert curve.

    From the highest bit down, a dimension whose bit is set flips the lower bits of the first one, and one whose bit is
    clear swaps its lower bits with the first one's. The bits of all dimensions side by side, highest first, are then
    the Gray code of the index.
    """
    mask = (1 << bits) - 1
    start = ", ".join(f"shiftright({key}, {bits * (dimensions - 1 - i)}) & {mask}" for i in range(dimensions))
    steps = ", ".join(f"named_struct('top', {1 << bit}L, 'i', {i})" for bit in range(bits - 1, 0, -1) for i in range(dimensions))
    turned = f"""aggregate(array({steps}), array({start}), (axes, s) -> transform(axes, (x, j) ->
        CASE WHEN (axes[s.i] & s.top) <> 0 THEN IF(j = 0, x ^ (s.top - 1), x)
             WHEN j = 0 OR j = s.i THEN x ^ ((axes[0] ^ axes[s.i]) & (s.top - 1)) ELSE x END))"""
    word = f"""aggregate(sequence(0, {dimensions * bits - 1}), 0L, (w, p) ->
        shiftleft(w, 1) | (shiftright(axes[p % {dimensions}], {bits - 1} - p div {dimensions}) & 1))"""
    shifts = ", ".join(str(1 << i) for i in range((dimensions * bits - 1).bit_length()))
    index = f"transform(array({turned}), axes -> aggregate(array({shifts}), {word}, (w, s) -> w ^ shiftright(w, s)))[0]"
    return cells.withColumn("curve", F.expr(index))


def hilbert_shards(
    docs: DataFrame, dimensions: list[str], shards: int = 16, bits: int = 4, law: str = "rows", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's shard: runs of the Hilbert order, equal in rows (``law="rows"``) or bytes (``law="bytes"``).

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 (0 for null), law, shard, slot (place within the shard,
    from 0), grown_shard (null under both laws), curve and the quantised ``q0``, ``q1`` ... of the dimensions. With
    ``rows``, counts of shards differ by one at most; with ``bytes``, a row goes to the shard that holds the middle of its
    bytes. Null dimensions are level 0; equal rows follow each other in any order; an empty table gives no rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    levels = quantised(docs, dimensions, bits)
    names = [f"q{i}" for i in range(len(dimensions))]
    size = F.coalesce(F.octet_length(named(text_col)), F.lit(0)).cast("long") + 1
    base = docs.select(
        named(id_col).alias("doc_id"), *(level.alias(n) for level, n in zip(levels, names)), size.alias("size"),
        F.crc32(F.coalesce(named(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    base = base.withColumn("_cell", cell_key([F.col(n) for n in names], bits))
    base = work_table(base.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SALTS)).cast("int")))
    weight = F.lit(1).cast("long") if law == "rows" else F.col("size")
    parts = work_table(base.groupBy("_cell", "_salt").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n")))
    cells = curve_index(parts.groupBy("_cell").agg(F.sum("_w").alias("_cw"), F.sum("_n").alias("_cn")), "_cell", len(dimensions), bits)
    # Coarse runs of the curve first, cells within a run next: no window holds more than the root of the grid's size.
    coarse = F.shiftright(F.col("curve"), len(dimensions) * bits // 2)
    cells = cells.withColumn("_run", coarse)
    runs = cells.groupBy("_run").agg(F.sum("_cw").alias("_rw"), F.sum("_cn").alias("_rn"))
    upto = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select(
        "_run", (F.sum("_rw").over(upto) - F.col("_rw")).alias("_rw0"), (F.sum("_rn").over(upto) - F.col("_rn")).alias("_rn0"),
        F.sum("_rw").over(everything).alias("_total"), F.sum("_rn").over(everything).alias("_rows"),
    )
    within = Window.partitionBy("_run").orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select("_run", "_cell", "curve", (F.sum("_cw").over(within) - F.col("_cw")).alias("_cw0"), (F.sum("_cn").over(within) - F.col("_cn")).alias("_cn0"))
    cells = cells.join(runs, "_run").select("_cell", "curve", (F.col("_cw0") + F.col("_rw0")).alias("_cw0"), (F.col("_cn0") + F.col("_rn0")).alias("_cn0"), "_total", "_rows")
    cells = work_table(cells)
    inner = Window.partitionBy("_cell").orderBy("_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select("_cell", "_salt", (F.sum("_w").over(inner) - F.col("_w")).alias("_w0"), (F.sum("_n").over(inner) - F.col("_n")).alias("_n0"))
    parts = parts.join(cells, "_cell").select("_cell", "_salt", "curve", (F.col("_w0") + F.col("_cw0")).alias("_w0"), (F.col("_n0") + F.col("_cn0")).alias("_n0"), "_total", "_rows")
    order = Window.partitionBy("_cell", "_salt").orderBy(F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    ranked = base.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("_before", F.col("_rank") if law == "rows" else F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = ranked.join(parts, ["_cell", "_salt"])
    weight_at = F.col("_w0") + F.col("_before")
    if law == "rows":
        shard = F.expr(f"((_w0 + _before) * {shards}) div _total")
        # The first rank of shard s is the least r with r * shards >= s * rows.
        first = F.expr(f"(shard * _rows + {shards - 1}) div {shards}")
        out = placed.withColumn("shard", shard.cast("int")).withColumn("slot", weight_at - first)
        return _laid_out(out, law, names)
    middle = F.expr(f"((2 * (_w0 + _before) + size) * {shards}) div (2 * _total)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int")).withColumn("_at", F.col("_n0") + F.col("_rank"))
    placed = work_table(placed)
    firsts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return _laid_out(placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_at") - F.col("_first")), law, names)


def _laid_out(placed: DataFrame, law: str, names: list[str]) -> DataFrame:
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve", *names,
    )


def shard_limits(placed: DataFrame) -> DataFrame:
    """Least and greatest quantised value of each dimension per shard: what a reader needs to skip files."""
    names = [c for c in placed.columns if c[:1] == "q" and c[1:].isdigit()]
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *(f(n).alias(f"{n}_{f.__name__}") for n in names for f in (F.min, F.max)))
