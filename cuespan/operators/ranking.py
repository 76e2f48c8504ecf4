"""Exact top-k of a pool per prompt, page by page.

Prompts and pool are both packed into pages and written. A task reads some pages of either side, pairs them (Spark's Cartesian
product, which moves no rows between tasks), scores a pair of pages tile by tile with numpy and keeps the k best of each prompt,
so neither side is ever held whole and no prompt-item pairs are emitted. The k best per task then meet in a ranked window.
Pairs grow with the square of the tables, rows that are shuffled and written do not.

Where a score is an inner product, tiles are scored in single precision first; what may be among the k best, by a bound of the
rounding error, is scored again in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespan.operators.match import CANDIDATES
from cuespan.session import work_table

#: Prompts that a scorer sees at a time, and that bounds are taken for together.
PROMPTS_PER_BLOCK = 1024
#: Rows of one page, and bytes that it holds at most; pages of one file.
PROMPTS_PER_PAGE, ITEMS_PER_PAGE, PAGE_BYTES, PAGES_PER_FILE = 32768, 16384, 16 << 20, 1
#: Items that a scorer sees at a time where all pairs are worked out: a matrix of scores has at most 1024 x 8192 cells.
ITEMS_PER_CALL = 8192
#: Bytes of the pool that one task pairs with its prompts, and parts of the pool that are made if there are pages enough.
PART_BYTES, LEAST_PARTS = 64 << 20, 4
#: Prompts and items of a tile; the first tiles of a page are smaller, until thresholds are known.
TILE_PROMPTS, FIRST_ITEMS, TILE_ITEMS = 512, 256, 1024
#: A tile of which more than one pair in so many may be among the best is scored whole.
SPARSE = 32
SCALE = 1_000_000
#: The score in millionths where there is none yet.
MISSING = -(2**62)

# The blend of the semantic score: weight of the spoken text, and how motion is rewarded.
TRANSCRIPT_WEIGHT = 0.3
MOTION_PENALTY = 0.3
MOTION_TARGETS = {"low": 0.0, "medium": 0.5, "high": 1.0}

Scorer = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def matrix(column: pd.Series) -> np.ndarray:
    """Stack a column of vectors; a missing vector is the zero vector, of no width if all are missing."""
    rows = [v for v in column if v is not None]
    widths = {len(v) for v in rows} or {0}
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(widths)}")
    out = np.zeros((len(column), widths.pop()))
    if rows:
        out[[v is not None for v in column]] = np.concatenate(rows).reshape(len(rows), -1)
    return out


class Products:
    """A scorer whose scores are inner products of the prompts' ``vector`` with a vector per item; it is worked out faster than others."""

    def vectors(self, prompts: pd.DataFrame, items: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of prompts, and the vectors of the items for these; every prompt comes once."""
        raise NotImplementedError

    def __call__(self, prompts: pd.DataFrame, items: pd.DataFrame) -> np.ndarray:
        out, asked = np.zeros((len(prompts), len(items))), matrix(prompts["vector"])
        for rows, theirs in self.vectors(prompts, items):
            if asked.shape[1] and theirs.shape[1]:
                out[rows] = asked[rows] @ theirs.T
        return out


def _best(micros: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per prompt, the ids and scores of the k highest scores, lower ids first on a tie. ``ids`` ascend."""
    n = len(ids)
    # One distinct whole number per cell: the score first, then the place in id order.
    place = micros * n
    place += np.arange(n - 1, -1, -1)
    k = min(k, n)
    top = np.argpartition(place, n - k, axis=1)[:, n - k:]
    return ids[top], np.take_along_axis(micros, top, axis=1)


class _Held:
    """The k best found so far for each prompt of a page, best first. ``floor``: millionths that the k best of a prompt reach."""

    def __init__(self, prompts: pd.DataFrame, scorer: Scorer, k: int, size: int, floor: np.ndarray | None = None) -> None:
        self.prompts, self.scorer, self.k, self.size = prompts, scorer, k, size
        self.top = np.full((len(prompts), k), MISSING)
        self.ids: np.ndarray | None = None
        self.floor = np.full(len(prompts), MISSING) if floor is None else floor
        self.vectors = matrix(prompts["vector"]) if isinstance(scorer, Products) else None

    def add(self, items: pd.DataFrame, item_id: str, chosen: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        """Score ``items``; ``chosen`` has the places of prompts and of items that are paired, all with all if None."""
        ids = items[item_id].to_numpy()
        if self.ids is None:
            self.ids = np.full(self.top.shape, ids[0], dtype=ids.dtype)
        chosen = [(np.arange(len(self.prompts)), np.arange(len(items)))] if chosen is None else chosen
        if self.vectors is None:
            for rows, places in chosen:
                places = places[np.argsort(ids[places], kind="stable")]
                for first in range(0, len(rows), self.size):
                    own = rows[first : first + self.size]
                    for at in range(0, len(places), ITEMS_PER_CALL):
                        part = places[at : at + ITEMS_PER_CALL]
                        self._whole(own, ids[part], np.asarray(self.scorer(self.prompts.iloc[own], items.iloc[part]), dtype=np.float64))
            return
        for kind, theirs in self.scorer.vectors(self.prompts, items):
            theirs = theirs if theirs.shape[1] else np.zeros((len(items), self.vectors.shape[1]))
            for rows, places in chosen:
                rows = rows if len(kind) == len(self.prompts) else np.intersect1d(rows, kind, assume_unique=True)
                if len(rows):
                    self._products(rows, ids if len(places) == len(ids) else ids[places], theirs if len(places) == len(ids) else theirs[places])

    def _whole(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        # What is no number comes last.
        best, micros = _best(np.rint(np.fmax(scores * SCALE, -1e15)).astype(np.int64), ids, self.k)
        self._take(np.repeat(rows, best.shape[1]), best.ravel(), micros.ravel())

    def _products(self, rows: np.ndarray, ids: np.ndarray, theirs: np.ndarray) -> None:
        ours = self.vectors[rows] if self.vectors.shape[1] else np.zeros((len(rows), theirs.shape[1]))
        longest = np.sqrt((theirs**2).sum(axis=1)).max() if len(theirs) else 0.0
        product = np.sqrt((ours**2).sum(axis=1)) * longest
        # The most that the sum of so many products in single precision, of rounded factors, is off.
        slack = product * ((theirs.shape[1] + 8) * 2.0**-24) + 1e-30
        narrow = bool((product < 1e30).all() and longest < 1e30)  # else too large for single precision, or no number
        with np.errstate(over="ignore", invalid="ignore"):
            ours32, theirs32 = ours.astype(np.float32), theirs.astype(np.float32)
        scores = np.empty(TILE_PROMPTS * TILE_ITEMS, np.float32)
        marks = np.zeros(TILE_PROMPTS * TILE_ITEMS, bool)
        first, step = 0, FIRST_ITEMS
        while first < len(ids):
            part = slice(first, min(first + step, len(ids)))
            n, good, across = part.stop - part.start, [], np.ascontiguousarray(theirs32[part].T)
            for at in range(0, len(rows), TILE_PROMPTS):
                own = rows[at : at + TILE_PROMPTS]
                tile = slice(at, at + len(own))
                least = np.maximum(self.top[own, -1], self.floor[own])
                found = None
                if narrow and least.min() > MISSING:
                    found = self._marked(ours32[tile], across, (least - 0.5) / SCALE - slack[tile], scores, marks)
                if found is None or len(found) > len(own) * n // SPARSE:
                    order = np.argsort(ids[part], kind="stable") + first
                    self._whole(own, ids[order], ours[tile] @ theirs[order].T)
                elif len(found):
                    by, of = np.divmod(found, n)
                    micros = np.rint(np.einsum("ij,ij->i", ours[at + by], theirs[first + of]) * SCALE).astype(np.int64)
                    reach = micros >= least[by]
                    good.append((own[by[reach]], ids[first + of[reach]], micros[reach]))
            if good:
                self._take(*(np.concatenate(x) for x in zip(*good, strict=True)))
            first, step = part.stop, min(2 * step, TILE_ITEMS)

    @staticmethod
    def _marked(ours: np.ndarray, theirs: np.ndarray, least: np.ndarray, scores: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Places of the pairs that may reach ``least``, row by row; ``scores`` and ``marks`` are room to work in."""
        shape, count = (len(ours), theirs.shape[1]), len(ours) * theirs.shape[1]
        out = np.matmul(ours, theirs, out=scores[:count].reshape(shape))
        with np.errstate(over="ignore"):
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        np.greater_equal(out, least[:, None], out=marks[:count].reshape(shape))
        padded = -(-count // 8) * 8
        marks[count:padded] = False
        # Eight marks are looked at together; nearly all are off.
        eights = np.flatnonzero(marks[:padded].view(np.uint64))
        which, bit = np.nonzero(marks[:padded].reshape(-1, 8)[eights])
        return eights[which] * 8 + bit

    def _take(self, rows: np.ndarray, ids: np.ndarray, micros: np.ndarray) -> None:
        """Let items found (prompt's place, id, score) in among the k best."""
        if not len(rows):
            return
        counts = np.bincount(rows, minlength=len(self.top))
        hit = np.flatnonzero(counts)
        counts = counts[hit] + self.k
        rows = np.concatenate([np.repeat(hit, self.k), rows])
        ids = np.concatenate([self.ids[hit].ravel(), ids])
        micros = np.concatenate([self.top[hit].ravel(), micros])
        # Score down, then id up.
        order = np.lexsort((ids, -micros, rows))
        place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept = order[place < self.k].reshape(len(hit), self.k)
        self.ids[hit], self.top[hit] = ids[kept], micros[kept]

    def result(self, item_id: str) -> Iterator[pa.RecordBatch]:
        there = self.top > MISSING
        if there.any():
            asked = np.repeat(self.prompts["prompt_id"].to_numpy(), there.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(self.ids[there]), pa.array(self.top[there])], ["prompt_id", item_id, "score_micros"])


def rank_blocks(
    prompts: DataFrame,
    pool: DataFrame,
    scorer: Scorer,
    *,
    item_id: str,
    k: int = CANDIDATES,
    prompts_per_block: int = PROMPTS_PER_BLOCK,
) -> DataFrame:
    """The k best pool items per prompt: (prompt_id, rank, ``item_id``, score_micros).

    ``scorer(prompt_rows, item_rows)`` gives one score per pair, as a matrix; it may depend on all columns but the items' ids.
    Scores are compared in whole millionths. ``prompts`` needs ``prompt_id``.
    """
    # Each side is read by many tasks, so both are written.
    items = _written(_lowest(pool, item_id, k).mapInArrow(_pack(ITEMS_PER_PAGE), "items binary, bytes bigint"))
    asked = _written(prompts.repartition("prompt_id").mapInArrow(_pack(PROMPTS_PER_PAGE, "prompts"), "prompts binary, bytes bigint"), "asked")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, held in _pairs(batches, scorer, k, prompts_per_block):
            if batch is None:
                yield from held.result(item_id)
            else:
                held.add(_frame(batch.column("items"), at), item_id)

    pairs = asked.select("asked", "prompts").hint("shuffle_replicate_nl").crossJoin(_parts(items).select("items"))
    return _ranked(pairs.mapInArrow(score, _found(prompts, pool, item_id)), item_id, k)


def _lowest(pool: DataFrame, item_id: str, k: int) -> DataFrame:
    """The pool without rows of which k others with lower ids are equal in all else: no score ranks them among the k best."""
    alike = [c for c in pool.columns if c != item_id]
    hashed = pool.withColumn("_hash", F.xxhash64(*alike))
    w = Window.partitionBy("_hash", *alike).orderBy(item_id)
    return hashed.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k).select(*pool.columns)


def _written(pages: DataFrame, number: str | None = None) -> DataFrame:
    return work_table(pages if number is None else pages.withColumn(number, F.monotonically_increasing_id()), rows_per_file=PAGES_PER_FILE)


def _parts(items: DataFrame) -> DataFrame:
    """``items`` in few partitions of bounded size, so that a task sees many of them for its prompts."""
    size = items.agg(F.sum("bytes")).first()[0] or 0
    return items.coalesce(max(LEAST_PARTS, math.ceil(size / PART_BYTES)))


def _found(prompts: DataFrame, pool: DataFrame, item_id: str) -> str:
    return f"prompt_id {dict(prompts.dtypes)['prompt_id']}, {item_id} {dict(pool.dtypes)[item_id]}, score_micros bigint"


def _ranked(scored: DataFrame, item_id: str, k: int) -> DataFrame:
    """The k best per prompt of what the tasks have found."""
    w = Window.partitionBy("prompt_id").orderBy(F.desc("score_micros"), item_id)
    # Filtered on the bare row number, which lets Spark keep only k rows per prompt before the shuffle.
    best = scored.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= k)
    return best.withColumn("rank", F.col("_place") - 1).drop("_place")


def _pairs(batches: Iterator[pa.RecordBatch], scorer: Scorer, k: int, size: int, floor: Callable | None = None) -> Iterator[tuple]:
    """Each pair of pages (batch, row, the best of the prompts' page), and (None, None, best) after the last of a page of prompts."""
    held = number = None
    for batch in batches:
        for at, asked in enumerate(batch.column("asked").to_pylist()):
            # A task pairs one page of prompts with all of its pages of items in turn.
            if held is None or asked != number:
                if held is not None:
                    yield None, None, held
                held, number = _Held(_frame(batch.column("prompts"), at), scorer, k, size, floor and floor(batch, at)), asked
            yield batch, at, held
    if held is not None:
        yield None, None, held


def _frame(pages: pa.Array, at: int) -> pd.DataFrame:
    """The rows of one page."""
    return pa.ipc.open_stream(pages[at].as_buffer()).read_all().to_pandas()


def _page(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _sliced(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A partition's rows in batches of ``most`` (fewer, if they are wide); the last ones share what is left."""
    held, size = None, most
    whole = lambda table: table.combine_chunks().to_batches()[0]
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        size = max(1, min(most, PAGE_BYTES * held.num_rows // max(1, held.nbytes)))
        while held.num_rows >= 2 * size:
            yield whole(held.slice(0, size))
            held = held.slice(size)
    if held is not None and held.num_rows:
        even = math.ceil(held.num_rows / math.ceil(held.num_rows / size))
        for first in range(0, held.num_rows, even):
            yield whole(held.slice(first, even))


def _pack(most: int, name: str = "items") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as pages of at most ``most``, in Arrow's stream format."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sliced(batches, most):
            page = _page(rows)
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.binary()), pa.array([len(page)], pa.int64())], [name, "bytes"])

    return pack


def motion_factor(preference: pd.Series, motion: pd.Series) -> np.ndarray:
    level = np.minimum(motion.to_numpy(dtype=np.float64), 10.0) / 10.0
    wanted = preference.map(MOTION_TARGETS).to_numpy(dtype=np.float64)
    factor = 1.0 - MOTION_PENALTY * np.abs(level[None, :] - wanted[:, None])
    return np.where(np.isnan(wanted)[:, None], 1.0, factor)


class SemanticScorer(Products):
    """Visual similarity times the motion factor, plus the weighted similarity of the spoken text."""

    def __init__(self, weight: float) -> None:
        self.weight = weight

    def vectors(self, prompts: pd.DataFrame, items: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per motion that is asked for, the prompts that ask for it, and seen and spoken vectors of the items in one."""
        seen, heard = matrix(items["vector"]), matrix(items["cue_vector"])
        width = max(seen.shape[1], heard.shape[1])
        seen, heard = (x if x.shape[1] else np.zeros((len(items), width)) for x in (seen, heard))
        motions = prompts["motion"].where(prompts["motion"].isin(MOTION_TARGETS), None)
        for _, rows in motions.reset_index(drop=True).groupby(motions.fillna("").to_numpy()):
            yield rows.index.to_numpy(), motion_factor(rows.iloc[:1], items["motion_score"])[0][:, None] * seen + self.weight * heard


def semantic_scorer(weight: float = TRANSCRIPT_WEIGHT) -> Scorer:
    return SemanticScorer(weight)


class DotScorer(Products):
    """The inner product of the vectors."""

    def vectors(self, prompts: pd.DataFrame, items: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.arange(len(prompts)), matrix(items["vector"])


dot_scorer = DotScorer()


def semantic_topk(prompts: DataFrame, keyframes: DataFrame, *, k: int = CANDIDATES, weight: float = TRANSCRIPT_WEIGHT) -> DataFrame:
    """Top k keyframes per prompt by the blended score.

    prompts: (prompt_id, vector, motion); keyframes: (keyframe_id, vector, motion_score,
    cue_vector or null).
    """
    slim = keyframes.select("keyframe_id", "vector", "motion_score", "cue_vector")
    return rank_blocks(prompts.select("prompt_id", "vector", "motion"), slim, semantic_scorer(weight), item_id="keyframe_id", k=k)


#: Items that a block holds, and vectors that blocks are formed around: a bounded sample of the pool.
ITEMS_PER_BLOCK, PIVOTS = 2048, 64
#: Blocks whose scores give a prompt its first threshold, and slack for rounding to millionths.
SEEDS, SLACK = 2, 2e-6
#: Summaries of blocks that one task looks at together.
PAGE = 1024


class Ball:
    """Bounds of inner products with vectors that lie around a centre."""

    def __init__(self, columns: tuple[str, ...] = ("vector",)) -> None:
        self.columns = columns

    def summary(self, items: pd.DataFrame, width: int) -> list[float]:
        """Centre and radius of each vector column of a block."""
        out: list[float] = []
        for column in self.columns:
            rows = matrix(items[column])
            rows = rows if rows.shape[1] else np.zeros((len(rows), width))
            centre = rows.mean(axis=0)
            out += [*centre, float(np.sqrt(((rows - centre) ** 2).sum(axis=1)).max())]
        return out

    def inner(self, prompts: pd.DataFrame, summaries: np.ndarray) -> list[np.ndarray]:
        """Per column, the most that an inner product of a prompt with a block's vector can be."""
        asked, each = matrix(prompts["vector"]), summaries.shape[1] // len(self.columns)
        lengths = np.sqrt((asked**2).sum(axis=1))[:, None]
        parts = [summaries[:, i * each : (i + 1) * each] for i in range(len(self.columns))]
        return [asked @ part[:, :-1].T + lengths * part[None, :, -1] for part in parts]

    def upper(self, prompts: pd.DataFrame, summaries: np.ndarray) -> np.ndarray:
        return self.inner(prompts, summaries)[0]


class SemanticBall(Ball):
    """Bounds of the blended score: motion takes off up to ``MOTION_PENALTY`` of what is seen, and adds to what is negative."""

    def __init__(self, weight: float = TRANSCRIPT_WEIGHT) -> None:
        super().__init__(("vector", "cue_vector"))
        self.weight = weight

    def upper(self, prompts: pd.DataFrame, summaries: np.ndarray) -> np.ndarray:
        seen, heard = self.inner(prompts, summaries)
        return np.maximum(seen, (1 - MOTION_PENALTY) * seen) + self.weight * heard


class Ranked(NamedTuple):
    """best: the rows of :func:`rank_blocks`. scored: the pairs of blocks (asked, block) whose scores are worked out, of ``pairs`` pairs in all."""

    best: DataFrame
    scored: DataFrame
    pairs: int


#: A block is numbered by its page and its place on it; a page has fewer blocks than this.
PLACES = 1 << 16


def _clustered(rows: DataFrame, pivots: np.ndarray, order: str, size: int, most: int, name: str, page: str, ball: Ball | None) -> DataFrame:
    """Pages of blocks of at most ``size`` rows that are nearest to the same pivot, written: ``page`` (a number), ``name`` (the rows), bytes, sizes, summaries."""
    width = pivots.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("vector").to_pandas())
            near = (vectors @ pivots.T).argmax(axis=1) if vectors.shape[1] == width else np.zeros(len(vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int64))], [*batch.schema.names, "_pivot"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, most):
            near, kept = batch.column("_pivot").to_numpy(), batch.select(batch.schema.names[:-1])
            ends = [*(np.flatnonzero(np.diff(near)) + 1), len(near)]
            starts = [x for a, b in zip([0, *ends[:-1]], ends, strict=True) for x in range(a, b, size)]
            sizes = np.diff([*starts, len(near)])
            blocks = [ball.summary(kept.slice(a, n).to_pandas(), width) for a, n in zip(starts, sizes, strict=True)] if ball else []
            data = _page(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array([data], pa.binary()), pa.array([len(data)], pa.int64()), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.list_(pa.float64())))],
                [name, "bytes", "sizes", "summaries"],
            )

    # A pivot that very many rows are nearest to is dealt over several partitions.
    placed = rows.mapInArrow(assign, f"{_ddl(rows)}, _pivot bigint").repartitionByRange("_pivot", order).sortWithinPartitions("_pivot", order)
    return _written(placed.mapInArrow(pack, f"{name} binary, bytes bigint, sizes array<bigint>, summaries array<array<double>>"), page)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)


def _edges(sizes: pa.Scalar) -> np.ndarray:
    """Where the blocks of a page begin, and its end."""
    return np.concatenate([[0], np.cumsum(sizes.values.to_numpy())])


def _least(listed: pa.Scalar) -> np.ndarray:
    """The highest threshold of each prompt, of those that tasks have found."""
    return np.max(np.stack([x.values.to_numpy() for x in listed]), axis=0)


def rank_bounded(
    prompts: DataFrame, pool: DataFrame, scorer: Scorer, ball: Ball, *, item_id: str, k: int = CANDIDATES,
    items_per_block: int = ITEMS_PER_BLOCK, prompts_per_block: int = PROMPTS_PER_BLOCK,
) -> Ranked:
    """The rows of :func:`rank_blocks`, without scoring blocks that cannot hold any of the k best.

    Blocks are formed of vectors near the same pivot, each with its centres and radii. The most promising blocks of a block of prompts
    are scored first; their k-th scores are thresholds. A pair of blocks is scored only if some prompt's bound reaches its threshold.
    Blocks are written once, many to a page, and pages are read by the tasks that pair them: neither prompts nor the pool's rows are
    shuffled per pair. ``prompts`` and ``pool`` need a column ``vector``; the result is exact.
    """
    pool = work_table(pool)  # read for the pivots, for the ranges and for the blocks
    sample = pool.where(F.col("vector").isNotNull()).orderBy(F.xxhash64(item_id), item_id).limit(PIVOTS).select("vector").collect()
    pivots = np.array([row["vector"] for row in sample], dtype=np.float64).reshape(len(sample), -1) if sample else np.zeros((1, 1))
    items = _clustered(pool, pivots, item_id, items_per_block, ITEMS_PER_PAGE, "items", "page", ball)
    asked = _clustered(prompts, pivots, "prompt_id", prompts_per_block, PROMPTS_PER_PAGE, "prompts", "asked", None).select("asked", "prompts", "sizes")
    count, left = (pages.agg(F.sum(F.size("sizes"))).first()[0] or 0 for pages in (items, asked))
    group = F.pmod(F.xxhash64("page"), F.lit(max(1, math.ceil(count / PAGE))))
    listed = work_table(items.groupBy(group.alias("group")).agg(F.collect_list(F.struct("page", "summaries")).alias("listed")).select("listed"))

    def bounds(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """Per block of prompts of a row: its place, its rows, the numbers of the blocks listed, and bounds of their scores."""
        pages = batch.column("listed")[at].as_py()
        numbers = np.concatenate([x["page"] * PLACES + np.arange(len(x["summaries"])) for x in pages])
        summaries, edges, left = np.array([y for x in pages for y in x["summaries"]], dtype=np.float64), _edges(batch.column("sizes")[at]), _frame(batch.column("prompts"), at)
        for part, (first, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            yield part, slice(first, end), numbers, ball.upper(left.iloc[first:end], summaries)

    def promise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, number in enumerate(batch.column("asked").to_pylist()):
                for part, _, numbers, most in bounds(batch, at):
                    total = most.sum(axis=0)
                    top = np.argsort(-total, kind="stable")[:SEEDS]
                    yield pa.RecordBatch.from_pydict({"asked": [number] * len(top), "part": [part] * len(top), "block": numbers[top], "promise": total[top]})

    first = asked.hint("shuffle_replicate_nl").crossJoin(listed).mapInArrow(promise, "asked bigint, part bigint, block bigint, promise double")
    best_first = Window.partitionBy("asked", "part").orderBy(F.desc("promise"), "block")
    seeds = first.withColumn("_place", F.row_number().over(best_first)).where(F.col("_place") <= SEEDS)
    page = F.shiftright("block", int(math.log2(PLACES)))
    seeds = seeds.groupBy("asked").agg(F.collect_list("part").alias("parts"), F.collect_list("block").alias("blocks"), F.collect_set(page).alias("pages"))
    sown = work_table(asked.join(seeds, "asked"))

    def chosen(edges: np.ndarray, blocks: np.ndarray, asked_edges: np.ndarray, needed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Places of prompts and items of the ``needed`` pairs of blocks; None for all."""
        if needed.all():
            return None
        at = np.arange(edges[-1])
        return [(np.arange(a, b), at[np.repeat(wanted, blocks)]) for a, b, wanted in zip(asked_edges[:-1], asked_edges[1:], needed, strict=True) if wanted.any()]

    def threshold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None
        for batch, at, held in _pairs(batches, scorer, k, prompts_per_block):
            if batch is None:
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([held.top[:, -1]], pa.list_(pa.int64()))], ["asked", "least"])
                continue
            number, edges, asked_edges = batch.column("asked")[at].as_py(), _edges(batch.column("item_sizes")[at]), _edges(batch.column("sizes")[at])
            needed = np.zeros((len(asked_edges) - 1, len(edges) - 1), bool)
            for part, block in zip(batch.column("parts")[at].as_py(), batch.column("blocks")[at].as_py(), strict=True):
                if block // PLACES == batch.column("page")[at].as_py():
                    needed[part, block % PLACES] = True
            held.add(_frame(batch.column("items"), at), item_id, chosen(edges, np.diff(edges), asked_edges, needed))

    paged = _parts(items).select("page", "items", F.col("sizes").alias("item_sizes"), "summaries")
    pairs = sown.hint("shuffle_replicate_nl").join(paged.drop("summaries"), F.array_contains("pages", F.col("page")))
    least = pairs.mapInArrow(threshold, "asked bigint, least array<bigint>").groupBy("asked").agg(F.collect_list("least").alias("least"))
    held = work_table(asked.join(least, "asked"))

    def reaches(most: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return (most + SLACK >= np.where(wanted > MISSING, wanted / SCALE, -np.inf)[:, None]).any(axis=0)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, number in enumerate(batch.column("asked").to_pylist()):
                wanted = _least(batch.column("least")[at])
                for part, rows, numbers, most in bounds(batch, at):
                    numbers = numbers[reaches(most, wanted[rows])]
                    yield pa.RecordBatch.from_pydict({"asked": np.full(len(numbers), number * PLACES + part), "block": numbers})

    scored = held.hint("shuffle_replicate_nl").crossJoin(listed).mapInArrow(kept, "asked bigint, block bigint")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, best in _pairs(batches, scorer, k, prompts_per_block, lambda batch, at: _least(batch.column("least")[at])):
            if batch is None:
                yield from best.result(item_id)
                continue
            edges, asked_edges = _edges(batch.column("item_sizes")[at]), _edges(batch.column("sizes")[at])
            summaries = np.array(batch.column("summaries")[at].as_py(), dtype=np.float64)
            needed = np.stack([reaches(ball.upper(best.prompts.iloc[a:b], summaries), best.floor[a:b]) for a, b in zip(asked_edges[:-1], asked_edges[1:], strict=True)])
            if needed.any():
                best.add(_frame(batch.column("items"), at), item_id, chosen(edges, np.diff(edges), asked_edges, needed))

    both = held.hint("shuffle_replicate_nl").crossJoin(paged)
    return Ranked(_ranked(both.mapInArrow(score, _found(prompts, pool, item_id)), item_id, k), scored, count * left)


def semantic_topk_bounded(prompts: DataFrame, keyframes: DataFrame, *, k: int = CANDIDATES, weight: float = TRANSCRIPT_WEIGHT, **sizes: int) -> Ranked:
    """:func:`semantic_topk` by bounds: worth it where pictures come in kinds."""
    slim = keyframes.select("keyframe_id", "vector", "motion_score", "cue_vector")
    return rank_bounded(prompts.select("prompt_id", "vector", "motion"), slim, semantic_scorer(weight), SemanticBall(weight), item_id="keyframe_id", k=k, **sizes)
