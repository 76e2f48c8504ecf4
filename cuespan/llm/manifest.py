"""Merkle manifest of a table: one tree of fan-out 16 per source and one over the sources, kept as a postorder append log.

Leaves are numbered within their source by a range partitioning and counts, so a source of any size spreads over all tasks.
A builder takes an aligned block of ``16 ** LEVELS`` leaves (the rows of a block lie in one task, in order) and appends every node
in the moment it is complete: leaves one by one, the node over 16 of them after the last, and so on. A block is thus one segment of
the log. Where several blocks remain, their tops are the leaves of the next round of builders.

The place of a node needs no index: leaf i has ``i // 16 + i // 256 + ...`` inner nodes before it, and a node of level l is written
l places after the last leaf below it (``leaf_place``, ``node_place``). Proofs read siblings from the log at these places, from the
uppermost round down: what lies above a block is one short row for all of its leaves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.llm.common import only
from cuespan.session import work_table

FAN = 16
#: Levels that one builder completes: blocks of 4,096 leaves.
LEVELS = 3
#: Bytes of a digest in the log.
SIZE = 32
#: The tree over the sources' subroots.
TOP = -1
PATH = "array<struct<place:int,run:binary>>"
PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.binary())]))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(nodes: Iterable[bytes]) -> bytes:
    """The digest over digests, which enter as lowercase hex text."""
    return sha256(b"".join(nodes).hex().encode()).digest()


def depth(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def leaf_place(leaf: int) -> int:
    """Place of a leaf in the log of its tree."""
    place = leaf
    while leaf:
        leaf //= FAN
        place += leaf
    return place


def node_place(level: int, index: int, leaves: int) -> int:
    """Place of the ``index``-th node of a level in the log of a tree of ``leaves`` leaves."""
    return leaf_place(min((index + 1) * FAN**level, leaves) - 1) + level


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of a row: each field as its length in bytes, a colon and its value, or ``-`` for null."""
    return F.unhex(F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256))


def dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in the given order (nulls first, text bytewise) over range partitions; ``part`` and ``at`` ascend along it. Written to the shared folder."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return work_table(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))


def running_before(n: str, keys: str, order: str) -> Column:
    return F.expr(f"sum({n}) OVER (PARTITION BY {keys} ORDER BY {order}) - {n}")


def numbered_leaves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves, trees): ``rows`` (source, doc_id, leaf, other) with ``tree``, ``idx`` in it and ``n``; and source, tree, n.

    What is windowed are counts: one row per source and partition, and one per partition.
    """
    ordered = dealt(rows, ["source", "doc_id", "leaf", "other"])
    cuts = ordered.groupBy("source", "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    cuts = cuts.select("*", running_before("size", "source", "part").alias("before"))
    sources = dealt(cuts.groupBy("source").agg(F.sum("size").alias("n")), ["source"])
    parts = sources.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    parts = parts.select("part", "first", running_before("size", "0", "part").alias("before"))
    trees = sources.join(parts, "part").select("source", (F.col("at") - F.col("first") + F.col("before")).alias("tree"), "n")
    trees = work_table(trees)
    known = trees.withColumnRenamed("source", "of")
    cuts = work_table(cuts.join(known, F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("part").alias("of_part"), "first", "before", "tree", "n"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    leaves = ordered.join(cuts, same).select("tree", (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "n", "doc_id", "leaf", "other")
    return leaves, trees


class Builder:
    """Appends the nodes of one block as they are completed."""

    def __init__(self, tree: int, block: int, n: int, levels: int):
        self.key, self.n, self.levels = (tree, block), n, min(levels, depth(n))
        self.nodes, self.open = [], [[] for _ in range(self.levels + 1)]

    def append(self, node: bytes, level: int = 0) -> None:
        self.nodes.append(node)
        self.open[level].append(node)
        if level < self.levels and len(self.open[level]) == FAN:
            self.complete(level)

    def complete(self, level: int) -> None:
        node, self.open[level] = digest(self.open[level]), []
        self.append(node, level + 1)

    def segment(self) -> tuple[int, int, int, bytes]:
        for level in range(self.levels):
            if self.open[level]:
                self.complete(level)
        return (*self.key, self.n, b"".join(self.nodes))


def segments(leaves: DataFrame, levels: int) -> DataFrame:
    """Log segments (tree, block, n, nodes) of leaves or lower tops (tree, idx, n, digest)."""
    size = FAN**levels

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = None
        for batch in batches:
            done = []
            for tree, idx, n, node in zip(*(batch.column(c).to_pylist() for c in ("tree", "idx", "n", "digest"))):
                if builder is None or builder.key != (tree, idx // size):
                    if builder is not None:
                        done.append(builder.segment())
                    builder = Builder(tree, idx // size, n, levels)
                builder.append(node)
            yield batch_of(done)
        if builder is not None:
            yield batch_of([builder.segment()])

    def batch_of(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["tree", "block", "n", "nodes"])

    block = F.expr(f"idx div {size}")
    rows = leaves.select("tree", "idx", "n", "digest").repartition("tree", block).sortWithinPartitions("tree", "idx")
    return work_table(rows.mapInArrow(task, "tree bigint, block bigint, n bigint, nodes binary"))


def tops() -> Column:
    """The last digest of a segment: its block's top."""
    return F.expr(f"substring(nodes, -{SIZE}, {SIZE})").alias("digest")


def append_log(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The log of all trees, one table of segments per round of builders."""
    size, rounds = FAN**levels, []
    while True:
        rounds.append(segments(leaves, levels))
        more = rounds[-1].where(F.col("n") > size)
        if more.isEmpty():
            return rounds
        leaves = more.select("tree", F.col("block").alias("idx"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), tops())


class Block:
    """A segment read by places: the runs from one of its leaves up to its top, and those above the block."""

    def __init__(self, block: int, n: int, nodes: bytes, path: list[dict] | None, levels: int):
        size = FAN**levels
        self.first, self.leaves, self.nodes = block * size, min(size, n - block * size), nodes
        self.levels, self.upper = min(levels, depth(n)), [(step["place"], step["run"]) for step in path or []]
        self.at, self.tail = -1, []

    def run(self, level: int, index: int) -> bytes:
        """The digests of the run that node ``index`` of a level belongs to."""
        first = index // FAN * FAN
        last = min(first + FAN, -(-self.leaves // FAN**level))
        places = [node_place(level, i, self.leaves) * SIZE for i in range(first, last)]
        return b"".join([self.nodes[p : p + SIZE] for p in places])

    def path(self, idx: int) -> list[tuple[int, bytes]]:
        """(place in the run, run) from the leaf on, upwards to the root."""
        own = idx - self.first
        if not self.levels:
            return self.upper
        if own // FAN != self.at:
            self.at, index = own // FAN, own
            self.tail = []
            for level in range(self.levels):
                self.tail.append((index % FAN, self.run(level, index)))
                index //= FAN
            self.tail += self.upper
        return [(own % FAN, self.tail[0][1]), *self.tail[1:]]


def folded(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that follows from a leaf and the siblings of its path."""
    for place, run in path:
        node = digest((run[: place * SIZE], node, run[(place + 1) * SIZE :]))
    return node


def siblings(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join([run[: place * SIZE] + run[(place + 1) * SIZE :] for place, run in path])


def with_paths(rows: DataFrame, log: DataFrame, paths: DataFrame, levels: int, last: bool) -> DataFrame:
    """Per row (tree, idx, digest, ...) its path to the root; with ``last`` the finished proof of a document instead."""
    size = FAN**levels
    heads = log.join(paths, ["tree", "block"]).select("tree", "block", F.lit(-1).cast("long").alias("idx"), "n", "nodes", "path", "subroot", "root")
    both = heads.unionByName(rows.withColumn("block", F.expr(f"idx div {size}")), allowMissingColumns=True)
    both = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
    id_type = both.schema["doc_id"].dataType.simpleString() if last else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = subroot = root = None
        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "doc_id"}
            out: list[tuple] = []
            taken = []
            for i, idx in enumerate(column["idx"]):
                if idx < 0:
                    block = Block(column["block"][i], column["n"][i], column["nodes"][i], column["path"][i], levels)
                    subroot, root = column["subroot"][i], column["root"][i]
                    continue
                path = block.path(idx)
                if last:
                    node, other = column["digest"][i], column["other"][i]
                    top = folded(other or node, path)
                    taken.append(i)
                    out.append((node.hex(), subroot.hex(), root.hex(), sha256(siblings(path).hex().encode()).hexdigest(), top.hex(), top == root))
                else:
                    out.append((column["tree"][i], idx, [{"place": p, "run": r} for p, r in path], column["digest"][i] if column["tree"][i] == TOP else subroot, root))
            columns = list(zip(*out)) or [()] * (6 if last else 5)
            if last:
                ids = batch.column("doc_id").take(pa.array(taken, pa.int64()))
                arrays = [ids, *(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
            else:
                types = [pa.int64(), pa.int64(), PATH_TYPE, pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["tree", "block", "path", "subroot", "root"])

    if last:
        return both.mapInArrow(read, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return work_table(both.mapInArrow(read, f"tree bigint, block bigint, path {PATH}, subroot binary, root binary"))


def proofs(leaves: DataFrame, rounds: list[DataFrame], above: DataFrame, levels: int, last: bool) -> DataFrame:
    """Paths of all leaves, from the uppermost round down. ``above``: tree, path, subroot, root of each tree's own root."""
    size, lower = FAN**levels, None
    for place in range(len(rounds) - 1, -1, -1):
        log = rounds[place]
        # A tree that ends in this round goes on in the tree over the sources; the others in the round above.
        ended = log.where(F.col("n") <= size).select("tree", F.lit(0).cast("long").alias("block")).join(above, "tree")
        paths = ended if lower is None else ended.unionByName(lower)
        rows = leaves if place == 0 else rounds[place - 1].where(F.col("n") > size).select("tree", F.col("block").alias("idx"), tops())
        rows = rows.drop("n")
        lower = with_paths(rows, log, paths, levels, last and place == 0)
    return lower


class Manifest(NamedTuple):
    """leaves: tree, idx, n, doc_id, digest, other (digest of a tampered row, else null). trees: source, tree, n. log: segments of the
    sources' trees by round; roots: what they end in, as leaves of the tree ``TOP``; top: its segments by round."""

    leaves: DataFrame
    trees: DataFrame
    log: list[DataFrame]
    roots: DataFrame
    top: list[DataFrame]


def manifest(docs: DataFrame, levels: int = LEVELS, tamper: Column | None = None) -> Manifest:
    """The log of a table with the columns of ``documents``.

    ``tamper`` says which rows' texts are put in lower case (A-Z only) before they are held against the log. Unknown ids and sources
    come first in their order; rows of one id are ordered by digest; equal rows are a leaf each. Extra columns do not enter the digests.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    rows = only(docs, **{c: c for c in fields}, text="text")
    tampered = leaf(*map(F.col, fields), F.translate("text", UPPER, UPPER.lower()))
    other = F.when(F.coalesce(F.lit(False) if tamper is None else tamper, F.lit(False)), tampered)
    leaves, trees = numbered_leaves(rows.select("source", "doc_id", leaf(*map(F.col, fields), F.col("text")).alias("leaf"), other.alias("other")))
    leaves = work_table(leaves.withColumnRenamed("leaf", "digest"))
    log = append_log(leaves, levels)
    ends = [part.where(F.col("n") <= FAN**levels).select("tree", tops()) for part in log]
    roots = reduce(DataFrame.unionByName, ends).select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees.count()).cast("long").alias("n"), "digest"
    )
    return Manifest(leaves, trees, log, roots, append_log(roots, levels))


def completion(leaves: int, levels: int) -> Iterator[tuple[int, int]]:
    """(level, index) of a block's nodes in the order of the log."""
    for i in range(leaves):
        yield 0, i
        for level in range(1, levels + 1):
            if (i + 1) % FAN**level and i + 1 < leaves:
                break
            yield level, i // FAN**level


def log_nodes(log: list[DataFrame], trees: DataFrame, levels: int = LEVELS) -> DataFrame:
    """tree, place and digest of every node: the places of a tree have no gaps. ``trees``: tree, n."""
    size = FAN**levels

    def listing(round_no: int):  # noqa: ANN202
        def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree, block, n, total, held in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "total", "nodes"))):
                    places, digests = [], []
                    for i, (level, index) in enumerate(completion(min(size, n - block * size), min(levels, depth(n)))):
                        if level or not round_no:
                            places.append(node_place(round_no * levels + level, block * FAN ** (levels - level) + index, total))
                            digests.append(held[i * SIZE : (i + 1) * SIZE])
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * len(places), pa.int64()), pa.array(places, pa.int64()), pa.array(digests, pa.binary())], ["tree", "place", "digest"])

        return nodes

    totals = trees.select("tree", F.col("n").alias("total"))
    parts = [part.join(totals, "tree").mapInArrow(listing(i), "tree bigint, place bigint, digest binary") for i, part in enumerate(log)]
    return reduce(DataFrame.unionByName, parts)


def postorder_proofs(docs: DataFrame, tamper: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified (``manifest`` has the rules).

    ``folded_root`` is recomputed from the row as it is now and the siblings that the log holds. A row alone in the table is its own
    root, with an empty proof. An empty table gives no rows.
    """
    made = manifest(docs, levels, tamper)
    last = made.top[-1]
    none = F.lit(None)
    root = last.select("tree", none.cast(PATH).alias("path"), none.cast("binary").alias("subroot"), tops().alias("root"))
    above = proofs(made.roots, made.top, root, levels, False).select(F.col("block").alias("tree"), "path", "subroot", "root")
    return proofs(made.leaves, made.log, above, levels, True)
