"""SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints form a binary trie. Pairs of its nodes are gone through together from the root down; a pair
carries the bits by which its paths differ and is dropped once they exceed the budget. Two tries are walked, one with
the halves of the fingerprint swapped, because of at most three differing bits at most one lies in one of the halves:
so within the first half of each trie the budget is one third (rounded down) of the whole, which keeps the number of
node pairs in proportion to the fingerprints.

The upper levels are walked as a table: a fingerprint goes to the node pairs of ``depth`` levels it takes part in, and
node pairs with too many fingerprints are led further down, however deep. Each remaining node pair is one group that a
task walks in numpy. It answers with one link per fingerprint, to the least one that it is connected with inside
the group, never with all pairs; components of these links are found by rounds of star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.llm.common import by_shuffle, in_slices, only, plain_names, text_hash, utf8
from cuespan.session import work_table

BITS = 64
#: Levels a node pair with too many fingerprints is led down at a time.
STEP = 4
#: Node pairs a task looks at together.
CHUNK = 1 << 18


def fingerprint(words: list[bytes], size: int, seed: int) -> int:
    """Bits set in over half of the shingles' hashes; shingles are ``size`` words, or all words where there are fewer."""
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_key`` and ``fp`` (64 bits as a signed long) of every text; null and wordless texts have fingerprint 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            values = [fingerprint(text.lower().split(), size, seed) for text in utf8(batch.column("text"))]
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(np.array(values, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "fp"])

    source = only(docs, doc_id=id_col, text=text_col).withColumn("text_key", text_hash(F.col("text")))
    return source.mapInArrow(task, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key binary, fp bigint")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """Least connected member of each of ``count`` members."""

    def __init__(self, count: int):
        self.root = np.arange(count)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            if not len(low):
                return
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
            a, b = low, high


def walk(left: np.ndarray, right: np.ndarray | None, depth: int, start: int, early: int, budget: int) -> tuple[np.ndarray, Forest]:
    """Links within ``left``, or between ``left`` and ``right``: fingerprints below two nodes at ``depth``, which differ by ``start`` bits.

    ``early`` is the budget of the first half's levels, ``budget`` that of all. Returns the members and their forest.
    """
    own = right is None
    values = np.sort(left) if own else np.concatenate([np.sort(left), np.sort(right)])
    forest = Forest(len(values))
    split = len(values) if own else len(left)
    first = (0, split, 0, split) if own else (0, split, split, len(values))
    stack = [(depth, np.array([[*first, start]], np.int64))]
    while stack:
        level, nodes = stack.pop()
        if len(nodes) > CHUNK:
            half = len(nodes) // 2
            stack += [(level, nodes[:half]), (level, nodes[half:])]
            continue
        a0, a1, b0, b1, bits = nodes.T
        # Small pairs of nodes are compared at once; so is the rest at the last level, where a node is one fingerprint.
        small = ((a1 - a0) * (b1 - b0) <= 16) | (level >= BITS)
        if small.any():
            p0, p1, q0, q1 = a0[small], a1[small], b0[small], b1[small]
            widths = (p1 - p0) * (q1 - q0)
            which = np.repeat(np.arange(len(widths)), widths)
            place = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths)
            u, v = p0[which] + place // (q1 - q0)[which], q0[which] + place % (q1 - q0)[which]
            near = (u != v) & (differing(values[u], values[v]) <= budget)
            forest.link(u[near], v[near])
            nodes = nodes[~small]
            a0, a1, b0, b1, bits = nodes.T
        if not len(nodes):
            continue
        most = early if level < BITS // 2 else budget
        bit = np.uint64(1) << np.uint64(BITS - 1 - level)
        ones = np.concatenate([[0], np.cumsum((values & bit) != 0)])
        cut_a, cut_b = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        children = [
            np.stack([a0, cut_a, b0, cut_b, bits], 1), np.stack([cut_a, a1, cut_b, b1, bits], 1), np.stack([a0, cut_a, cut_b, b1, bits + 1], 1),
            np.stack([cut_a, a1, b0, cut_b, bits + 1], 1)[~same],
        ]
        nodes = np.concatenate(children)
        nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (nodes[:, 4] <= most)]
        if len(nodes):
            stack.append((level + 1, nodes))
    return values, forest


def to_signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def turned(values: np.ndarray, swap: int) -> np.ndarray:
    """The halves swapped, or as they are."""
    return (values << np.uint64(32)) | (values >> np.uint64(32)) if swap else values


def top_bits(fp: Column, count: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - count) if count else F.lit(0).cast("long")


def node_pairs(members: DataFrame, depth: int, early: int) -> DataFrame:
    """Each fingerprint (``v``, turned) in every pair of nodes at ``depth`` it takes part in: its own node, and those that differ in up to ``early`` bits."""
    own = top_bits(F.col("v"), depth)
    masks = [0]
    for _ in range(early):
        masks = sorted({m ^ (1 << i) for m in masks for i in range(depth)} | set(masks))
    table = members.withColumn("own", own).withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))))
    other = F.col("own").bitwiseXOR(F.col("mask"))
    return table.select(
        "swap", F.lit(depth).alias("depth"), F.least("own", other).alias("a"), F.greatest("own", other).alias("b"),
        (F.col("own") > other).alias("right"), F.bit_count("mask").alias("bits"), "v",
    )


def deeper(rows: DataFrame, early: int, budget: int) -> DataFrame:
    """Members of node pairs, ``STEP`` levels further down: in every pair of child nodes that stays within the budget."""
    half = BITS // 2
    depth = F.col("depth") + STEP
    mine = F.shiftrightunsigned(F.expr("shiftleft(v, depth)"), BITS - STEP)
    moved = rows.withColumn("mine", mine).withColumn("flip", F.explode(F.array(*(F.lit(i).cast("long") for i in range(1 << STEP)))))
    moved = moved.withColumn("theirs", F.col("mine").bitwiseXOR(F.col("flip"))).withColumn("total", F.col("bits") + F.bit_count("flip"))
    moved = moved.where(F.col("total") <= F.when(depth <= half, early).otherwise(budget))
    same = F.col("a") == F.col("b")
    right = F.when(same, F.col("mine") > F.col("theirs")).otherwise(F.col("right"))
    child = F.shiftleft(F.when(F.col("right"), F.col("b")).otherwise(F.col("a")), STEP) + F.col("mine")
    partner = F.shiftleft(F.when(F.col("right"), F.col("a")).otherwise(F.col("b")), STEP) + F.col("theirs")
    return moved.select(
        "swap", depth.cast("int").alias("depth"), F.when(right, partner).otherwise(child).alias("a"), F.when(right, child).otherwise(partner).alias("b"),
        right.alias("right"), F.col("total").cast("int").alias("bits"), "v",
    )


def trie_links(prints: DataFrame, budget: int = 3, most: int = 20_000) -> DataFrame:
    """Links (``fp``, ``root``) that connect all fingerprints (column ``fp``, distinct) within ``budget`` bits of each other.

    ``most`` is the number of fingerprints of a node pair that one task takes; with more, the pair is led further down.
    """
    early = budget // 2
    count = prints.count()
    depth = min(16, max(0, int(np.ceil(np.log2(max(1, count / (most / 4)))))))
    swapped = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    members = prints.select(F.explode(F.array(F.struct(F.lit(0).alias("swap"), F.col("fp").alias("v")), F.struct(F.lit(1).alias("swap"), swapped.alias("v")))).alias("m")).select("m.*")
    keys = ["swap", "depth", "a", "b", "bits"]
    rows, ready = work_table(node_pairs(members, depth, early)), []
    while True:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("n_right"))
        # A pair of different nodes with members on one side only has no links.
        sizes = sizes.where((F.col("a") == F.col("b")) | (F.col("n_right").between(1, F.col("n") - 1))).where("n > 1")
        full = work_table(sizes.where((F.col("n") > most) & (F.col("depth") <= BITS - STEP)).select(*keys))
        if full.isEmpty():
            ready.append(rows.join(sizes.select(*keys), keys, "left_semi"))
            break
        ready.append(rows.join(sizes.select(*keys), keys, "left_semi").join(full, keys, "left_anti"))
        rows = work_table(deeper(rows.join(full, keys, "left_semi"), early, budget))

    def links(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        swap, level, a, b, bits = key
        values, right = group["v"].to_numpy(np.int64).view(np.uint64), group["right"].to_numpy(bool)
        found, forest = walk(values, None, level, bits, early, budget) if a == b else walk(values[~right], values[right], level, bits, early, budget)
        other = forest.root != np.arange(len(found))
        found = turned(found, swap)
        return pd.DataFrame({"fp": to_signed(found[other]), "root": to_signed(found[forest.root[other]])})

    parts = [part.groupBy(*keys).applyInPandas(links, "fp bigint, root bigint") for part in ready]
    return reduce(DataFrame.union, parts).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is connected with, for every node of ``links`` (two columns of longs).

    Rounds of large-star and small-star; each is written to the shared folder, and a hot node is only ever aggregated
    or the small side's single row of a join.
    """
    a, b = links.columns
    edges = work_table(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = work_table(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m").where("x != m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        edges = work_table(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def simhash_nodes(
    docs: DataFrame, size: int = 3, budget: int = 3, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): doc_id, text_key and fp of every row; and fp, root (least fingerprint) and component_id (least doc_id) of each distinct one."""
    rows = work_table(fingerprints(docs, size, id_col=id_col, text_col=text_col))
    prints = work_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = work_table(components(trie_links(prints.select("fp"), budget, most)))
    ids = prints.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows, work_table(ids.join(least, "root").select("fp", "root", "component_id"))


def simhash_components(docs: DataFrame, **options: object) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id linked to it, over any number of steps.

    Texts without words have fingerprint zero and link with each other. Rows of one fingerprint are one node, so copies
    cost nothing. Null ids stay null and are never the least; a component of null ids only has a null id. An empty table gives no rows.
    """
    rows, nodes = simhash_nodes(docs, **options)
    return rows.join(nodes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` with one row of each component: the one of the least id (unknown ids last) and, where rows repeat it, any of these."""
    rows, nodes = simhash_nodes(docs, id_col=id_col, text_col=text_col, **options)
    rows = rows.join(nodes, "fp").groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    rows = work_table(rows)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
    first = work_table(first.select("root", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key")))
    mine = (rows["root"] == first["root"]) & rows["doc_id"].eqNullSafe(first["_id"]) & (rows["text_key"] == first["_key"])
    gone = work_table(rows.join(first, mine, "left_anti").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))
    again = work_table(rows.join(first, mine, "left_semi").where("times > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))
    plain, text, doc_id = plain_names(docs, text_col, id_col)
    key = text_hash(F.col(text))
    out = plain.join(by_shuffle(gone), (key == gone["_key"]) & F.col(doc_id).eqNullSafe(gone["_id"]), "left_anti")
    if not again.isEmpty():
        repeated = (key == again["_key"]) & F.col(doc_id).eqNullSafe(again["_id"])
        once = out.join(again, repeated, "left_semi").withColumn("_key", key).dropDuplicates([doc_id, "_key"]).drop("_key")
        out = out.join(again, repeated, "left_anti").unionByName(once)
    return out.toDF(*docs.columns)
