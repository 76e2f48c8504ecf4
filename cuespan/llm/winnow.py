"""Benchmark decontamination by winnowing.

Of every ``span - k + 1`` k-grams in a row the one of least hash is kept, on both sides; so any ``span`` words that a
document shares with a benchmark item hold a k-gram kept on both sides at the same place. Documents' kept k-grams that
pass a bit map of the benchmark's (of fixed size, whatever the benchmark's) are joined to them by hash, and each hit
is extended word by word to both sides: it counts when ``span`` words agree. An item with fewer words is one window of
its own length, whose k-gram is all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.common import by_shuffle, in_slices, only, plain_names, text_hash, utf8
from cuespan.session import work_table

#: Bytes of words: digits, letters in lower case, and all of other scripts; the rest is white space.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bits of the map of the benchmark's k-grams: one megabyte.
MAP_BITS = 23
KEPT = "array<struct<hash: bigint, span: int, left: int, words: array<string>, runs: array<struct<first: int, step: int, count: int>>>>"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def gram_hashes(words: np.ndarray, k: int, span: int) -> np.ndarray:
    """Hash of the k words from each place on; spans of other lengths hash differently."""
    count = max(0, len(words) - k + 1)
    out = np.full(count, span, np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + count]) * FACTOR
        out ^= out >> np.uint64(29)
    return out


def kept_grams(words: np.ndarray, room: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of k-grams that are least in some run of ``span - k + 1``, and all hashes; ``room`` is the number of words up to the text's end."""
    hashes = gram_hashes(words, k, span)
    width = span - k + 1
    count = max(0, len(words) - span + 1)
    least = hashes[:count].copy()
    for j in range(1, width):
        np.minimum(least, hashes[j : j + count], out=least)
    whole = room[:count] >= span
    chosen = np.zeros(len(hashes), bool)
    for j in range(width):
        chosen[j : j + count] |= whole & (hashes[j : j + count] == least)
    return np.flatnonzero(chosen), hashes


def evenly_spaced(places: list[int]) -> list[dict]:
    """Ascending places as runs of equal steps."""
    out: list[dict] = []
    for place in places:
        last = out[-1] if out else None
        if last and (last["count"] == 1 or place == last["first"] + last["step"] * last["count"]):
            last["step"] = place - last["first"] if last["count"] == 1 else last["step"]
            last["count"] += 1
        else:
            out.append({"first": place, "step": 0, "count": 1})
    return out


class Winnower:
    """Kept k-grams of texts, with the words that a window through them can reach; equal ones of a text are one, with all their places."""

    def __init__(self, k: int, span: int):
        self.k, self.span, self.hashes = k, span, WordHashes()

    def run(self, texts: list[bytes], spans: list[int] | None, bits: np.ndarray | None) -> tuple[list[int], list[list[dict]]]:
        """Number of words and kept k-grams of each text. ``spans`` None: each text as a benchmark item, else the spans to look for."""
        if len(self.hashes) > 250_000:
            self.hashes.clear()
        rows = [text.translate(WORD_BYTES).split() for text in texts]
        counts = np.array([len(row) for row in rows], np.int64)
        total = int(counts.sum())
        words = np.fromiter((h for row in rows for h in map(self.hashes.__getitem__, row)), np.uint64, total)
        ends = np.cumsum(counts)
        room = np.repeat(ends, counts) - np.arange(total)
        owner = np.repeat(np.arange(len(rows)), counts)
        found_at: list[dict[tuple, list[int]]] = [{} for _ in rows]
        wanted = sorted({min(int(n), self.span) for n in counts if n} if spans is None else spans)
        for span in wanted:
            k = min(self.k, span) if span == self.span else span
            places, hashes = kept_grams(words, room, k, span)
            found = hashes[places]
            if bits is not None:
                slot = found & np.uint64((1 << MAP_BITS) - 1)
                is_set = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                places, found = places[is_set], found[is_set]
            for place, value in zip(places.tolist(), found.astype(np.int64).tolist()):
                text = int(owner[place])
                row, at = rows[text], place - int(ends[text] - counts[text])
                if spans is None and min(len(row), self.span) != span:
                    continue
                first = max(0, at - (span - k))
                found_at[text].setdefault((value, span, at - first, tuple(row[first : at + span])), []).append(at)
        out = [
            [{"hash": value, "span": span, "left": left, "words": [w.decode("utf-8", "replace") for w in words], "runs": evenly_spaced(places)} for (value, span, left, words), places in own.items()]
            for own in found_at
        ]
        return counts.tolist(), out


def fingerprints(texts: DataFrame, columns: list[str], k: int, span: int, spans: list[int] | None, bits: np.ndarray | None) -> DataFrame:
    """``texts`` (the named columns, then ``text``) as the named columns, ``n_words`` and ``kept``."""
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in columns)
    run = pa.struct([("first", pa.int32()), ("step", pa.int32()), ("count", pa.int32())])
    kept_type = pa.list_(pa.struct([("hash", pa.int64()), ("span", pa.int32()), ("left", pa.int32()), ("words", pa.list_(pa.string())), ("runs", pa.list_(run))]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Winnower(k, span)
        for batch in in_slices(batches):
            counts, kept = mine.run(utf8(batch.column("text")), spans, bits)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(kept, kept_type)], [*columns, "n_words", "kept"])

    return texts.select(*columns, "text").mapInArrow(task, f"{schema}, n_words bigint, kept {KEPT}")


def agreeing(step: str) -> Column:
    """How many words in a row agree beside the k-gram; ``step``: where the i-th lies, from the k-gram's first word on."""
    same = f"get(d.words, d.left + {step}) = get(b.words, b.left + {step})"
    return F.expr(f"aggregate(sequence(0, reach), 0, (n, i) -> IF(i > 0 AND n = i - 1 AND {same}, i, n))")


def contamination(
    docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n_words) of all documents, and hits (text_key, item, lo, hi): every word of [lo, hi) lies in ``span`` words
    that agree with the item. A text and an item that repeat a word are compared by their different k-grams, not place by place.

    Texts are compared as words: A-Z in lower case, digits, letters and everything beyond ASCII. Null and wordless texts
    hit nothing, on either side. An unknown item id counts as the empty one, and items of one id as one item.
    Equal texts are looked up once. Both tables are written to the shared folder.
    """
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("text"))
    items = fingerprints(items, ["item"], k, span, None, None)
    items = items.select("item", F.explode("kept").alias("b")).select("item", "b.hash", "b.span", "b.left", "b.words")
    items = work_table(items.distinct())
    spans = sorted(row[0] for row in items.select("span").distinct().collect())
    slot = F.col("hash").bitwiseAND((1 << MAP_BITS) - 1)
    words = items.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("bits")).collect()
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for row in words:
        bits[row["word"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF
    source = only(docs, doc_id=id_col, text=text_col).withColumn("text_key", text_hash(F.col("text")))
    rows = work_table(fingerprints(source, ["doc_id", "text_key"], k, span, spans, bits))
    near = rows.where(F.size("kept") > 0).select("text_key", "kept").dropDuplicates(["text_key"]).select("text_key", F.explode("kept").alias("d"))
    near = near.select("text_key", "d", F.col("d.hash").alias("hash"), F.col("d.span").alias("span"))
    items = items.select("hash", "span", "item", F.struct("left", "words").alias("b"))
    size = F.when(F.col("span") == span, k).otherwise(F.col("span"))
    pairs = near.join(items, ["hash", "span"]).withColumn("k", size).withColumn("reach", F.col("span") - size)
    pairs = pairs.where(F.expr("slice(d.words, d.left + 1, k) = slice(b.words, b.left + 1, k)"))
    pairs = pairs.withColumn("before", agreeing("(-i)")).withColumn("after", agreeing("(k + i - 1)"))
    hits = pairs.where(F.col("before") + F.col("k") + F.col("after") >= F.col("span"))
    hits = hits.select("text_key", "item", "before", (F.col("k") + F.col("after")).alias("reached"), F.explode("d.runs").alias("r")).select("text_key", "item", "before", "reached", "r.*")
    # Places whose stretches meet are one stretch; others stand for themselves.
    one = "array(struct(first - before AS lo, first + step * (count - 1) + reached AS hi))"
    each = "transform(sequence(0, count - 1), i -> struct(first + step * i - before AS lo, first + step * i + reached AS hi))"
    hits = hits.select("text_key", "item", F.inline(F.expr(f"IF(step <= before + reached, {one}, {each})"))).distinct()
    return rows.select("doc_id", "text_key", "n_words"), work_table(hits)


def hit_words(hits: DataFrame) -> DataFrame:
    """Number of words in any hit, per ``text_key``: lengths beyond what earlier hits of the text reach."""
    spans = hits.select("text_key", "lo", "hi").distinct()
    earlier = F.max("hi").over(Window.partitionBy("text_key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(earlier, F.lit(0))))
    return spans.withColumn("fresh", fresh).groupBy("text_key").agg(F.sum("fresh").alias("n_hit"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (``contamination`` has the rules)."""
    rows, hits = contamination(docs, benchmark, **options)
    items = hits.groupBy("text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # Written first, so that the join below is of plain tables and a text with very many copies is split.
    found = work_table(hit_words(hits).join(items, "text_key"))
    out = rows.join(found, "text_key", "left")
    listed = F.array_join(F.coalesce(F.col("items"), F.array().cast("array<string>")), ",")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` without the documents that share ``span`` words in a row with a benchmark item."""
    _, hits = contamination(docs, benchmark, text_col=text_col, **options)
    plain, text = plain_names(docs, text_col)
    keys = work_table(hits.select("text_key").distinct())
    return plain.join(by_shuffle(keys), text_hash(F.col(text)) == F.col("text_key"), "left_anti").toDF(*docs.columns)
