"""Token ids and counts by a tokenizers-library file, each distinct pre-token worked on once.

A text is cut at the six ASCII white space characters. No normaliser, pre-token or added token of the supported files
reaches across those, so a text's ids are its words' ids in order, and words are looked up by their bytes in a table the
worker keeps. New words are normalised and cut to pre-tokens together, and the library's model is asked once per new pre-token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuespan.llm.bpe import Memory, rows_of
from cuespan.llm.common import in_slices, only, utf8

#: Words a worker remembers before it starts anew; bounds its memory only.
REMEMBERED = 500_000


def byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes are themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Words:
    """Words of texts by number, with the number of their ids and, unless ``count_only``, the ids."""

    def __init__(self, path: str, count_only: bool):
        self.library, self.count_only = Tokenizer.from_file(path), count_only
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.marks = [token["content"] for token in spec["added_tokens"]]
        # The rules that are followed here: NFC, white space, lower case; a pattern; bytes as characters. The library does all else.
        stages = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        known = normal == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in stages] == ["Split", "ByteLevel"] and not spec.get("post_processor")
        known = known and stages[0]["behavior"] == "Removed" and stages[0]["invert"] and not stages[1]["add_prefix_space"] and not stages[1]["use_regex"]
        self.cut = regex.compile("\n|" + stages[0]["pattern"]["Regex"]).findall if known else None
        self.characters = byte_characters()
        self.forget()

    def forget(self) -> None:
        self.numbers, self.pieces = Memory(), Memory()
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.piece_lengths, self.piece_flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' words one after another, and the number of words of each text; new words are learnt."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        rows = [np.fromiter(map(self.numbers.__getitem__, text.split()), np.int32) for text in texts]
        if self.numbers.waiting:
            self._learn([word.decode() for word in self.numbers.news()])
        return np.concatenate([np.zeros(0, np.int32), *rows]), np.fromiter(map(len, rows), np.int64, len(rows))

    def _learn(self, words: list[str]) -> None:
        # Within Latin-1 all versions of Unicode agree, and composed is what every character is; beyond, the library decides.
        own = [self.cut is not None and (w.isascii() or max(w) <= "\xff") and not any(m in w for m in self.marks) for w in words]
        plain, other = [w for w, o in zip(words, own) if o], [w for w, o in zip(words, own) if not o]
        lengths, parts = np.zeros(len(words), np.int64), []
        own_at = np.array(own, bool)
        which, counts = self._pieces(plain)
        if self.count_only:
            ends, at = np.concatenate([[0], np.cumsum(self.piece_lengths[which])]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            lengths[own_at] = ends[at[1:]] - ends[at[:-1]]
        else:
            flat, lengths[own_at] = rows_of(self.piece_flat, self.piece_lengths, which, counts)
            parts.append((np.flatnonzero(own_at), flat))
        if other:
            coded = self.library.encode(other, is_pretokenized=True, add_special_tokens=False)
            lengths[~own_at] = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(other))
            if not self.count_only:
                parts.append((np.flatnonzero(~own_at), np.array(coded.ids, np.uint32)))
        if not self.count_only:
            starts, flat = np.cumsum(lengths) - lengths, np.zeros(int(lengths.sum()), np.uint32)
            for members, ids in parts:
                own_lengths = lengths[members]
                ends = np.cumsum(own_lengths)
                flat[np.repeat(starts[members] - (ends - own_lengths), own_lengths) + np.arange(len(ids))] = ids
            self.flat = np.concatenate([self.flat, flat])
        self.lengths = np.concatenate([self.lengths, lengths])

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words' pre-tokens one after another, and how many each word has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = self.cut("\n".join(words).lower())
        numbers = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        news = self.pieces.news()
        tokens = [self.library.model.tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.characters)) if p != "\n" else [] for p in news]
        self.piece_lengths = np.concatenate([self.piece_lengths, np.fromiter(map(len, tokens), np.int64, len(tokens))])
        if not self.count_only:
            self.piece_flat = np.concatenate([self.piece_flat, np.fromiter((t.id for row in tokens for t in row), np.uint32)])
        breaks = np.flatnonzero(numbers == self.pieces["\n"]) if len(words) > 1 else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([[-1], breaks, [len(numbers)]])) - 1
        return (np.delete(numbers, breaks), counts) if len(breaks) else (numbers, counts)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        which, counts = self.rows(texts)
        return rows_of(self.flat, self.lengths, which, counts)

    def count(self, texts: list[bytes]) -> np.ndarray:
        """The number of ids of each text."""
        which, counts = self.rows(texts)
        ends, at = np.concatenate([[0], np.cumsum(self.lengths[which])]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ends[at[1:]] - ends[at[:-1]]


@lru_cache(maxsize=2)
def words_of(path: str, count_only: bool) -> Words:
    """One per worker process: it lives on while Spark reuses the worker."""
    return Words(path, count_only)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers in as few bytes each as they need, compressed."""
    parts = []
    for column in columns:
        small = column.astype(np.min_scalar_type(int(column.max(initial=0))))
        parts += [bytes([small.itemsize]), small.tobytes()]
    return len(columns[0]).to_bytes(4, "little") + zstandard.compress(b"".join(parts), 1)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    count, raw, at, out = int.from_bytes(blob[:4], "little"), zstandard.decompress(blob[4:]), 0, []
    for _ in range(columns):
        size = raw[at]
        out.append(np.frombuffer(raw, f"<u{size}", count, at + 1).astype(np.int64))
        at += 1 + size * count
    return out


def frequencies(texts: list[bytes], buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, its different words, packed (step to the next text, word, times)) of a slice of texts; a word's bucket follows from its hash."""
    numbers: dict[bytes, int] = {}
    rows = [text.split() for text in texts]
    counts = np.array([len(row) for row in rows], np.int64)
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for row in rows for w in row), np.int64, int(counts.sum()))
    pairs, times = np.unique(np.repeat(np.arange(len(rows)), counts) * max(1, len(numbers)) + words, return_counts=True)
    text, word = np.divmod(pairs, max(1, len(numbers)))
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in numbers), np.int64, len(numbers))
    names, place = list(numbers), np.zeros(len(numbers), np.int64)
    by_bucket, order = np.argsort(own, kind="stable"), np.argsort(own[word], kind="stable")
    word_cuts, pair_cuts = (np.searchsorted(x, np.arange(buckets + 1)) for x in (own[by_bucket], own[word][order]))
    for bucket in np.flatnonzero(np.diff(word_cuts)).tolist():
        held = by_bucket[word_cuts[bucket] : word_cuts[bucket + 1]]
        place[held] = np.arange(len(held))
        part = order[pair_cuts[bucket] : pair_cuts[bucket + 1]]
        yield bucket, b" ".join([names[i] for i in held.tolist()]), packed(np.diff(text[part], prepend=0), place[word[part]], times[part])


PIECES = "slice bigint, bucket int, kind int, ids array<{0}>, n_bytes array<bigint>, words binary, pairs binary"


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. No ids are materialised.

    Slices of the table tell how often each document holds each pre-token (here a word: no rule of the file reaches across white
    space). These frequencies are dealt by the word's hash (``buckets``, as many as shuffle partitions unless given), so every different
    word of the corpus is counted by one task, once, and joined there to its frequencies; sums per slice and bucket then meet by slice.
    Null texts have no bytes and no tokens; strings of added tokens count as the library takes them. ``docs`` must be read from files, so
    that a slice that is worked out again holds the same rows. The file must be at ``path`` on every node.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = only(docs, doc_id=id_col, text=text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()
    names = ["slice", "bucket", "kind", "ids", "n_bytes", "words", "pairs"]

    def rows_out(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(ids), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in in_slices(batches):
            texts, ids = utf8(batch.column("text")), batch.column("doc_id")
            rows = [(number, number % buckets, 0, ids.to_pylist(), list(map(len, texts)), None, None)]
            rows += [(number, bucket, 1, None, None, words, pairs) for bucket, words, pairs in frequencies(texts, buckets)]
            yield rows_out(rows, ids.type)
            number += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, bucket, known = words_of(path, True), None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 1:
                    if row["bucket"] != bucket:
                        bucket, known = row["bucket"], {}
                    words = row["words"].split(b" ")
                    new = [w for w in words if w not in known]
                    known.update(zip(new, library.count(new).tolist()))
                    step, word, times = unpacked(row["pairs"], 3)
                    tokens = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[word] * times
                    text = np.cumsum(step)
                    first = np.flatnonzero(np.diff(text, prepend=-1))
                    row["pairs"], row["words"] = packed(np.diff(text[first], prepend=0), np.add.reduceat(tokens, first)), None
                out.append(tuple(row[n] for n in names))
            yield rows_out(out, batch.schema.field("ids").type.value_type)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, kind = None, None, None

        def document() -> pa.RecordBatch:
            ids, lengths = ([], []) if held is None else (held["ids"], held["n_bytes"])
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(lengths, pa.int64()), pa.array([] if sums is None else sums, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if held is not None:
                        yield document()
                    held, sums = row, np.zeros(len(row["ids"]), np.int64)
                else:
                    step, tokens = unpacked(row["pairs"], 2)
                    sums[np.cumsum(step)] += tokens
        if held is not None:
            yield document()

    schema = PIECES.format(id_type)
    dealt = source.mapInArrow(cut, schema).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    summed = dealt.mapInArrow(count, schema).repartition("slice").sortWithinPartitions("slice", "kind")
    counted = summed.mapInArrow(add, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
