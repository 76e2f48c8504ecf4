"""Byte-level BPE encoding and decoding by a rank file, on padded numpy matrices.

A task cuts each text into pieces by the pattern and encodes every piece once: pieces of like length are the rows of
one padded matrix, and each round every row merges its leftmost pair of least rank, found by a hashed table of pairs;
rows without a pair left leave the matrix. Texts are then put together from their pieces' ids. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cuespan.llm.common import in_slices, only

#: No rank: higher than any.
NONE = np.int32(2**31 - 1)
#: Rows of a matrix are at most this wide; a longer piece goes through a heap, which needs no quadratic time.
WIDEST = 512
#: Pieces a worker remembers before it starts anew; bounds its memory only.
REMEMBERED = 200_000
#: Cells of a matrix that are worked on at a time.
CELLS = 1 << 21


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the runs ``starts[i] .. starts[i] + lengths[i]``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class PairTable:
    """Merged id (its rank) of a pair of ids, by open addressing in arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (len(pairs) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        slots = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] == -1
            # Of several keys that want a free slot, the last one written has it.
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where there is none; a negative id has no pair."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slot(keys[todo])
        while len(todo):
            found = self.keys[slots]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (found != -1)
            todo, slots = todo[on], (slots[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Ranks:
    """A rank file: token bytes with their ids, and every split of a token into two tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {
            (self.ids[token[:cut]], self.ids[token[cut:]]): rank
            for token, rank in self.ids.items() for cut in range(1, len(token)) if token[:cut] in self.ids and token[cut:] in self.ids
        }
        self.table = PairTable(self.pairs)
        count = max(self.ids.values()) + 1
        tokens = [b""] * count
        for token, rank in self.ids.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.content = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows of ids that follow each other, and the number of bytes of each row."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.concatenate([[0], np.cumsum(counts)])
        return self.content[spread(self.starts[ids], lengths)], ends[at[1:]] - ends[at[:-1]]

    def merge_matrix(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of byte ids, which -1 pads on the right, as they finish: their numbers and their ids, padded likewise."""
        at = np.arange(len(rows))
        ranks = self.table.rank(rows[:, :-1], rows[:, 1:])
        while True:
            each = np.arange(len(rows))
            place = ranks.argmin(axis=1)
            least = ranks[each, place]
            done = least == NONE
            if done.any():
                yield at[done], rows[done]
                keep = ~done
                rows, ranks, at, place, least = rows[keep], ranks[keep], at[keep], place[keep], least[keep]
                each = each[: len(rows)]
            if not len(rows):
                return
            if rows.shape[1] == 2:
                yield at, least[:, None]
                return
            # The pair gives way to its merged id and the rest moves up; then the pairs on both sides are looked up.
            columns = np.arange(rows.shape[1] - 1)
            rows = np.take_along_axis(rows, columns + (columns > place[:, None]), axis=1)
            rows[each, place] = least
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= place[:, None]), axis=1)
            near = np.flatnonzero(place > 0)
            ranks[near, place[near] - 1] = self.table.rank(rows[near, place[near] - 1], least[near])
            near = np.flatnonzero(place < ranks.shape[1])
            ranks[near, place[near]] = self.table.rank(least[near], rows[near, place[near] + 1])

    def merge_long(self, ids: list[int]) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        n = len(ids)
        follow, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[p], i) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = follow[i]
            if ids[i] < 0 or j >= n or self.pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            follow[i] = follow[j]
            if follow[i] < n:
                back[follow[i]] = i
                if (p := (rank, ids[follow[i]])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p], i))
            if back[i] >= 0 and (p := (ids[back[i]], rank)) in self.pairs:
                heapq.heappush(heap, (self.pairs[p], back[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the number of each: a token's own id, else what merges leave."""
        whole = np.fromiter((self.ids.get(piece, -1) for piece in pieces), np.int32, len(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        known = np.flatnonzero(whole >= 0)
        found = [(known, np.ones(len(known), np.int64), whole[known])]
        widths = np.where(whole >= 0, 0, np.maximum(4, (sizes + 3) // 4 * 4))
        for i in np.flatnonzero(widths > WIDEST):
            ids = self.merge_long(self.of_byte[np.frombuffer(pieces[i], np.uint8)].tolist())
            found.append((np.array([i]), np.array([len(ids)]), ids))
        for width in np.unique(widths[(widths > 0) & (widths <= WIDEST)]):
            members = np.flatnonzero(widths == width)
            step = max(1, CELLS // int(width))
            for start in range(0, len(members), step):
                part = members[start : start + step]
                rows = np.full((len(part), width), -1, np.int32)
                rows[np.arange(width) < sizes[part][:, None]] = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)]
                for numbers, merged in self.merge_matrix(rows):
                    used = merged >= 0
                    found.append((part[numbers], used.sum(axis=1), merged[used]))
        lengths = np.zeros(len(pieces), np.int64)
        for numbers, counts, _ in found:
            lengths[numbers] = counts
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.int32)
        for numbers, counts, ids in found:
            flat[spread(starts[numbers], counts)] = ids
        return flat, lengths


class Memory(dict):
    """Number of each key; a new key gets the next one and waits for its content."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.waiting.append(key)
        return number

    def news(self) -> list[str]:
        out, self.waiting = self.waiting, []
        return out


def rows_of(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``which`` of a ragged array put side by side, and the total of each of the groups that ``counts`` forms."""
    starts, own = np.cumsum(lengths) - lengths, lengths[which]
    ends, at = np.concatenate([[0], np.cumsum(own)]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return flat[spread(starts[which], own)], ends[at[1:]] - ends[at[:-1]]


class Encoder:
    """Encodes texts; words and pieces that come again are not worked on again.

    With ``words``, a text is first cut before each single space between two characters other than white space, where
    no match of the public pattern goes across, and only a word not met before is searched by the pattern.
    """

    def __init__(self, path: str, pattern: str, words: bool):
        self.ranks, self.cut, self.words = Ranks(path), regex.compile(pattern).findall, words
        self.gap = re.compile(r"\s\s").search
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.pieces = Memory(), Memory()
        self.piece_ids, self.piece_lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.chunk_ids, self.chunk_lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _numbers(self, text: str) -> np.ndarray:
        """The text's chunks. A chunk that starts with a space has its number under the rest, any other under a line break and itself."""
        if not self.words or self.gap(text):
            return np.array([self.chunks["\n" + text]] if text else [], np.int32)
        first, *rest = text.split(" ")
        numbers = [self.chunks["\n" + first]] if first else []
        numbers += map(self.chunks.__getitem__, rest)
        return np.array(numbers, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        if len(self.chunks) > REMEMBERED:
            self._forget()
        numbers = [self._numbers(text) for text in texts]
        new = [self.cut(key[1:] if key[:1] == "\n" else " " + key) for key in self.chunks.news()]
        of_chunk = [[self.pieces[piece] for piece in chunk] for chunk in new]
        ids, lengths = self.ranks.merge([piece.encode() for piece in self.pieces.news()])
        self.piece_ids, self.piece_lengths = np.concatenate([self.piece_ids, ids]), np.concatenate([self.piece_lengths, lengths])
        counts = np.fromiter(map(len, of_chunk), np.int64, len(of_chunk))
        which = np.fromiter((p for chunk in of_chunk for p in chunk), np.int64, int(counts.sum()))
        ids, lengths = rows_of(self.piece_ids, self.piece_lengths, which, counts)
        self.chunk_ids, self.chunk_lengths = np.concatenate([self.chunk_ids, ids]), np.concatenate([self.chunk_lengths, lengths])
        counts = np.fromiter(map(len, numbers), np.int64, len(numbers))
        which = np.concatenate([np.zeros(0, np.int32), *numbers])
        return rows_of(self.chunk_ids, self.chunk_lengths, which, counts)


#: One per worker process: it lives on while Spark reuses the worker.
@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, words: bool) -> Encoder:
    return Encoder(path, pattern, words)


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, words: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, the whole text's token ids; a null or empty text has none.

    Each match of ``pattern`` is encoded by itself; characters no match covers are left out, as by the public library.
    ``words`` saves time with patterns whose matches hold a space at their start only. Repeated rows and null ids stay as they are; other columns of ``docs`` do not matter. The rank file must be at
    ``ranks_path`` on every node.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(ranks_path, pattern, words)
        for batch in in_slices(batches):
            ids, counts = mine.encode([text or "" for text in batch.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "ids"])

    source = only(docs, doc_id=id_col, text=text_col)
    return source.mapInArrow(task, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with ``content``, the bytes the ids stand for; null ids give null."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = ranks_of(ranks_path)
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                rows = part.column("ids")
                counts = np.asarray(rows.value_lengths().fill_null(0)).astype(np.int64)
                content, sizes = mine.decode(np.asarray(rows.flatten()), counts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                missing = pa.array(np.asarray(rows.is_null(), dtype=bool))
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(content.tobytes())])
                binary = pa.compute.if_else(missing, None, binary.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows, binary], ["doc_id", "ids", "content"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(task, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, content binary")
