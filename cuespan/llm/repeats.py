"""Runs of periodic words in texts, by recursive frequency splitting and a lag scan.

A run of period q is a stretch of words in which words q apart are identical, of at least ``max(LEAST, 2 * q)`` words. Each of its words
therefore occurs twice or more within it, so a word that occurs once within a segment belongs to no run there and splits it. The parts
are counted again, until no segment changes; segments shorter than ``LEAST`` are left. What survives is scanned lag by lag.

A run leaves at least ``max(LEAST - q, q)`` words in a row that equal the word q further on. Such a stretch holds several multiples of
``q // GRID`` in a row, so a lag looks at these places alone, and only where they agree at every place between: all lags of a segment
of m words cost about m log m comparisons, and a hit is extended once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuespan.llm.common import in_slices, only, utf8

LEAST = 12
#: Places that a lag looks at in a stretch of its own length.
GRID = 8
SCHEMA = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Run = tuple[int, int, int]


def segments(words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """[first, end) of the stretches that no rare word splits any more; ``starts`` are the places where texts begin."""
    if not len(words):
        return []
    bounds = np.unique(np.concatenate([starts[starts < len(words)], [0]]))
    owner = np.zeros(len(words), np.int64)
    owner[bounds] = 1
    owner = np.cumsum(owner) - 1
    places = np.arange(len(words))
    stable: list[tuple[int, int]] = []
    while len(places):
        # Segments are numbered along the places; a key stands for one word of one segment.
        keys = owner * (int(words.max()) + 1) + words[places]
        order = np.argsort(keys)
        ordered = keys[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        once = np.zeros(len(places), bool)
        once[order] = fresh & np.concatenate([fresh[1:], [True]])
        split = np.zeros(int(owner[-1]) + 1, bool)
        split[owner[once]] = True
        firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        ends = np.concatenate([firsts[1:], [len(places)]])
        for s in np.flatnonzero(~split[owner[firsts]]):
            if ends[s] - firsts[s] >= LEAST:
                stable.append((int(places[firsts[s]]), int(places[ends[s] - 1]) + 1))
        # What is left of split segments: stretches between rare words.
        keep = split[owner] & ~once
        kept, own = places[keep], owner[keep]
        if not len(kept):
            break
        begins = np.concatenate([[True], (kept[1:] != kept[:-1] + 1) | (own[1:] != own[:-1])])
        number = np.cumsum(begins) - 1
        long_enough = np.bincount(number)[number] >= LEAST
        places, number = kept[long_enough], number[long_enough]
        owner = np.cumsum(np.concatenate([[False], number[1:] != number[:-1]])) if len(number) else number
    return sorted(stable)


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements agree; looks at twice as many each time."""
    done, step, most = 0, 64, min(len(a), len(b))
    while done < most:
        differing = a[done : min(most, done + step)] != b[done : min(most, done + step)]
        if differing.any():
            return done + int(differing.argmax())
        done, step = done + step, step * 2
    return most


def stretches(agree: np.ndarray, least: int) -> np.ndarray:
    """[first, end) of at least ``least`` true values in a row."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], agree, [False]]).astype(np.int8))).reshape(-1, 2)
    return edges[edges[:, 1] - edges[:, 0] >= least]


def lag_scan(words: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of one segment."""
    m, found, seen = len(words), [], set()
    # Of the runs found, the one that reaches furthest at each place: multiples of its period show nothing new inside it.
    far, period = np.zeros(m, np.int64), np.ones(m, np.int64)
    for q in range(1, m // 2 + 1):
        wanted = max(LEAST - q, q)
        if q + wanted > m:
            break
        h = max(1, q // GRID)
        count = wanted // h
        agree = words[: m - q : h] == words[q::h]
        if np.count_nonzero(agree) < count:
            continue
        for first, end in (stretches(agree, count) * h).tolist():
            # Between the places looked at the words may differ: what agrees at all of them may be several stretches.
            place = first
            while end - place >= count * h:
                if far[place] > place + q and q % period[place] == 0:
                    right = int(far[place]) - q
                else:
                    right = place + reach(words[place : m - q], words[place + q :])
                    left = place - reach(words[:place][::-1], words[q : place + q][::-1])
                    last = right + q
                    # A smaller period of the same stretch divides this one and was found before, over the same words.
                    if right - left >= wanted and (left, last) not in seen:
                        seen.add((left, last))
                        found.append((left, last - left, q))
                        further = left + np.flatnonzero(far[left:last] < last)
                        far[further], period[further] = last, q
                place += -(-(right - place) // h) * h
    return found


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents, chosen by the checksum of their id, end in a repetition of their own words."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def runs_of(rows: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, by start, then period."""
    numbers: dict[bytes, int] = {}
    counts = np.array([len(row) for row in rows], np.int64)
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for row in rows for w in row), np.int64, int(counts.sum()))
    starts = np.cumsum(counts) - counts
    out: list[list[Run]] = [[] for _ in rows]
    for first, end in segments(words, starts):
        text = int(np.searchsorted(starts, first, side="right")) - 1
        at = first - int(starts[text])
        out[text] += [(at + start, length, q) for start, length, q in lag_scan(words[first:end])]
    return [sorted(found, key=lambda run: (run[0], run[2])) for found in out]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, with one space between."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def periodic_runs(docs: DataFrame, planted: bool = False, full: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, number of runs, the longest one (ties: least start, then period; null without a run), digests, and with ``full``
    all runs and the text without repeats (words joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``. Null, empty and wordless texts have no runs and an empty collapsed text. ``planted`` puts a
    repetition into every tenth text first (see ``rewritten``; texts of unknown id stay). Rows neither meet nor move.
    """
    source = only(docs, doc_id=id_col, text=text_col)
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
    names = names if full else names[:7]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = [text.split() for text in utf8(batch.column("text"))]
            if planted:
                rows = [rewritten(words, i) for words, i in zip(rows, batch.column("doc_id").to_pylist())]
            found = runs_of(rows)
            best = [min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None) for runs in found]
            texts = [collapsed(words, runs) for words, runs in zip(rows, found)]
            listed = ["".join([f"{s},{n},{q}\n" for s, n, q in runs]) for runs in found]
            columns = [pa.array(list(map(len, found)), pa.int64()), *(pa.array([b[i] for b in best], pa.int64()) for i in range(3))]
            columns.append(pa.array([None if b[1] is None else 1000 * b[1] // b[2] for b in best], pa.int64()))
            columns += [pa.array([sha256(x.encode()).hexdigest() for x in listed]), pa.array([sha256(x).hexdigest() for x in texts])]
            if full:
                columns.append(pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found], RUNS))
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    fields = SCHEMA if full else SCHEMA[: SCHEMA.index(", runs array")]
    return source.mapInArrow(task, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {fields}")
