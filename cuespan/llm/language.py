"""Language identification by a convolutional network on bytes, in numpy.

A text is cut into windows of fixed length, the last one padded with zero bytes. Filters of several widths slide over the bytes of a
window (a filter is a table of weights per place and byte), each keeps its greatest response, and a softmax layer
gives the window's probabilities; a text's are the mean of its windows'. The network is trained on a bounded sample of labelled texts,
where of each filter only the place of its greatest response learns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.llm.common import held_out, in_slices, only, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Windows that are worked on together.
TOGETHER = 64
UNKNOWN = "und"


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text with A-Z in lower case, at least one."""
    rows = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.lower().ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


class Network:
    """Weights: ``tables[i]`` (width, 256, filters) of each width, ``bias``, ``dense`` and ``out``."""

    def __init__(self, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.out = np.zeros(classes, np.float32)

    def responses(self, windows: np.ndarray) -> list[np.ndarray]:
        """Per width, the filters' responses at every place: (windows, places, filters)."""
        return [sum(table[j][windows[:, j : WINDOW - w + 1 + j]] for j in range(w)) for w, table in zip(WIDTHS, self.tables)]

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        scores = np.maximum(pooled + self.bias, 0) @ self.dense + self.out
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.dense, self.out]

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        responses = self.responses(windows)
        places = [r.argmax(axis=1) for r in responses]
        pooled = np.concatenate([np.take_along_axis(r, p[:, None, :], 1)[:, 0] for r, p in zip(responses, places)], axis=1)
        hidden = np.maximum(pooled + self.bias, 0)
        error = self.softmax(pooled)
        error[np.arange(len(labels)), labels] -= 1
        error /= len(labels)
        back = (error @ self.dense.T) * (hidden > 0)
        out = []
        for i, (w, place) in enumerate(zip(WIDTHS, places)):
            slope = np.zeros_like(self.tables[i])
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                np.add.at(slope[j], (np.take_along_axis(windows, place + j, 1), np.arange(FILTERS)[None, :]), own)
            out.append(slope)
        return [*out, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]

    def train(self, windows: np.ndarray, labels: np.ndarray, rounds: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 1) -> None:
        """Adam with a falling rate."""
        rng = np.random.default_rng(seed)
        first, second = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        steps = max(1, rounds * -(-len(windows) // batch))
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), batch):
                part = order[start : start + batch]
                step += 1
                pace = rate * (1 - (step - 1) / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(self.parameters(), self.gradients(windows[part], labels[part]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= pace * m / (np.sqrt(v) + 1e-8)


class Reader:
    """The trained network with its first layer as tables of byte pairs: half the look-ups, the same responses."""

    def __init__(self, network: Network):
        self.network = network
        two, three, four = network.tables
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, FILTERS)
        self.pairs = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1]), pair(four[2], four[3])], axis=1)
        self.third = three[2]

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        n = FILTERS
        seen = self.pairs[(windows[:, :-1].astype(np.uint16) << 8) | windows[:, 1:]]
        three = seen[:, :-1, n : 2 * n] + self.third[windows[:, 2:]]
        four = seen[:, :-2, 2 * n : 3 * n] + seen[:, 2:, 3 * n :]
        return np.concatenate([seen[:, :, :n].max(axis=1), three.max(axis=1), four.max(axis=1)], axis=1)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean over each text's windows."""
        rows = [windows_of(text) for text in texts]
        windows = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.uint8)
        pooled = np.concatenate([np.zeros((0, FILTERS * len(WIDTHS)), np.float32), *(self.pooled(windows[i : i + TOGETHER]) for i in range(0, len(windows), TOGETHER))])
        each = self.network.softmax(pooled)
        counts = np.array([len(r) for r in rows])
        return np.add.reduceat(each, np.cumsum(counts) - counts, axis=0) / counts[:, None] if rows else each


def labelled_windows(docs: DataFrame, rows: int, per_text: int) -> DataFrame:
    """(label, window) of about ``rows`` labelled texts of the learning fold (at most twice that), ``per_text`` windows spread over each."""
    fold = docs.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    step = max(1, fold.select("doc_id", "label").count() // rows)
    chosen = fold.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)).limit(2 * rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            labels, windows = [], []
            for label, text in zip(batch.column("label").to_pylist(), utf8(batch.column("text"))):
                every = windows_of(text)
                for place in sorted({int(x) for x in np.linspace(0, len(every) - 1, per_text)}):
                    labels.append(label)
                    windows.append(every[place].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(windows, pa.binary())], ["label", "window"])

    return chosen.mapInArrow(task, "label string, window binary")


def detect_language(
    docs: DataFrame, rows: int = 3000, per_text: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang"
) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score, by a network trained on at most twice ``rows`` labelled texts of the learning fold.

    Null texts and texts without a letter are ``und`` with score 0, as are all without any label to learn from. The windows of
    the sample (256 bytes each) are all that the driver sees; every window of every text is read.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    sample = sorted((row["label"], bytes(row["window"])) for row in labelled_windows(source, rows, per_text).collect())
    names = sorted({label for label, _ in sample})
    network = Network(len(names))
    if sample:
        number = {name: i for i, name in enumerate(names)}
        network.train(np.frombuffer(b"".join(w for _, w in sample), np.uint8).reshape(-1, WINDOW), np.array([number[label] for label, _ in sample]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network)
        for batch in in_slices(batches):
            chances = reader.probabilities(utf8(batch.column("text")))
            best = chances.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lettered"), pa.array([names[i] for i in best], pa.string()), pa.array(chances.max(axis=1).astype(float))],
                ["doc_id", "lettered", "best", "chance"],
            )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows_in = only(docs, doc_id=id_col, text=text_col).withColumn("lettered", lettered)
    if not names:
        return rows_in.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    out = rows_in.mapInArrow(task, f"doc_id {rows_in.schema['doc_id'].dataType.simpleString()}, lettered boolean, best string, chance double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("lettered"), F.col("best")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.least(F.lit(1.0), "chance")).otherwise(0.0).alias("score"),
    )
