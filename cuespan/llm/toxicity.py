"""Toxicity from a learnt lexicon, misspellings included, with context windows that tell quoting from abuse.

The lexicon is learnt from labelled texts: words that toxic texts hold and others do not. It is kept as a trie; the Levenshtein
automaton of a word is run down that trie as bit vectors (one per number of errors), for all new words of a slice at once, and a branch is
left when no automaton is alive any more. Around each hit a window of words is looked at for quotation marks, verbs of
speech and direct address. Sums of hits by number of errors, and of quoted ones, enter a logistic model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.llm.common import held_out, in_slices, only, text_hash
from cuespan.session import work_table

#: Words on each side of a hit that are looked at.
WINDOW = 8
#: Most errors for words of so many letters.
ERRORS = ((9, 2), (5, 1), (0, 0))
#: Most errors for terms of so many letters.
TERM_ERRORS = ((9, 2), (4, 1), (0, 0))
#: Stands for one unknown letter in a word, as signs between letters do that mask some.
UNKNOWN = "*"
#: Words a worker remembers before it starts anew; bounds its memory only.
REMEMBERED = 250_000
#: Bytes of text that are scanned together.
SLICE = 2 << 20
OPENING, CLOSING = "“„«‹‘", "”“»›’"
SPEECH = frozenset(
    "said says say called calls call wrote writes quote quoted quotes word words sagte sagt nannte nennt schrieb schreibt zitat zitiert wort "
    "dit disait appelle appelé écrit écrivait cite cité mot dijo dice llamó llama escribió escribe cita citó palabra".split()
)
ADDRESS = frozenset("you your you're youre u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted eres sois vosotros".split())
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
LETTERS = regex.compile(r"\p{L}+").findall
MASKED = regex.compile(r"\p{L}+(?:[*#_•]+\p{L}+)+").findall
ENDINGS = "!?.,;:)\"'"
MASKING = regex.compile(r"[*#_•]").sub


def granted(length: int) -> int:
    return next(n for least, n in TERM_ERRORS if length >= least)


class Trie:
    """Terms as nested dictionaries; the empty key marks an end. ``most`` has, by node, the most errors granted to a term below it."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        self.most: dict[int, int] = {}
        self.longest = max(map(len, terms), default=0)
        for term in terms:
            node = self.root
            for character in term:
                node = node.setdefault(character, {})
                self.most[id(node)] = max(self.most.get(id(node), 0), granted(len(term)))
            node[""] = {}

    def errors(self, words: list[str], by_term: bool = False) -> np.ndarray:
        """Least number of errors by which each word is some term; 9 where there is none within its allowance, or within the term's if ``by_term``."""
        out = np.full(len(words), 9, np.int8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        some = np.flatnonzero((lengths > 0) & (lengths <= min(60, self.longest + 2)))
        if not len(some) or not self.root:
            return out
        width = int(lengths[some].max())
        codes = np.array([words[i] for i in some], f"U{width}").view(np.uint32).reshape(len(some), width)
        one = np.uint64(1)
        end = one << lengths[some].astype(np.uint64)
        inside = (end << one) - one
        allowed = np.full(len(some), 2) if by_term else np.select([lengths[some] >= least for least, _ in ERRORS], [n for _, n in ERRORS])
        grants = [np.where(allowed >= d, inside, np.uint64(0)) for d in range(3)]
        places = one << np.arange(1, width + 1, dtype=np.uint64)
        masks: dict[str, np.ndarray] = {}
        found = np.full(len(some), 9, np.int8)
        start = [np.full(len(some), (2 << d) - 1, np.uint64) & grants[d] for d in range(3)]
        stack = [(self.root, 0, np.arange(len(some)), start)]
        while stack:
            node, depth, alive, state = stack.pop()
            for character, child in node.items():
                if character == "":
                    for d in range(granted(depth) if by_term else 2, -1, -1):
                        ends = (state[d] & end[alive]) != 0
                        found[alive[ends]] = np.minimum(found[alive[ends]], d)
                    continue
                if character not in masks:
                    masks[character] = (np.where((codes == ord(character)) | (codes == ord(UNKNOWN)), places, np.uint64(0))).sum(axis=1, dtype=np.uint64)
                mask = masks[character][alive]
                # The character is the word's next one; or, with an error, it is missing in the word, stands for another, or comes after an odd one.
                new = [(state[0] << one) & mask & grants[0][alive]]
                for d in (1, 2):
                    if by_term and d > self.most[id(child)]:
                        new.append(np.zeros(len(alive), np.uint64))
                        continue
                    new.append((((state[d] << one) & mask) | state[d - 1] | (state[d - 1] << one) | (new[d - 1] << one)) & grants[d][alive])
                on = (new[0] | new[1] | new[2]) != 0
                if on.any():
                    stack.append((child, depth + 1, alive[on], [s[on] for s in new]))
        out[some] = found
        return out


class Memory(dict):
    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self.waiting.append(word)
        self[word] = 9
        return -1


def spellings(word: str) -> list[str]:
    """Runs of letters in a word, the whole of it with look-alike signs read as letters, and with masked letters unknown."""
    runs = LETTERS(word)
    if runs and len(runs[0]) < len(word):
        letters = sum(map(len, runs))
        whole = "".join(LETTERS(word.translate(LOOKALIKES)))
        if letters * 3 >= len(whole) and whole not in runs:
            runs.append(whole)
        for masked in MASKED(word.rstrip(ENDINGS).translate(LOOKALIKES)):
            masked = MASKING(UNKNOWN, masked)
            if 2 * masked.count(UNKNOWN) <= len(masked):
                runs.append(masked)
    return runs


def quotation(words: list[str], at: int) -> float:
    """0: said by the text itself, 1: quoted, from the words around place ``at``."""
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    left, right = " ".join([*before, words[at][:1]]), " ".join([words[at][1:], *after])
    marks = left.count('"') % 2 == 1 and '"' in right
    opened = max(map(left.rfind, OPENING))
    marks = marks or (opened >= 0 and not any(c in left[opened + 1 :] for c in CLOSING) and any(c in right for c in CLOSING))
    near = {w.strip(".,:;!?\"'") for w in (*before, *after)}
    speech, address = bool(near & SPEECH), bool(near & ADDRESS)
    return 1.0 if marks and speech else 0.7 if marks else 0.3 if speech and not address else 0.0


class Scanner:
    """Features of texts: log of 1 + hits with 0, 1, 2 errors and quoted hits."""

    def __init__(self, terms: list[str]):
        self.trie, self.memory = Trie(terms), Memory()

    def features(self, texts: list[str]) -> np.ndarray:
        if len(self.memory) > REMEMBERED:
            self.memory = Memory()
        rows = [text.lower().split() for text in texts]
        for row in rows:
            for _ in map(self.memory.__getitem__, row):
                pass
        news, self.memory.waiting = self.memory.waiting, []
        parts = [spellings(word) for word in news]
        flat = [s for row in parts for s in row]
        errors = self.trie.errors(flat, by_term=True)
        # A masked word is a term of as many letters, with an error, or none.
        masked = np.fromiter((UNKNOWN in s for s in flat), bool, len(flat))
        errors = np.where(masked, np.where(errors == 0, 1, 9), errors).astype(np.int8)
        at = 0
        for word, row in zip(news, parts):
            if row:
                self.memory[word] = int(errors[at : at + len(row)].min())
                at += len(row)
        out = np.zeros((len(texts), 4))
        for i, row in enumerate(rows):
            found = np.fromiter(map(self.memory.__getitem__, row), np.int8, len(row))
            for place in np.flatnonzero(found < 9):
                quoted = quotation(row, int(place))
                out[i, found[place]] += 1 - quoted
                out[i, 3] += quoted
        return np.log1p(out)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` distinct texts (at most twice that many labels) of the learning fold with their label, chosen by a hash of the id."""
    fold = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    fold = fold.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    step = max(1, fold.count() // rows)
    chosen = fold.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).limit(2 * rows)
    texts = docs.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    return texts.groupBy(text_hash(F.col("text")).alias("key")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text", "toxic")


def learn_lexicon(sample: DataFrame, terms: int, least_share: float, least: int = 4) -> list[str]:
    """Words that at least ``least_share`` of toxic texts hold, with a log-likelihood ratio against chance of at least 16; the best ``terms``."""
    totals = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    everything, toxic = int(totals[0]), int(totals[1])
    if not toxic or toxic == everything:
        return []
    words = sample.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    base = toxic / everything
    inner = f"t * ln(t / (n * {base}D)) + IF(n > t, (n - t) * ln((n - t) / (n * {1 - base}D)), 0D)"
    counts = counts.where((F.col("t") >= max(least, least_share * toxic)) & (F.col("t") > 3 * base * F.col("n"))).withColumn("g", F.expr(f"2 * ({inner})"))
    best = counts.where("g >= 16").orderBy(F.desc("g"), "word").limit(terms)
    return sorted(row["word"] for row in best.collect())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model, the constant last, by Newton's method."""
    full = np.column_stack([x, np.ones(len(x))])
    weights, penalty = np.zeros(full.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ weights, -30, 30)))
        step = np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + penalty, full.T @ (y - p) - penalty @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def toxicity(
    docs: DataFrame, labels: DataFrame, rows: int = 20_000, terms: int = 400, least_share: float = 0.015, threshold: float = 0.7,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted, learnt from at most twice ``rows`` labelled texts of the learning fold.

    The lexicon has at most ``terms`` words. Null and empty texts have the score of a text without hits; unknown labels and ids do not
    teach; without toxic labels every score is 0. The model is a few hundred words and five numbers.
    """
    source = only(docs, doc_id=id_col, text=text_col)
    sample = work_table(labelled_sample(source, labels, rows))
    lexicon = learn_lexicon(sample, terms, least_share)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in in_slices(batches, most=SLICE):
            x = scanner.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(4)), batch.column("toxic")], ["a", "b", "c", "d", "toxic"])

    known = sample.mapInArrow(measured, "a double, b double, c double, d double, toxic int").toPandas().to_numpy(float)
    weights = fit_logistic(known[:, :4], known[:, 4]) if lexicon else np.array([0.0] * 4 + [-30.0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in in_slices(batches, most=SLICE):
            x = scanner.features([text or "" for text in batch.column("text").to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(x @ weights[:4] + weights[4], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = source.mapInArrow(scored, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
