"""Personal data in texts: fixed shapes, and the same shapes behind disguises.

A cascade of transducers rewrites a text: look-alike characters to ASCII, bracketed, spelled and encoded signs (``at``, ``dot``) to signs,
spelled digits to digits, letters between digits to the digits they look like. Every character written keeps the place of what it was
read from (``Tape``), so an identifier found in the rewritten text is mapped back to the characters of the source. What only the
rewritten text shows is added to the spans of the source; these stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuespan.llm.common import in_slices, only

KINDS = ["email", "ip", "card", "phone"]

# The shapes of identifiers, which must match as they stand. A look-behind only spares starts that cannot win.
LOCAL = "A-Za-z0-9._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαονιρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSaovipABEZHIKMNOPTYX"))
#: Signs that stand for others, and signs without width.
SIGNS = {**dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63", "-"), **dict.fromkeys("\u2024\u3002\uff61", "."), **dict.fromkeys("\xa0\u2002\u2003\u2007\u2009\u202f\u3000", " ")}
UNSEEN = "\xad\u200b\u200c\u200d\u2060\ufeff"
# Digits as words in English, German, French and Spanish.
NUMBERS = [
    ["zero", "null", "zéro", "cero"], ["one", "eins", "un", "uno"], ["two", "zwei", "zwo", "deux", "dos"], ["three", "drei", "trois", "tres"],
    ["four", "vier", "quatre", "cuatro"], ["five", "fünf", "cinq", "cinco"], ["six", "sechs", "seis"], ["seven", "sieben", "sept", "siete"],
    ["eight", "acht", "huit", "ocho"], ["nine", "neun", "neuf", "nueve"],
]
AT_WORDS = "at|arroba|arobase|klammeraffe"
DOT_WORDS = "dot|punkt|point|punto"


def compatible(low: int, high: int) -> dict[str, str]:
    """Characters of a range that stand for one ASCII character by Unicode's compatibility mapping."""
    pairs = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(low, high))
    return {c: plain for c, plain in pairs if len(plain) == 1 and plain.isascii() and plain.isprintable()}


def other_digits() -> dict[str, str]:
    """Decimal digits of other scripts."""
    return {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x0600, 0x1FBFF) if unicodedata.decimal(chr(c), -1) >= 0}


LETTERS = {**other_digits(), **compatible(0xFF01, 0xFF5F), **compatible(0xFE50, 0xFE70), **compatible(0x1D400, 0x1D800), **LOOKALIKES, **SIGNS}
TO_ASCII = str.maketrans(LETTERS)
FOREIGN = frozenset(LETTERS) | frozenset(UNSEEN)
#: A stretch of text without white space or signs of its own, which is rewritten only if all of it becomes ASCII.
STRETCH = re.compile(rf"[\w{''.join(map(re.escape, SIGNS))}{UNSEEN}]+|[{''.join(re.escape(c) for c in LETTERS if not c.isalnum())}]")

OPEN, SHUT = r"[\[({<]\s*", r"\s*[\])}>]"
DOT = rf"(?:\s*{OPEN}(?:{DOT_WORDS}|\.){SHUT}\s*|\s+(?:{DOT_WORDS})\s+|&#0*46;|&#x2e;|&period;|%2e)"
#: ``@`` in brackets or as an entity, in any place before a domain; as a plain word only where each dot of the domain is disguised.
AT_MARK = re.compile(rf"(?:\s*{OPEN}(?:{AT_WORDS}|@|ät|a){SHUT}\s*|&#0*64;|&#x40;|&commat;|%40|\s+@\s*|@\s+|@)(?=[A-Z0-9-]+(?:(?:{DOT}|\.)[A-Z0-9-]+)+)", re.I)
AT_WORD = re.compile(rf"\s+(?:{AT_WORDS})\s+(?=[A-Z0-9-]+(?:{DOT}[A-Z0-9-]+)+)", re.I)
#: What a plain word must lead to: a top-level domain in common use, as prose has ``at ... dot ...`` too.
ENDINGS = frozenset("com org net edu gov info biz io co me eu de fr es uk us at ch it nl be pt pl ca au in ru cn jp br mx example test invalid".split())
MARKS = "@[({<&%"
#: Cheap looks at the text in lower case, which decide whether the patterns above are needed at all.
LOW_AT = re.compile(rf"\s(?:{AT_WORDS})\s+(?=[a-z0-9-]+{DOT})")
LABEL_DOT = re.compile(rf"[A-Z0-9-]+({DOT}|\.)(?=[A-Z0-9-])", re.I)
LABEL = re.compile(r"[A-Z0-9-]+", re.I)
DOT_BEFORE = re.compile(rf"{DOT}$", re.I)
LOCAL_END = re.compile(rf"[{LOCAL}]")

VALUES = {word: str(digit) for digit, words in enumerate(NUMBERS) for word in words}
NUMBER = "|".join(sorted(VALUES, key=len, reverse=True))
BETWEEN = rf"(?:[\s,-]+|{DOT})"
SPOKEN = re.compile(rf"(?<!\w)(?:{NUMBER})(?:{BETWEEN}(?:{NUMBER}))+(?!\w)", re.I)
SPOKEN_WORD = re.compile(NUMBER, re.I)
LOW_SPOKEN = re.compile(rf"[^\w](?:{NUMBER}){BETWEEN}(?:{NUMBER}){BETWEEN}(?:{NUMBER})(?!\w)")
#: Fewest digits in a row that are read as digits: single ones and pairs are words of the language.
IN_A_ROW = 3
PLUS = re.compile(r"(?<!\w)plus\s+(?=[0-9])", re.I)
NUMBER_DOT = re.compile(rf"(?<=[0-9]){DOT}(?=[0-9])", re.I)
MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl]*[0-9])[0-9OoIl]*[OoIl][0-9OoIl]*(?![A-Za-z0-9])")
AS_DIGITS = str.maketrans("OoIl", "0011")

Span = tuple[int, int, int]
Edit = tuple[int, int, str]


class Tape:
    """A rewritten text, and of each of its characters the first and the end of what it was read from."""

    def __init__(self, text: str):
        self.text, self.first, self.end = text, None, None

    def rewrite(self, edits: list[Edit]) -> None:
        """Put in new characters; ``edits`` ascend and do not overlap."""
        if not edits:
            return
        if self.first is None:
            self.first = np.arange(len(self.text))
            self.end = self.first + 1
        texts, firsts, ends, at = [], [], [], 0
        for start, stop, new in edits:
            texts += [self.text[at:start], new]
            firsts += [self.first[at:start], np.full(len(new), self.first[start])]
            ends += [self.end[at:start], np.full(len(new), self.end[stop - 1])]
            at = stop
        self.text = "".join([*texts, self.text[at:]])
        self.first, self.end = np.concatenate([*firsts, self.first[at:]]), np.concatenate([*ends, self.end[at:]])

    def source(self, start: int, stop: int) -> tuple[int, int]:
        return int(self.first[start]), int(self.end[stop - 1])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` with a domain after it and one local character before it; the part before reaches back to the last match at most."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > free and LOCAL_END.match(text[start - 1]):
                start -= 1
            if start < at:
                free = domain.end()
                yield start, free
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def shapes(text: str) -> list[Span]:
    """(kind, start, end) of the fixed shapes, by kind, then start."""
    out = [(0, *span) for span in emails(text)]
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) <= 255 for part in match.group().split(".")):
            out.append((1, *match.span()))
    for match in CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *match.span()))
    if "+" in text:
        out += [(3, *match.span()) for match in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, match.group())) <= 15]
    return out


def characters(text: str) -> Iterator[Edit]:
    """Look-alikes and signs to ASCII, unseen ones to nothing, where a whole stretch becomes ASCII so."""
    if text.isascii() or FOREIGN.isdisjoint(text):
        return
    for match in STRETCH.finditer(text):
        found = match.group()
        if not found.isascii() and "".join(c for c in found.translate(TO_ASCII) if c not in UNSEEN).isascii():
            for i, c in enumerate(found, match.start()):
                if not c.isascii():
                    yield i, i + 1, "" if c in UNSEEN else LETTERS[c]


def addresses(text: str, low: str) -> list[Edit]:
    """``@`` and dots of disguised mail addresses; ``low``: the text in lower case."""
    found = [(*m.span(), False) for m in AT_MARK.finditer(text)] if any(c in text for c in MARKS) else []
    if LOW_AT.search(low):
        found = sorted([*found, *((*m.span(), True) for m in AT_WORD.finditer(text))])
    out: list[Edit] = []
    free = 0
    for start, stop, plain in found:
        left, dots = start, []
        if start < free:
            continue
        # Back over the part before the sign: characters, and disguised dots between them.
        while left > free:
            if LOCAL_END.match(text[left - 1]):
                left -= 1
                continue
            dot = DOT_BEFORE.search(text[max(free, left - 40) : left])
            first = left - len(dot.group()) if dot else left
            if not dot or left == start or first <= free or not LOCAL_END.match(text[first - 1]):
                break
            dots.append((first, left, "."))
            left = first
        if left == start:
            continue
        edits = [*reversed(dots), (start, stop, "@")]
        place, label = stop, LABEL_DOT.match(text, stop)
        while label:
            edits.append((*label.span(1), "."))
            place = label.end()
            label = LABEL_DOT.match(text, place)
        if plain and LABEL.match(text, place).group().lower() not in ENDINGS:
            continue
        out += [e for e in edits if text[e[0] : e[1]] != e[2]]
        free = place
    return out


def spoken(text: str) -> Iterator[Edit]:
    """Three digits or more in words, in a row, to digits, with the dots named between them."""
    for match in SPOKEN.finditer(text):
        words = list(SPOKEN_WORD.finditer(text, *match.span()))
        if len(words) >= IN_A_ROW:
            for word, follower in zip(words, words[1:]):
                between = text[word.end() : follower.start()]
                yield *word.span(), VALUES[word.group().lower()]
                yield word.end(), follower.start(), "" if not between.strip(" \t\n\r\f\v,-") else "."
            yield *words[-1].span(), VALUES[words[-1].group().lower()]


def normalised(text: str) -> Tape:
    """The text after all transducers."""
    tape = Tape(text)
    tape.rewrite(list(characters(tape.text)))
    low = tape.text.lower()
    tape.rewrite(addresses(tape.text, low))
    if LOW_SPOKEN.search(" " + low):
        tape.rewrite(list(spoken(tape.text)))
    tape.rewrite([(*m.span(), m.group().translate(AS_DIGITS)) for m in MIXED.finditer(tape.text)])
    if "plus" in low:
        tape.rewrite([(*m.span(), "+") for m in PLUS.finditer(tape.text)])
    tape.rewrite([(*m.span(), ".") for m in NUMBER_DOT.finditer(tape.text)])
    return tape


def find(text: str) -> tuple[list[Span], list[tuple[Span, str]]]:
    """(base, disguised) of a text: spans of the fixed shapes, and those that only the rewritten text shows, with what they read there."""
    base = shapes(text)
    tape = normalised(text)
    if tape.first is None:
        return base, []
    more = {}
    for kind, start, stop in shapes(tape.text):
        first, end = tape.source(start, stop)
        value = tape.text[start:stop]
        if text[first:end] != value and not any(k == kind and s <= first and end <= e for k, s, e in base):
            more[kind, first, end] = value
    return base, sorted(more.items())


def listed(spans: Iterable[Span]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans])


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ``base`` and ``disguised``: arrays of (kind, start, end, value), value as the identifier reads without disguise.

    Places are code points of the source, ``end`` exclusive. Null and empty texts have none. Rows neither meet nor move.
    """
    source = only(docs, doc_id=id_col, text=text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            base, more = [], []
            for text in batch.column("text").to_pylist():
                shown, hidden = find(text or "")
                base.append([{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e]} for k, s, e in shown])
                more.append([{"kind": KINDS[k], "start": s, "end": e, "value": value} for (k, s, e), value in hidden])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(more, kind)], ["doc_id", "base", "disguised"])

    spans = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
    return source.mapInArrow(task, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, base {spans}, disguised {spans}")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (fixed shapes), base_sha256 and spans (``find`` has the rules). Null texts have none."""
    source = only(docs, doc_id=id_col, text=text_col)
    names = [f"n_{k}" for k in KINDS]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [find(text or "") for text in batch.column("text").to_pylist()]
            counts = [pa.array([sum(kind == k for kind, _, _ in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            every = pa.array([listed(sorted([*base, *(span for span, _ in more)])) for base, more in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, every], ["doc_id", *names, "base_sha256", "spans"])

    counts = ", ".join(f"{n} bigint" for n in names)
    return source.mapInArrow(task, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with ``[kind]`` in place of every identifier, overlapping ones together under the first one's kind."""
    base, more = find(text)
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in [*base, *(span for span, _ in more)]):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, -end)
    return "".join([*out, text[at:]]) if out else text


def without_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its identifiers masked; null texts stay null, all other columns stay as they are."""
    place = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, f"c{place}"):
            texts = [None if text is None else masked(text) for text in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, pa.string()))

    return plain.mapInArrow(task, plain.schema).toDF(*docs.columns)
