"""The postorder log, periodic runs and personal data against brute force, and their defined results for odd rows and empty tables."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuespan.llm import manifest, pii, quality, repeats, secrets, simhash, winnow, word_bpe
from cuespan.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_value(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


# --- Merkle manifest


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashed(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, i):
    for nodes in levels[:-1]:
        first = i // 16 * 16
        yield i - first, nodes[first : first + 16]
        i //= 16


def plain_proofs(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    trees = []
    for source in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(sources[source], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[4])))
        trees.append((members, plain_levels([plain_leaf(r, r[4]) for r in members])))
    top = plain_levels([levels[-1][0] for _, levels in trees])
    for number, (members, levels) in enumerate(trees):
        for i, row in enumerate(members):
            path = [*plain_path(levels, i), *plain_path(top, number)]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            node = plain_leaf(row, row[4].translate(LOWER) if tampered else row[4])
            for at, run in path:
                node = hashed(*run[:at], node, *run[at + 1 :])
            proof = hashed(*(x for at, run in path for x in run[:at] + run[at + 1 :]))
            yield row[0], levels[0][i], levels[-1][0], top[-1][0], proof, node, node == top[-1][0]


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@pytest.mark.parametrize("levels,size", [(1, 500), (3, 6300)])
def test_proofs_and_log(spark, levels, size):
    rows = [(i, "a" if i % 3 else None if i % 2 else f"s{i % 60}", "en", i, f"Text {i}") for i in range(size)]
    rows += [(None, "a", None, None, None)] * 2 + [(5, "é", "en", 1, "Ä"), (6, "zz", None, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert by_value(manifest.postorder_proofs(docs, tampered(), levels).collect()) == by_value(plain_proofs(rows))
    made = manifest.manifest(docs, levels)
    logged, sizes = {}, {r["tree"]: r["n"] for r in made.trees.collect()}
    for r in manifest.log_nodes(made.log, made.trees, levels).collect():
        logged.setdefault(r["tree"], {})[r["place"]] = r["digest"].hex()
    leaves = {}
    for r in made.leaves.collect():
        leaves.setdefault(r["tree"], {})[r["idx"]] = r["digest"].hex()
    for tree, n in sizes.items():
        # Postorder by definition: a node right after all below it.
        climbed, want = plain_levels([leaves[tree][i] for i in range(n)]), []

        def walk(level, i):
            for child in range(16 * i, min(16 * i + 16, len(climbed[level - 1]))) if level else ():
                walk(level - 1, child)
            want.append(climbed[level][i])

        walk(len(climbed) - 1, 0)
        assert [logged[tree][p] for p in range(len(want))] == want and len(logged[tree]) == len(want)


def test_manifest_of_a_table(spark, small, odd):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    assert by_value(QUERIES["op11_postorder_log"](spark, SMALL).collect()) == by_value(plain_proofs([tuple(r) for r in small.select(*columns).collect()]))
    got = manifest.postorder_proofs(odd, tampered())
    assert by_value(got.collect()) == by_value(plain_proofs([tuple(r) for r in odd.select(*columns).collect()]))
    alone = manifest.postorder_proofs(odd.where("doc_id = 5")).collect()[0]
    assert alone["leaf"] == alone["root"] == alone["folded_root"] and alone["proof_sha256"] == hashed() and alone["verified"]
    assert manifest.postorder_proofs(odd.limit(0), tampered()).collect() == []


# --- periodic runs


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(12, 2 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(rng):
    letters = rng.choice([1, 2, 2, 3, 5, 30])
    row = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4)):
        unit = [b"%d" % rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 7, 13, 20]))]
        at = rng.randrange(len(row) + 1)
        row[at:at] = (unit * rng.randrange(2, 7))[: -rng.randrange(1, len(unit) + 1)]
    return row


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False))
def test_runs_are_all_runs(rng):
    rows = [repeating(rng) for _ in range(8)]
    assert repeats.runs_of(rows) == [plain_runs(row) for row in rows]


def test_long_periods():
    rng = random.Random(7)
    unit = [b"%d" % rng.randrange(4) for _ in range(900)]
    words = [b"x"] + unit * 2 + unit[:11] + [b"y"] + [b"a"] * 3000 + [b"b", b"c"] * 700
    assert {(1, 1811, 900), (1813, 3000, 1), (4813, 1400, 2)} <= set(repeats.runs_of([words])[0])


def plain_periodic(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashed(listed), hashlib.sha256(kept).hexdigest())


def test_periodic_runs_of_tables(spark, small, odd):
    some = small.where("length(text) < 8000")
    want = [plain_periodic(r["doc_id"], r["text"]) for r in some.collect()]
    assert any(r[1] for r in want)
    assert by_value(repeats.periodic_runs(some, planted=True, full=False).collect()) == by_value(want)
    assert {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect() if r["doc_id"] in {w[0] for w in want}} == {w[0]: w for w in want}
    rows = repeats.periodic_runs(odd).collect()
    assert len(rows) == 11 and {(r["n_runs"], r["start"], r["collapsed"]) for r in rows if r["doc_id"] in (2, 3, 4)} == {(0, None, "")}
    long = next(r for r in rows if r["doc_id"] == 8)
    assert [tuple(x) for x in long["runs"]] == [(0, 10_000, 5)] and long["collapsed"] == "lorem ipsum dolor sit amet end" and long["exponent_milli"] == 2_000_000
    assert repeats.periodic_runs(odd.limit(0), planted=True).collect() == []


# --- personal data


SHAPES = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_shapes(text):
    out = []
    for kind, pattern in enumerate(SHAPES):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            holds = [True, all(int(x) <= 255 for x in m.group().split(".")) if kind == 1 else None, 16 <= len(digits) <= 19 and doubled % 10 == 0, 8 <= len(digits) <= 15]
            if holds[kind]:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "0", "25", "300", " ", "-", "+", "b@c.d", "4111 1111 1111 1111", "(", ")", "é", "\n"]), max_size=25))
def test_fixed_shapes(parts):
    assert pii.shapes("".join(parts)) == plain_shapes("".join(parts))


DISGUISED = [
    ("write to <john.doe (at) example (dot) com> now", "email", "john.doe@example.com"), ("<john dot doe at example dot com>", "email", "john.doe@example.com"),
    ("<jane[at]mail[dot]example[dot]org>.", "email", "jane@mail.example.org"), ("<bob&#64;example&#46;org>", "email", "bob@example.org"),
    ("<аdmin@ехample.com>", "email", "admin@example.com"), ("<ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ>", "email", "john@example.com"), ("<user@example[.]com>", "email", "user@example.com"),
    ("schreib an <hans punkt meier (ät) web punkt de> bitte", "email", "hans.meier@web.de"), ("<jo​hn@exa​mple.com>", "email", "john@example.com"),
    ("call <plus one five five five one two three four five six seven>", "phone", "+15551234567"), ("<+1 (55O) 123-4567>", "phone", "+1 (550) 123-4567"),
    ("é <192[.]168[.]1[.]10> é", "ip", "192.168.1.10"), ("<one nine two dot one six eight dot one dot one two three>", "ip", "192.168.1.123"),
    ("<4lll 1111 1111 1111>", "card", "4111 1111 1111 1111"), ("<４１１１–1111 1111 1111>", "card", "4111-1111 1111 1111"), ("<" + " ".join(["vier", *["eins"] * 15]) + ">", "card", "4" + "1" * 15),
]


@pytest.mark.parametrize("text,kind,value", DISGUISED)
def test_disguises(text, kind, value):
    start, end = text.index("<"), text.rindex(">") - 1
    plain = text.replace("<", "", 1)
    plain = plain[:end] + plain[end + 1 :]
    base, more = pii.find(plain)
    assert base == plain_shapes(plain) == [] and more == [((pii.KINDS.index(kind), start, end), value)]
    assert pii.masked(plain) == f"{plain[:start]}[{kind}]{plain[end:]}"


def test_writing_is_left_alone():
    for text in ["visit us at example.com today", "look at the dot of it", "one two three go", "un deux trois", "a < b at c dot", "he is at home. Dot is out", "10O% of I and O", "3 plus 4 at 5"]:
        assert pii.find(text) == ([], []) and pii.masked(text) == text


def test_long_texts_take_their_length():
    for text, spans in [
        ("a@" * 100_000, 0), (" at a dot" * 50_000, 0), ("one " * 50_000, 0), ("1." * 100_000, 50_000), ("(((" * 100_000, 0), ("+1" * 100_000, 0), ("x" * 300_000 + "@b.cd", 1),
    ]:
        assert len(pii.find(text)[0]) == spans // (2 if spans > 1 else 1), text[:10]


def test_personal_data_of_tables(spark, small, odd):
    rows = {r["doc_id"]: r for r in QUERIES["op13_pii"](spark, SMALL).collect()}
    for r in small.collect():
        want = plain_shapes(r["text"])
        got = rows[r["doc_id"]]
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == i for x in want) for i in range(4)] and got["base_sha256"] == hashed(listed)
        assert set(filter(None, listed.split(","))) <= set(got["spans"].split(","))
    for report in (pii.pii_report(odd), pii.identifiers(odd), pii.without_pii(odd)):
        assert report.count() == 11
    assert {(r["n_email"], r["spans"]) for r in pii.pii_report(odd).collect()} == {(0, "")}
    assert by_value(pii.without_pii(odd).collect()) == by_value(odd.collect()) and pii.without_pii(odd).columns == odd.columns
    mail = spark.createDataFrame([(1, "é a@b.co, b at c dot com"), (2, None)], "doc_id bigint, text string")
    assert [r["text"] for r in pii.without_pii(mail).orderBy("doc_id").collect()] == ["é [email], [email]", None]
    found = pii.identifiers(mail).orderBy("doc_id").first()
    assert [tuple(x) for x in found["base"]] == [("email", 2, 8, "a@b.co")] and [tuple(x) for x in found["disguised"]] == [("email", 10, 24, "b@c.com")]
    assert pii.pii_report(odd.limit(0)).count() == pii.identifiers(odd.limit(0)).count() == 0


# --- names that clash with an operator's own, and repeated words against an item


def test_filters_keep_columns_of_any_name(spark):
    names = ["_text_key", "_spans", "_host", "_common", "_rejected", "_key", "_id", "text_key", "c0", "TEXT_KEY2", "a.b"]
    long = " ".join(f"word{i}" for i in range(70))
    rows = [(1, long, "s", *range(11)), (2, long, "s", *range(11)), (3, None, None, *range(11)), (4, f"{long} AKIA{'A1' * 10} end", "s", *range(11)), (1, long, "s", *range(11))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    bench = spark.createDataFrame([("i", "word1 word2 word3")], "item_id string, text string")
    assert winnow.without_contaminated(docs, bench).collect() == [tuple(rows[2])]
    masked = secrets.without_secrets(docs)
    assert masked.columns == docs.columns and sorted(r["text"] or "" for r in masked.collect())[-1] == f"{long} [secret] end"
    assert all(tuple(r)[3:] == tuple(range(11)) for r in masked.collect())
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 2, 4]
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == [1, 3]


def test_repeated_words_are_not_paired_place_by_place(spark):
    texts = [(1, "a " * 20_000), (2, "a b " * 10_000), (3, "x " + "a " * 9 + "y"), (4, ("a " * 12 + "stop ") * 800), (5, "a " * 9)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame([("i", "a " * 1_000), ("j", "b a " * 500), ("k", "a " * 12 + "stop " + "a " * 12)], "item_id string, text string")
    rows, hits = winnow.contamination(docs, bench)
    # Places of the item times places of the text would be over twenty million.
    assert hits.count() < 20_000
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in winnow.decontamination_report(docs, bench).collect()}
    assert got == {1: (20_000, 20_000, 2), 2: (20_000, 20_000, 1), 3: (11, 0, 0), 4: (10_400, 10_400, 2), 5: (9, 0, 0)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), unique=True, max_size=30))
def test_runs_of_places(places):
    places = sorted(places)
    assert [r["first"] + r["step"] * i for r in winnow.evenly_spaced(places) for i in range(r["count"])] == places


# --- token counts by joined frequencies


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=30), max_size=12), st.integers(1, 7))
def test_frequencies_hold_every_word_once(texts, buckets):
    parts, seen = {}, []
    for bucket, words, pairs in word_bpe.frequencies([" ".join(f"w{x}" for x in t).encode() for t in texts], buckets):
        words = words.split(b" ")
        seen += words
        step, word, times = word_bpe.unpacked(pairs, 3)
        for text, w, n in zip(step.cumsum().tolist(), word.tolist(), times.tolist()):
            parts[text, words[w]] = n
    want = {}
    for i, t in enumerate(texts):
        for x in t:
            want[i, f"w{x}".encode()] = want.get((i, f"w{x}".encode()), 0) + 1
    assert parts == want and len(seen) == len(set(seen))


def test_token_counts_over_slices_and_buckets(spark, small):
    """Many small slices, several buckets: each document's sum comes together again, and each different word is counted once per bucket."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        want = {r["doc_id"]: (len(r["text"].encode()), len(library.encode(r["text"], add_special_tokens=False).ids)) for r in small.collect()}
        for buckets in (1, 5):
            got = word_bpe.token_counts(small.repartition(3), public_tokenizers.path("word_bpe_49k.json"), buckets=buckets)
            assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_secrets_stage_changes_only_what_it_masks(spark, small):
    """A text that the stage has changed carries the mark, and reads as before around it."""
    before = {r["doc_id"]: r["text"] for r in small.collect()}
    changed = 0
    for r in secrets.without_secrets(small).collect():
        if r["text"] != before[r["doc_id"]]:
            changed += 1
            parts, at = r["text"].split("[secret]"), 0
            assert len(parts) > 1
            for part in parts:
                at = before[r["doc_id"]].index(part, at) + len(part)
    assert changed
