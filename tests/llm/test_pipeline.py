"""The pipeline's stages on a small table with planted cases, against what each stage's rules say."""

from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cuespan.llm import bpe, quality, secrets, simhash
from test_corpus_operators import BASE, plain_components, plain_fingerprint, plain_hits, plain_spans

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    items = [tuple(r) for r in corpus_pipeline.table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    kept, last = {}, {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.work_table(stage(spark, docs, SMALL))
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert len(rows) == docs.count() and set(rows) <= set(last)
        if name != "encoding":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "near_duplicates":
            ids = sorted(last)
            groups = plain_components([plain_fingerprint(last[i]["text"]) for i in ids])
            assert set(rows) == {ids[g] for g in groups}
        if name == "decontamination":
            assert set(rows) == {i for i, r in last.items() if not plain_hits(r["text"], items)[4]}
        if name == "secrets":
            assert set(rows) == set(last)
            for i, r in rows.items():
                assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
                assert plain_spans(last[i]["text"]) or r["text"] == last[i]["text"] or secrets.TOKEN
        if name == "encoding":
            ranks = bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
            assert {i: r["ids"] for i, r in rows.items()} == {i: library.encode_ordinary(r["text"]) for i, r in last.items()}
        kept[name], last = set(rows), rows
    assert len(kept["quality"]) < 200 and len(kept["near_duplicates"]) < len(kept["quality"]) and simhash.BITS == 64
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()} == kept["encoding"]


def plain_quality(rows, most=100, share=0.8):
    """Kept documents and their texts by the rules of the quality stage."""
    normal = lambda line: " ".join(BASE.findall(line)).lower()
    holders, out = {}, {}
    for r in rows:
        for line in set(map(normal, r["text"].split("\n"))) - {""}:
            holders.setdefault((r["source"], line), set()).add(r["text"])
    for r in rows:
        words = BASE.findall(r["text"])
        often = Counter(zip(words, words[1:], words[2:]))
        covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if often[w] > 1 for j in (i, i + 1, i + 2)}
        lines = r["text"].split("\n")
        left = [line for line in lines if len(holders.get((r["source"], normal(line)), ())) <= most]
        gone = len(words) - len(BASE.findall("\n".join(left)))
        if len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and gone <= share * len(words):
            out[r["doc_id"]] = "\n".join(left)
    return out


def test_quality_stage_takes_common_lines_away(spark):
    body = lambda i: "\n".join(" ".join(f"w{i}x{j}x{k}" for k in range(20)) for j in range(4))
    menu = " ".join(f"menu{j}" for j in range(30))
    rows = [(i, f"{menu.upper()} \n{body(i)}\n\n  Contact us today\t\n", "en", "a", 0) for i in range(104)]
    rows += [(200 + i, f"{menu}\n" * 30 + body(200 + i), "en", "a", 0) for i in range(3)] + [(300 + i, f"{menu}\n{body(300 + i)}", "en", "b", 0) for i in range(20)]
    rows += [(400, rows[0][1], "en", "a", 0), (401, rows[0][1], "en", "b", 0), (402, "short", "en", "a", 0), (403, f"Contact\n{body(403)}\n \n", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for table in (docs, corpus_pipeline.table(spark, SMALL, "documents")):
        out = {r["doc_id"]: r for r in corpus_pipeline.quality(spark, table, SMALL).collect()}
        assert {i: r["text"] for i, r in out.items()} == plain_quality(table.collect()) and all(r["n_chars"] == len(r["text"]) for r in out.values())
    few = plain_quality(corpus_pipeline.table(spark, SMALL, "documents").collect(), 2)
    assert {r["doc_id"]: r["text"] for r in quality.kept_documents(corpus_pipeline.table(spark, SMALL, "documents"), most=2).collect()} == few
    assert plain_quality(docs.collect())[1] == body(1) + "\n\n" and not {200, 201, 202, 402} & set(plain_quality(docs.collect()))


def test_empty_tables(spark):
    docs = corpus_pipeline.table(spark, SMALL, "documents").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.work_table(stage(spark, docs, SMALL))
        assert docs.count() == 0
