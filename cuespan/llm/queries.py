"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.llm.bpe import bpe_decode, bpe_encode
from cuespan.llm.common import table
from cuespan.llm.hilbert import hilbert_shards
from cuespan.llm.language import detect_language
from cuespan.llm.manifest import postorder_proofs
from cuespan.llm.pii import pii_report
from cuespan.llm.quality import quality_report
from cuespan.llm.repeats import periodic_runs
from cuespan.llm.secrets import secret_report
from cuespan.llm.simhash import simhash_components
from cuespan.llm.token_files import read_token_files, token_folder, write_token_files
from cuespan.llm.toxicity import toxicity
from cuespan.llm.winnow import decontamination_report
from cuespan.llm.word_bpe import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars", "doc_id"])


@query
def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, words=True), ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"),
    )


@query
def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents")).drop("host", "text_key")


ORACLES["op5_line_frequency"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), win AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM doc)
), rep AS (SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY row),
line AS (
  SELECT row, host, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT row, host, text, unnest(string_split(text, chr(10))) AS line FROM doc)
), norm AS (SELECT row, host, text, line, lower(array_to_string(words, ' ')) AS norm, len(words) AS n FROM line WHERE len(words) > 0),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM norm GROUP BY row),
common AS (SELECT host, norm FROM norm GROUP BY host, norm HAVING count(DISTINCT text) > 100),
gone AS (SELECT row, sum(n) AS n_removed FROM norm SEMI JOIN common USING (host, norm) GROUP BY row),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_removed
  FROM doc LEFT JOIN rep USING (row) LEFT JOIN dup USING (row) LEFT JOIN gone USING (row)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_removed > n_words * 0.8 AS kept
FROM counted
"""


@query
def op6_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


@query
def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op7_winnow"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), sized AS (SELECT item, words, least(len(words), 10) AS span FROM item WHERE len(words) > 0),
win AS (
  SELECT DISTINCT item, span, array_to_string(words[i : i + span - 1], ' ') AS w
  FROM (SELECT item, words, span, unnest(range(1, len(words) - span + 2)) AS i FROM sized)
), spans AS (SELECT DISTINCT span FROM win),
occ AS (
  SELECT row, i, span, array_to_string(words[i : i + span - 1], ' ') AS w
  FROM (SELECT row, words, span, unnest(range(1, len(words) - span + 2)) AS i FROM doc, spans WHERE len(words) >= span)
), hit AS (SELECT row, i, span, item FROM occ JOIN win USING (span, w)),
hits AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + span)) AS p FROM hit) GROUP BY row),
items AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hit GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
"""


@query
def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_language(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_zstd_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_folder(spark)
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, ids=False)


@query
def op11_postorder_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postorder_proofs(table(spark, sf_dir, "documents"), tamper=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


# Levels of all trees, then of the tree over their roots; each row climbs them with its own digest put in.
ORACLES["op11_postorder_log"] = r"""
WITH RECURSIVE field AS (
  SELECT row_number() OVER () AS row, doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS crc
  FROM documents
), leaf AS (
  SELECT row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295::UBIGINT) % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS other
  FROM field
), trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM leaf)),
placed AS (
  SELECT row, doc_id, tree, leaf, coalesce(other, leaf) AS now, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS idx
  FROM leaf JOIN trees ON leaf.source IS NOT DISTINCT FROM trees.source
), node AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM node WHERE n > 1 GROUP BY tree, level, idx // 16, n
), subroot AS (SELECT tree, digest AS subroot FROM node WHERE n = 1),
top AS (
  SELECT 0 AS level, tree AS idx, subroot AS digest, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY level, idx // 16, n
), run AS (SELECT tree, level, idx // 16 AS k, list(digest ORDER BY idx) AS run FROM node WHERE n > 1 GROUP BY ALL),
top_run AS (SELECT level, idx // 16 AS k, list(digest ORDER BY idx) AS run FROM top WHERE n > 1 GROUP BY ALL),
climb AS (
  SELECT row, tree, 0 AS level, idx, now AS digest, '' AS proof FROM placed
  UNION ALL
  SELECT c.row, c.tree, c.level + 1, c.idx // 16, sha256(array_to_string(run[: c.idx % 16], '') || c.digest || array_to_string(run[c.idx % 16 + 2 :], '')),
         c.proof || array_to_string(run[: c.idx % 16], '') || array_to_string(run[c.idx % 16 + 2 :], '')
  FROM climb c JOIN run r ON c.tree = r.tree AND c.level = r.level AND c.idx // 16 = r.k
), below AS (SELECT row, tree, digest, proof FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY level DESC) AS last FROM climb) WHERE last = 1),
above AS (
  SELECT row, 0 AS level, tree AS idx, digest, proof FROM below
  UNION ALL
  SELECT c.row, c.level + 1, c.idx // 16, sha256(array_to_string(run[: c.idx % 16], '') || c.digest || array_to_string(run[c.idx % 16 + 2 :], '')),
         c.proof || array_to_string(run[: c.idx % 16], '') || array_to_string(run[c.idx % 16 + 2 :], '')
  FROM above c JOIN top_run r ON c.level = r.level AND c.idx // 16 = r.k
), proof AS (SELECT row, digest AS folded_root, sha256(proof) AS proof_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY level DESC) AS last FROM above) WHERE last = 1)
SELECT doc_id, leaf, subroot, digest AS root, proof_sha256, folded_root, folded_root = digest AS verified
FROM placed JOIN subroot USING (tree) JOIN proof USING (row) JOIN top ON top.n = 1
"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True, full=False)


@query
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))
