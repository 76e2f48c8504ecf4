"""Charset cascade over a corpus of raw documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Encodings tried in order after UTF-8.
FALLBACKS = ("gb18030", "gbk", "utf-16")


def _cascade(raw: bytes) -> str:
    for name in FALLBACKS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", errors="ignore")


@F.pandas_udf(StringType())
def _decoded(contents: pd.Series) -> pd.Series:
    return contents.map(lambda raw: None if raw is None else _cascade(bytes(raw)))


def decode_corpus(docs: DataFrame) -> DataFrame:
    """(doc_id, content) to (doc_id, text). One pass; valid UTF-8 stays in the JVM, and the Arrow function gets null for it."""
    as_text = F.col("content").cast("string")
    valid = F.when(F.is_valid_utf8(as_text), as_text)
    other = _decoded(F.when(~F.is_valid_utf8(as_text), F.col("content")))
    return docs.select("doc_id", F.coalesce(valid, other).alias("text"))


def read_raw(spark, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("doc_id"), "content")
