"""What the corpus operators share: reading tables, bytes of texts in tasks, the fold that holds labels out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``; Python's ``bytes.split`` cuts at the same six characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(docs: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under the operator's own names, so that no extra column can clash with what it adds."""
    return docs.select(*(named(source).alias(target) for target, source in columns.items()))


def plain_names(docs: DataFrame, *columns: str) -> tuple[DataFrame, ...]:
    """``docs`` with its columns named by place, so that none clashes with an operator's own, and the new names of ``columns``."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), *(f"c{docs.columns.index(c)}" for c in columns)


def text_hash(text: Column) -> Column:
    """128 bits that stand for a whole text, null as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def by_shuffle(keys: DataFrame) -> DataFrame:
    """``keys`` as the side that a join of whole documents builds on: both sides are dealt by key, at every size alike.

    The number of keys grows with the corpus, so it is never broadcast; hash tables spare sorting the texts.
    """
    return keys.hint("shuffle_hash")


def held_out(doc_id: Column) -> Column:
    """The fold no label is learnt from: crc32 of the id as text is 1 modulo 3; an unknown id is held out as well."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts' bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, so that work per slice fits in memory; a longer text is a slice of its own."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for row, length in enumerate(lengths):
            if row > start and size + length > most:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if start < len(lengths):
            yield batch.slice(start)
