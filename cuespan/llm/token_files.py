"""Token-id files: documents compressed one by one against a shared zstandard dictionary, with an index of offsets.

A folder holds two Parquet tables, so any store that Spark writes to will do: ``dictionary`` (one row: hash and bytes) and
``segments``, whose ``payload`` is a file of this layout, little-endian throughout:

    "TOKSEG01" | dictionary sha256, 32 bytes | id width in bytes, u4 | documents n, u4
    doc ids, n x i8 | id known, n x u1 | numbers of ids, n x u8 | offsets of frames, (n + 1) x u8 | frames

The frame of a document is its ids, ``width`` bytes each, compressed by itself: one document is read by its two offsets,
without its neighbours. Segments hold documents in ascending order and follow each other by (bucket, segment).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuespan.llm.common import in_slices, only, utf8
from cuespan.llm.word_bpe import words_of
from cuespan.session import checkpoint_dir

MAGIC = b"TOKSEG01"
HEAD = len(MAGIC) + 32 + 8
#: Bytes of frames after which a segment ends.
SEGMENT = 4 << 20


def ids_with_end(texts: list[bytes], path: str, end_id: int) -> list[np.ndarray]:
    ids, counts = words_of(path, False).encode(texts)
    ends = np.cumsum(counts)
    return [np.append(ids[e - c : e], np.uint32(end_id)) for e, c in zip(ends, counts)]


def serialized(ids: np.ndarray, width: int) -> bytes:
    if width == 2 and len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("an id does not fit the width")
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int, rows: int = 1000, longest: int = 1 << 15, size: int = 1 << 16) -> bytes:
    """A zstandard dictionary from serialized id arrays of about ``rows`` documents (twice that at most) of up to ``longest`` bytes.

    The documents are chosen by a hash of their text. With too few to train on, the dictionary is their plain content.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([serialized(ids, width) for ids in ids_with_end(utf8(batch.column("text")), path, end_id)], pa.binary())], ["content"])

    step = max(1, docs.count() // rows)
    chosen = docs.select("text").where((F.octet_length("text") <= longest) & (F.pmod(F.xxhash64("text"), F.lit(step)) == 0)).limit(2 * rows)
    samples = sorted(row[0] for row in chosen.mapInArrow(task, "content binary").collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def payload(dictionary_hash: bytes, width: int, ids: list[int | None], counts: list[int], frames: list[bytes]) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    parts = [
        MAGIC, dictionary_hash, np.array([width, len(ids)], "<u4").tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(),
        np.array([i is not None for i in ids], "u1").tobytes(), np.array(counts, "<u8").tobytes(), offsets.tobytes(), *frames,
    ]
    return b"".join(parts)


class Segment:
    """A payload with its index read; ``ids`` takes one document out."""

    def __init__(self, content: bytes, dictionary: bytes):
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token segment")
        if content[len(MAGIC) : len(MAGIC) + 32] != hashlib.sha256(dictionary).digest():
            raise ValueError("the segment was written with another dictionary")
        self.width, n = (int(x) for x in np.frombuffer(content, "<u4", 2, HEAD - 8))
        at = HEAD
        numbers = np.frombuffer(content, "<i8", n, at)
        known = np.frombuffer(content, "u1", n, at := at + 8 * n)
        self.doc_ids = [int(i) if k else None for i, k in zip(numbers, known)]
        self.counts = np.frombuffer(content, "<u8", n, at := at + n).astype(np.int64)
        self.offsets = np.frombuffer(content, "<u8", n + 1, at := at + 8 * n).astype(np.int64) + at + 8 * (n + 1)
        self.content = memoryview(content)
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, row: int) -> np.ndarray:
        frame = self.content[self.offsets[row] : self.offsets[row + 1]]
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.width}").astype("<u4")


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int = 1, width: int = 2, level: int = 3, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode whole texts with the tokenizer file at ``path``, append ``end_id``, and write token files to ``folder`` in ascending doc_id order.

    Ids are whole numbers; unknown ones come first. A null or empty text is just the end id. Rows of one id are ordered by
    the checksum of their ids; an id that would fill several of the ``parts`` (the session's shuffle partitions by default)
    is dealt over these by that checksum. An empty table gives a dictionary and no segment.
    """
    spark = docs.sparkSession
    source = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    dictionary = train_dictionary(source, path, end_id, width)
    digest = hashlib.sha256(dictionary).digest()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = np.array(source.agg(F.percentile_approx("doc_id", shares, 10 * parts)).first()[0] or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=level)
        for batch in in_slices(batches):
            rows = ids_with_end(utf8(batch.column("text")), path, end_id)
            ties = np.array([zlib.crc32(row.astype("<u4").tobytes()) for row in rows], np.int64)
            known = batch.column("doc_id")
            doc_ids = known.fill_null(np.iinfo(np.int64).min).to_numpy()
            # An id that is several bounds stands in all the buckets between them.
            first, last = np.searchsorted(bounds, doc_ids, "left"), np.searchsorted(bounds, doc_ids, "right")
            bucket = first + (ties * np.maximum(0, last - first) >> 32)
            frames = [writer.compress(serialized(row, width)) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [known, pa.array(bucket.astype(np.int32)), pa.array(ties), pa.array(list(map(len, rows)), pa.int64()), pa.array(frames, pa.binary())],
                ["doc_id", "bucket", "tie", "n_tokens", "frame"],
            )

    names = ["bucket", "segment", "n_docs", "n_tokens", "first_id", "last_id", "dictionary_hash", "payload"]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        bucket, number, size = None, 0, 0

        def segment() -> pa.RecordBatch:
            ids, counts, frames = held
            values = [bucket, number, len(ids), sum(counts), ids[0], ids[-1], digest.hex(), payload(digest, width, ids, counts, frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for doc_id, into, count, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bucket", "n_tokens", "frame"))):
                if held[0] and (into != bucket or size >= SEGMENT):
                    yield segment()
                    held = ([], [], [])
                    number, size = (number + 1 if into == bucket else 0), 0
                bucket = into
                held[0].append(doc_id)
                held[1].append(count)
                held[2].append(frame)
                size += len(frame)
        if held[0]:
            yield segment()

    coded = source.mapInArrow(encode, "doc_id bigint, bucket int, tie bigint, n_tokens bigint, frame binary")
    ordered = coded.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "tie")
    schema = "bucket int, segment int, n_docs bigint, n_tokens bigint, first_id bigint, last_id bigint, dictionary_hash string, payload binary"
    ordered.mapInArrow(assemble, schema).write.parquet(f"{folder}/segments")
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "hash string, content binary").coalesce(1).write.parquet(f"{folder}/dictionary")


def segment_starts(segments: DataFrame) -> DataFrame:
    """(bucket, segment, start): the number of ids before each segment, from its counts alone."""
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = segments.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    within = Window.partitionBy("bucket").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    inner = segments.select("bucket", "segment", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inner"))
    return inner.join(buckets, "bucket").select("bucket", "segment", (F.col("before") + F.col("inner")).alias("start"))


def read_token_files(spark: SparkSession, folder: str, ids: bool = True, where: Column | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian u4) and, with ``ids``, the ids.

    ``where`` is a condition on doc_id: only frames of documents that meet it are decompressed.
    """
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["content"])
    segments = spark.read.parquet(f"{folder}/segments")
    kinds = "bucket int, segment int, row int, doc_id bigint, own_start bigint, n_tokens bigint"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, number, content in zip(*(batch.column(c).to_pylist() for c in ("bucket", "segment", "payload"))):
                part = Segment(content, dictionary)
                n = len(part.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(part.doc_ids, pa.int64()), pa.array(np.cumsum(part.counts) - part.counts), pa.array(part.counts)],
                    ["bucket", "segment", "row", "doc_id", "own_start", "n_tokens"],
                )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, number, content, rows in zip(*(batch.column(c).to_pylist() for c in ("bucket", "segment", "payload", "rows"))):
                part = Segment(content, dictionary)
                rows = range(len(part.doc_ids)) if rows is None else rows
                before = np.cumsum(part.counts) - part.counts
                for start in range(0, len(rows), 1000):
                    some = list(rows[start : start + 1000])
                    found = [part.ids(row) for row in some]
                    columns = [
                        pa.array([bucket] * len(some), pa.int32()), pa.array([number] * len(some), pa.int32()), pa.array([part.doc_ids[r] for r in some], pa.int64()), pa.array(before[some]),
                        pa.array(list(map(len, found)), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()),
                    ]
                    listed = [pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))] if ids else []
                    yield pa.RecordBatch.from_arrays(columns + listed, ["bucket", "segment", "doc_id", "own_start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])

    if where is None:
        chosen = segments.select("bucket", "segment", "payload", F.lit(None).cast("array<int>").alias("rows"))
    else:
        rows = segments.select("bucket", "segment", "payload").mapInArrow(index, kinds).where(where).groupBy("bucket", "segment").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        chosen = segments.select("bucket", "segment", "payload").join(rows, ["bucket", "segment"])
    found = chosen.mapInArrow(documents, "bucket int, segment int, doc_id bigint, own_start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else ""))
    found = found.join(segment_starts(segments.select("bucket", "segment", "n_tokens")), ["bucket", "segment"])
    return found.select("doc_id", (F.col("start") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def token_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
