"""Token-ID output as length-delimited binary records with an offset index.

File format: frames one after another. A frame is

    length of body     8 bytes, little-endian
    masked checksum    4 bytes, of the 8 length bytes
    body               doc_id (8 bytes, signed), bytes per id (1), flag (1: doc_id is null), ids
    masked checksum    4 bytes, of the body
    newline            1 byte

Checksums are CRC-32, rotated right by 15 bits and offset by a constant, so
that a checksum stored within checked data does not weaken it. Frames go
through Spark's own writer (the newline is its record separator), so any store
that Spark writes can hold them; reading takes lengths, never separators.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, scratch_path
from .tokens import Encoder

_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<qBB")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    body = _BODY.pack(doc_id or 0, width, doc_id is None) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(body))
    return size + struct.pack("<I", masked(size)) + body + struct.pack("<I", masked(body))


def frames(data: bytes, start: int = 0, most: int | None = None):
    """(offset, doc_id, ids) of each frame from ``start``; raises on damage."""
    at = start
    while at < len(data) and most != 0:
        size, check = _HEAD.unpack_from(data, at)
        if check != masked(data[at : at + 8]):
            raise ValueError(f"damaged length at byte {at}")
        body = data[at + 12 : at + 12 + size]
        (check,) = struct.unpack_from("<I", data, at + 12 + size)
        if len(body) < size or check != masked(body):
            raise ValueError(f"damaged record at byte {at}")
        doc_id, width, null = _BODY.unpack_from(body)
        yield at, None if null else doc_id, np.frombuffer(body, f"<u{width}", offset=_BODY.size)
        at += 12 + size + 5
        most = None if most is None else most - 1


def write_records(docs: DataFrame, path: str, tokenizer: str, *, spaces: bool, end_id: int, files: int | None = None) -> None:
    """Encode every whole text and write frames in ascending doc_id order.

    Nulls: a null text is empty (its record holds ``end_id`` alone); a null
    doc_id comes first. Rows with equal doc_id lie next to each other, ordered
    by text. No rows give no files with content.
    """
    if files is None:  # 16 MB of text a file, and more (up to 128 MB) where that gives over 4096 files
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-size // min(128 << 20, max(16 << 20, size // 4096))))
    laid = docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def encoded(batches):
        model = None
        for b in batches:
            model = model or Encoder(tokenizer, spaces)
            width = 2 if max(model.model.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(keys), 256):
                got = model.encode(texts[lo : lo + 256])
                out = [frame(k, np.append(i, np.uint32(end_id)), width) for k, i in zip(keys[lo : lo + 256], got)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    made = laid.mapInArrow(encoded, "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def build_index(spark: SparkSession, path: str, index: str) -> None:
    """Read the files, check every record, and write ``index`` (Parquet).

    Per record: file, offset, doc_id, before (ids of earlier records of its
    file), n_tokens, ids_crc32 (of the ids as 32-bit integers).
    """
    names = ["file", "offset", "doc_id", "before", "n_tokens", "ids_crc32"]

    def listed(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(at, k, len(i), zlib.crc32(i.astype("<u4").tobytes())) for at, k, i in frames(data.as_py())]
                at, k, n, c = zip(*rows) if rows else ((), (), (), ())
                before = np.cumsum(n, dtype=np.int64) - np.array(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), *[pa.array(x, pa.int64()) for x in (at, k, before, n, c)]], names)

    rows = _files(spark, path).select("path", "content").mapInArrow(listed, "file string, offset long, doc_id long, before long, n_tokens long, ids_crc32 long")
    rows.write.parquet(index)


def read_records(spark: SparkSession, path: str, index: str, wanted: DataFrame | None = None) -> DataFrame:
    """Records by the index, of ``wanted`` doc_ids or all: file, offset, doc_id, ids.

    Only the records asked for are decoded and checked.
    """
    places = spark.read.parquet(index)
    if wanted is not None:
        places = places.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    per = places.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    content = _files(spark, path).select(F.col("path").alias("file"), "content").join(per, "file")

    def decoded(batches):
        for b in batches:
            for name, data, offsets in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                raw = data.as_py()
                for lo in range(0, len(offsets), 512):
                    part = [next(frames(raw, at, 1)) for at in offsets[lo : lo + 512]]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2].astype(np.int64) for p in part], pa.list_(pa.int64()))], ["file", "offset", "doc_id", "ids"])

    return content.select("file", "content", "offsets").mapInArrow(decoded, "file string, offset long, doc_id long, ids array<long>")


def record_digests(spark: SparkSession, index: str) -> DataFrame:
    """Per record, as read back from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all records before it, in file order (files are
    named in doc_id order). Files are few, one for about 16 MB of text, and
    only their totals pass through one task.
    """
    rows = spark.read.parquet(index)
    name = F.element_at(F.split("file", "/"), -1)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("file").alias("_file"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    return rows.join(bases, rows["file"] == bases["_file"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op10_records(spark, sf_dir):
    import public_tokenizers

    path = scratch_path(spark, "records")
    write_records(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), spaces=False, end_id=1)
    index = scratch_path(spark, "records-index")
    build_index(spark, path, index)
    return record_digests(spark, index)
