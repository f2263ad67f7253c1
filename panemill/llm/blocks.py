"""Token ids in patched frame-of-reference blocks.

A segment is a self-contained piece of a token file, in little-endian order:

    magic ``PFB1``; u32 documents, u32 blocks; u64 ids
    for each document: i64 id, u8 1 if the id is null, u64 number of ids
    block index: u32 start of each block, from the first block's start
    blocks of 128 ids (the last may hold fewer, the rest is filled with its minimum):
        u32 minimum, u8 width, u8 exceptions
        128 * width bits: the low bits of id - minimum, highest bit first
        for each exception: u8 place; for each exception: u32 the bits above the width

The width is the least that holds the given percentile of a block's differences; what does not fit is an exception.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panemill.llm.common import give_back, table, written
from panemill.llm.tokens import tokenizer_path, word_encoder

MAGIC = b"PFB1"
BLOCK = 128
PERCENTILE = 90
END_ID = 2
#: A segment is closed with the document that takes it past so many ids.
SEGMENT_IDS = 1 << 16
_HEAD, _BLOCK_HEAD = struct.Struct("<4sIIQ"), 6
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("ids", "<u8")])


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """The starts and the bytes of the blocks that hold ``ids`` (unsigned 32-bit, any values)."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return np.zeros(0, "<u4"), b""
    whole = np.empty(count * BLOCK, np.uint32)
    whole[: len(ids)] = ids
    whole[len(ids) :] = whole[(count - 1) * BLOCK : len(ids)].min()
    whole = whole.reshape(count, BLOCK)
    least = whole.min(axis=1)
    above = whole - least[:, None]
    fits = np.partition(above, BLOCK * percentile // 100 - 1, axis=1)[:, BLOCK * percentile // 100 - 1]
    width = np.ceil(np.log2(fits.astype(np.int64) + 1)).astype(np.int64)
    odd = above > ((1 << width) - 1).astype(np.uint32)[:, None]
    odds = odd.sum(axis=1)
    starts = np.concatenate([[0], np.cumsum(_BLOCK_HEAD + width * (BLOCK // 8) + 5 * odds)])
    out = np.zeros(starts[-1], np.uint8)
    head = np.zeros(count, np.dtype([("least", "<u4"), ("width", "u1"), ("odds", "u1")]))
    head["least"], head["width"], head["odds"] = least, width, odds
    out[starts[:-1, None] + np.arange(_BLOCK_HEAD)] = head.view(np.uint8).reshape(count, _BLOCK_HEAD)
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        bits = np.unpackbits(above[of].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - w :]
        packed = np.packbits(bits.reshape(len(of), -1), axis=1)
        out[starts[of][:, None] + _BLOCK_HEAD + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(odds) - odds, odds)
    at = starts[block] + _BLOCK_HEAD + width[block] * (BLOCK // 8)
    out[at + nth] = place
    out[(at + odds[block] + 4 * nth)[:, None] + np.arange(4)] = (above[block, place].astype(np.int64) >> width[block]).astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts[:-1].astype("<u4"), out.tobytes()


def unpack_blocks(starts: np.ndarray, body: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` ids of the blocks that begin at ``starts``; any run of blocks can be read alone."""
    if not len(starts):
        return np.zeros(0, "<u4")
    starts = starts.astype(np.int64)
    head = body[starts[:, None] + np.arange(_BLOCK_HEAD)].copy().view(np.dtype([("least", "<u4"), ("width", "u1"), ("odds", "u1")]))[:, 0]
    width, odds = head["width"].astype(np.int64), head["odds"].astype(np.int64)
    ids = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        packed = body[starts[of][:, None] + _BLOCK_HEAD + np.arange(w * BLOCK // 8)]
        bits = np.zeros((len(of) * BLOCK, 32), np.uint8)
        bits[:, 32 - w :] = np.unpackbits(packed, axis=1).reshape(-1, w)
        ids[of] = np.packbits(bits, axis=1).view(">u4").reshape(len(of), BLOCK)
    block = np.repeat(np.arange(len(starts)), odds)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(odds) - odds, odds)
    at = starts[block] + _BLOCK_HEAD + width[block] * (BLOCK // 8)
    high = body[(at + odds[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.int64)
    ids[block, body[at + nth]] += (high << width[block]).astype(np.uint32)
    ids += head["least"][:, None]
    return ids.reshape(-1)[:count].astype("<u4", copy=False)


def pack_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """Documents' ids, each as little-endian unsigned 32-bit, as one segment."""
    docs = np.array([(0 if d is None else d, d is None, len(x) // 4) for d, x in zip(doc_ids, ids, strict=True)], _DOC)
    every = np.frombuffer(b"".join(ids), "<u4")
    starts, body = pack_blocks(every)
    return _HEAD.pack(MAGIC, len(docs), len(starts), len(every)) + docs.tobytes() + starts.tobytes() + body


def unpack_segment(segment: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the segment, its ids) of each document of a segment."""
    magic, n_docs, n_blocks, n_ids = _HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a segment of a token file")
    docs = np.frombuffer(segment, _DOC, n_docs, _HEAD.size)
    at = _HEAD.size + docs.nbytes
    starts = np.frombuffer(segment, "<u4", n_blocks, at)
    ids = unpack_blocks(starts, np.frombuffer(segment, np.uint8, offset=at + starts.nbytes), n_ids)
    start = 0
    for doc_id, null, count in docs.tolist():
        yield None if null else doc_id, start, ids[start : start + count]
        start += count


def write_token_files(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, as_they_come: bool = False) -> DataFrame:
    """Encode whole texts and write their ids in ascending doc_id order to token files in the shared folder.

    Returns the written table (part, start, n_ids, segment): parts are in doc_id order, ``start`` counts the ids
    before a segment in its part. Each document ends with ``end_id``. ``as_they_come`` keeps documents in the partitions
    and the order that they are read in, without a shuffle: for tables that have been shuffled for training before. Null
    text counts as empty, a null id sorts first; rows that share an id are ordered by a hash of their text, then by the
    text; extra columns are left out; an empty table gives no row.

    Spark deals the documents by ranges of doc_id and that hash, so that no task holds more than its share, however
    many rows share an id; texts are never sampled for the ranges. A segment is bounded by 65,536 ids and one document,
    however long that is. Files are committed by Spark's writer: a lost task writes again, and readers see whole
    files alone.
    """
    path = tokenizer or tokenizer_path()
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = word_encoder(path), TaskContext.get().partitionId(), 0
        some_docs: list[int | None] = []
        some_ids: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([pack_segment(some_docs, some_ids)], pa.binary())], names=["part", "start", "n_ids", "segment"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.of(text.as_buffer().to_pybytes() if text.is_valid else b"")
                some_docs.append(doc_id)
                some_ids.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= SEGMENT_IDS:
                    yield row()
                    start += held
                    some_docs, some_ids, held = [], [], 0
        if held:
            yield row()
        give_back()

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), "text")
    if not as_they_come:
        hashed = rows.withColumn("hash", F.xxhash64("text"))
        rows = hashed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return written(rows.mapInArrow(encode, "part int, start long, n_ids long, segment binary"), "token_files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    ``start`` counts the ids of all documents before it. Of each part only the number of its ids is summed up over
    all parts: one row per written file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, segment in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                rows = [(d, part, start + at, len(ids), zlib.crc32(ids.tobytes())) for d, at, ids in unpack_segment(segment)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    found = files.select("part", "start", "segment").mapInArrow(decode, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))
