"""Token ids in patched frame-of-reference blocks.

File format: a Parquet table in which each row is one segment, part of a shard's id stream. A segment is a byte
string, all integers little-endian:

    "PFR1", u32 number of ids, u32 number of blocks, u32 end of each block's bytes in the body, then the body.

A block holds 128 ids (the last may hold fewer): u32 minimum, u8 width in bits, u8 number of exceptions, the
offsets from the minimum packed at that width (low bits only, first id in the lowest bits), then the exceptions'
places (u8 each) and their high parts (u32 each, the offset shifted right by the width). The width is the least that
holds the offset at ``percentile``; wider offsets are exceptions. The table's other rows tell where each document starts.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_blocks, written
from .encoding import Encoder

BLOCK, SEGMENT, PERCENTILE = 128, 1 << 16, 90.0
MAGIC = b"PFR1"
#: Documents that are encoded at once; shards whose sizes are added up together.
ROWS, RUN = 2048, 4096
#: Pieces that a worker remembers.
MEMO = 1_200_000
SCHEMA = "shard int, start long, n long, doc_id long, ord long, segment binary"


def _bytes_of(values: np.ndarray) -> np.ndarray:
    """The little-endian bytes of unsigned 32-bit integers, a row each."""
    return np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of them for each i."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One segment's bytes. The blocks of one width are packed together."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return MAGIC + struct.pack("<II", 0, 0)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n], full[n:] = ids, ids[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(1)
    off = full - low[:, None]
    rank = min(BLOCK - 1, max(0, int(np.ceil(percentile / 100 * BLOCK)) - 1))
    width = np.ceil(np.log2(np.partition(off, rank, 1)[:, rank].astype(np.float64) + 1)).astype(np.int64)
    high = off >> np.minimum(width, 31).astype(np.uint32)[:, None]
    high[width == 32] = 0
    block, place = np.nonzero(high)
    odd = np.bincount(block, minlength=blocks)
    ends = np.cumsum(6 + BLOCK * width // 8 + 5 * odd)
    begins = np.concatenate([[0], ends[:-1]])
    body = np.empty(int(ends[-1]), np.uint8)
    body[begins[:, None] + np.arange(4)] = _bytes_of(low)
    body[begins + 4], body[begins + 5] = width, odd
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        bits = np.unpackbits(_bytes_of(off[at]).reshape(len(at), BLOCK, 4), axis=2, count=w, bitorder="little")
        packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        body[(begins[at] + 6)[:, None] + np.arange(BLOCK * w // 8)] = packed
    tail = begins + 6 + BLOCK * width // 8
    body[_runs(tail, odd)] = place
    body[_runs(tail + odd, 4 * odd)] = _bytes_of(high[block, place]).ravel()
    return MAGIC + struct.pack("<II", n, blocks) + ends.astype("<u4").tobytes() + body.tobytes()


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a segment, or those of its blocks ``first`` up to ``last`` alone, found by the index of block ends."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, blocks = struct.unpack_from("<II", segment, 4)
    ends = np.frombuffer(segment, "<u4", blocks, 12).astype(np.int64)
    base = 12 + 4 * blocks
    last = blocks if last is None else min(last, blocks)
    raw = np.frombuffer(segment, np.uint8)
    begins = base + np.concatenate([[0], ends[:-1]]).astype(np.int64)[first:last]
    if not len(begins):
        return np.empty(0, np.uint32)
    low = raw[begins[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, odd = raw[begins + 4].astype(np.int64), raw[begins + 5].astype(np.int64)
    out = np.zeros((len(begins), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        packed = raw[begins[at][:, None] + 6 + np.arange(BLOCK * w // 8)]
        # eight ids take w bytes: one window of eight bytes holds what an id needs
        wide = np.concatenate([packed, np.zeros((len(at), 8), np.uint8)], axis=1)
        first_bit = np.arange(BLOCK) * w
        windows = wide[:, (first_bit // 8)[:, None] + np.arange(5 if w > 25 else 4)]
        if w > 25:
            windows = np.concatenate([windows, np.zeros((*windows.shape[:2], 3), np.uint8)], axis=2)
            held = np.ascontiguousarray(windows).view("<u8")[:, :, 0] >> (first_bit % 8).astype(np.uint64)
            out[at] = (held & np.uint64((1 << w) - 1)).astype(np.uint32)
        else:
            held = np.ascontiguousarray(windows).view("<u4")[:, :, 0] >> (first_bit % 8).astype(np.uint32)
            out[at] = held & np.uint32((1 << w) - 1)
    tail = begins + 6 + BLOCK * width // 8
    block = np.repeat(np.arange(len(begins)), odd)
    high = raw[_runs(tail + odd, 4 * odd)].view("<u4")
    out[block, raw[_runs(tail, odd)]] |= high << width[block].astype(np.uint32)
    out += low[:, None]
    return out.reshape(-1)[: n - first * BLOCK if last == blocks else None]


def _write_shard(path: str, percentile: float):
    """Encodes the rows of a task, in order: a row for each segment and a row for each document's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), Encoder.at(path, MEMO)
        place, done, order, held = 0, 0, 0, np.empty(0, np.uint32)
        names = ("shard", "start", "n", "doc_id", "ord", "segment")

        def segments(flat):
            nonlocal done
            rows = [(done + i, min(SEGMENT, len(flat) - i), pack(flat[i : i + SEGMENT], percentile)) for i in range(0, len(flat), SEGMENT)]
            done += len(flat)
            k = len(rows)
            cols = [pa.array([shard] * k, pa.int32()), *[pa.array([r[j] for r in rows], pa.int64()) for j in (0, 1)], pa.nulls(k, pa.int64()), pa.array([-1] * k, pa.int64()), pa.array([r[2] for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, list(names))

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                k = some.num_rows
                ids, borders = encoder.encode(some.column("text"), end=0)
                cols = [pa.array(np.full(k, shard, np.int32)), pa.array(place + borders[:-1]), pa.array(np.diff(borders)), some.column("doc_id"), pa.array(order + np.arange(k)), pa.nulls(k, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, list(names))
                place, order = place + len(ids), order + k
                held = np.concatenate([held, ids])
                full = len(held) // SEGMENT * SEGMENT
                if full:
                    yield segments(held[:full])
                    held = held[full:]
        if len(held):
            yield segments(held)

    return run


def write_blocks(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", percentile: float = PERCENTILE) -> DataFrame:
    """Encodes ``docs`` and writes the table of segments and document starts; returns it as read back.

    Documents stand in ascending ``doc_id`` order, null ids first and ties by text; each is followed by id 0. Null texts are empty.
    Shards are ranges of ids, so one huge source or group of copies spreads over shards.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", "text"]
    ranged = docs.repartitionByRange(n_blocks(docs, block_mb=8), "doc_id").sortWithinPartitions(*order)
    return written(ranged.mapInArrow(_write_shard(tokenizer, percentile), SCHEMA), "token-blocks")


def _read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole shards in the order written: documents' starts, then the segments that hold their ids."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["shard", "doc_id", "start", "n_tokens", "ids_crc32"]
    waiting: deque[list] = deque()  # shard, doc_id, start, n, ids read, crc
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("shard", "start", "n", "doc_id", "segment")]
        for shard, start, n, doc_id, segment in zip(*cols, strict=True):
            if segment is None:
                waiting.append([shard, doc_id, start, n, 0, 0])
                continue
            raw = memoryview(unpack(segment).astype("<u4").tobytes())
            while waiting and waiting[0][2] < start + n:
                doc = waiting[0]
                at = doc[2] + doc[4] - start
                if doc[0] != shard or at < 0:
                    raise ValueError("the table of token blocks has a gap")
                part = raw[4 * at : 4 * (at + doc[3] - doc[4])]
                doc[5] = zlib.crc32(part, doc[5])
                doc[4] += len(part) // 4
                if doc[4] < doc[3]:
                    break
                out.append((doc[0], doc[1], doc[2], doc[3], doc[5]))
                waiting.popleft()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if waiting:
        raise ValueError("the table of token blocks ends within a document")


def read_blocks(table: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, its ids decoded from the segments.

    ``table`` is what :func:`write_blocks` returns: a shard is one file with one row group, which one task reads in order.
    """
    docs = table.mapInArrow(_read_shard, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # a row for each shard (a few for each GB), added up in runs of shards first, so that no task sees more than a run or a row a run
    sizes = table.where("segment is null").groupBy("shard").agg(F.sum("n").alias("n")).withColumn("run", F.floor(F.col("shard") / RUN))
    runs = sizes.groupBy("run").agg(F.sum("n").alias("all"))
    runs = runs.select(F.col("run").alias("_run"), (F.sum("all").over(W.orderBy("run")) - F.col("all")).alias("before"))
    within = F.sum("n").over(W.partitionBy("run").orderBy("shard")) - F.col("n")
    base = sizes.withColumn("within", within).join(runs, F.col("run") == F.col("_run"))
    base = base.select(F.col("shard").alias("_shard"), (F.col("within") + F.col("before")).alias("base"))
    out = docs.join(base, F.col("shard") == F.col("_shard"))
    return out.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_blocks(write_blocks(docs, public_tokenizers.path("byte_bpe_50k.json")))
