"""Counting keys over all documents in one exchange of packed chunks.

A block is a run of documents in one scan task. Each block sends its distinct 64-bit keys once, dealt by
key range into buckets; a bucket sums a key over all blocks, so a very common key costs a
bucket one entry a block and a block one entry, whatever its frequency. Answers go back in the order sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a scan task in one block; texts average a few KB, so a block holds some MB.
BLOCK_ROWS = 2048


def with_block(docs: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``block``: the scan task's number and the run of ``rows`` rows in it. ``docs`` must be read from a table, so that a
    repeated scan deals rows out alike."""
    at: Column = F.monotonically_increasing_id()
    low = F.lit((1 << 33) - 1)
    return docs.withColumn("block", F.shiftleft(F.shiftright(at, 33), 33) + F.floor(at.bitwiseAND(low) / rows).cast("long"))


class WordKeys(dict):
    """Words (bytes) to 64-bit keys, each hashed once; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        key = self[word] = xxhash.xxh3_64_intdigest(word)
        return key

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 150_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


KEYS = WordKeys()


def lowered_words(text: bytes | None) -> list[bytes]:
    """Words as runs of anything but ASCII white space, A-Z lowered: what bytes.lower and bytes.split do."""
    return text.lower().split() if text else []


def mix(a: np.ndarray, b) -> np.ndarray:
    """A key of the ordered pair of keys; wraps around at 64 bits."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys: ascending keys have ascending buckets."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes of the integers, all lowest bytes first: the shuffle's compression then removes the high ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def sent_keys(ascending: np.ndarray) -> bytes:
    return planes(np.diff(ascending, prepend=np.uint64(0)))


def got_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)


def slices(ascending: np.ndarray, buckets: int):
    """(bucket, from, to) of each bucket that the keys reach."""
    own = bucket_of(ascending, buckets)
    cuts = np.flatnonzero(np.diff(own)) + 1
    edges = np.concatenate([[0], cuts, [len(own)]]) if len(own) else np.zeros(1, np.int64)
    return [(int(own[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def blocks_of(batches, most_bytes: int | None = None):
    """Tables of one block each, from a stream of batches with a ``block`` column in which a block's rows stand together.

    With ``most_bytes`` a block whose rows pass that comes in several tables, so that long texts don't add up.
    """
    held: list[pa.RecordBatch] = []
    of, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        if most_bytes and batch.nbytes > most_bytes:
            step = max(1, int(len(own) * most_bytes / batch.nbytes))
            cuts = sorted({*cuts, *range(0, len(own), step)})
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (of != own[a] or most_bytes and size >= most_bytes):
                yield of, pa.Table.from_batches(held)
                held, size = [], 0
            of = own[a]
            held.append(batch.slice(a, b - a))
            size += batch.nbytes * (b - a) // len(own)
    if held:
        yield of, pa.Table.from_batches(held)
