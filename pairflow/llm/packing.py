"""Best-fit packing by length patterns: non-negative least squares over the length histogram, residuals by best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import unplaced, written
from .encoding import Encoder

SIZE = 2048
#: Partners tried for a length when patterns of three are listed, and rounds of the least-squares fit.
PARTNERS, FIT_ROUNDS = 16, 800
#: Documents that are encoded at once.
ROWS = 2048


def patterns(counts: np.ndarray) -> list[tuple[int, ...]]:
    """Length patterns that fill a sequence exactly: pairs, triples and runs of one length with a rest.

    ``counts[n]`` is the number of pieces of length ``n``; patterns hold only lengths that occur.
    """
    size = len(counts) - 1
    have = np.flatnonzero(counts)
    found = {(size,)} if counts[size] else set()
    mass = np.cumsum(counts[have])
    if not len(have):
        return []
    spread = have[np.searchsorted(mass, np.linspace(1, mass[-1], PARTNERS * 4))]
    spread = np.unique(spread)[:: max(1, len(np.unique(spread)) // (2 * PARTNERS))]
    for a in have.tolist():
        if 0 < size - a and counts[size - a]:
            found.add(tuple(sorted((a, size - a), reverse=True)))
        for b in spread.tolist():
            c = size - a - b
            if c > 0 and counts[c]:
                found.add(tuple(sorted((a, b, c), reverse=True)))
        for k in range(2, min(9, size // a + 1)):
            rest = size - k * a
            if rest == 0 or rest > 0 and counts[rest]:
                found.add(tuple(sorted((a,) * k + (rest,) * (rest > 0), reverse=True)))
    return sorted(found, reverse=True)


def fit(found: list[tuple[int, ...]], counts: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - counts||^2 by accelerated projected gradients; A is kept sparse."""
    if not found:
        return np.zeros(0)
    col = np.repeat(np.arange(len(found)), [len(p) for p in found])
    row = np.concatenate([np.array(p) for p in found])
    h = counts.astype(np.float64)
    scale = max(h.max(), 1.0)
    h = h / scale
    times = lambda x: np.bincount(row, x[col], len(h))
    back = lambda r: np.bincount(col, r[row], len(found))
    v = np.ones(len(found))
    for _ in range(30):  # largest eigenvalue of A'A
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - back(times(y) - h) / top)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / s * (nxt - x), nxt, s
    return x * scale


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """``(pattern, repeats)`` that use every piece of the histogram once; the work depends on the sequence size alone."""
    left = counts.astype(np.int64).copy()
    found = patterns(counts)
    x = fit(found, counts)
    out: list[tuple[tuple[int, ...], int]] = []
    for i in np.argsort(-x, kind="stable"):
        lengths, times = np.unique(found[i], return_counts=True)
        n = int(min(np.floor(x[i] + 0.5), (left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            out.append((found[i], n))
    # best fit decreasing over what is left; bins of one content are one entry
    size = len(counts) - 1
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for a in np.flatnonzero(left)[::-1].tolist():
        n = int(left[a])
        while n:
            room = min((f for f in free if f >= a), default=None)
            if room is None:
                k = size // a
                group = ((a,) * k, n // k) if n >= k else ((a,) * n, 1)
                n -= len(group[0]) * group[1]
                free.setdefault(size - a * len(group[0]), []).append(group)
                continue
            held, bins = free[room].pop()
            if not free[room]:
                del free[room]
            used = min(n, bins)
            if bins > used:
                free.setdefault(room, []).append((held, bins - used))
            free.setdefault(room - a, []).append(((*held, a), used))
            n -= used
    merged: dict[tuple[int, ...], int] = {}
    for p, n in [*out, *(g for gs in free.values() for g in gs)]:
        p = tuple(sorted(p, reverse=True))
        merged[p] = merged.get(p, 0) + n
    return sorted(merged.items(), reverse=True)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), by length and rank."""
    rows, used, base = [], {}, 0
    for p, n in planned:
        offset = 0
        for a in sorted(set(p), reverse=True):
            m = p.count(a)
            rows.append((a, used.get(a, 0), m, base, offset))
            used[a] = used.get(a, 0) + m * n
            offset += m * a
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _cut(path: str, size: int):
    """Documents to pieces: a document's place, its ids' checksum, and how many pieces of that length the task had before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seen = TaskContext.get().partitionId(), Encoder.at(path), [0] * (size + 1)
        names = ("part", "ord", "doc_id", "piece", "start", "length", "ids_crc32")
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some, out = batch.slice(at, ROWS), []
                ids, borders = encoder.encode(some.column("text"), end=0)
                raw = memoryview(ids.astype("<u4").tobytes())
                for doc_id, a, b in zip(some.column("doc_id").to_pylist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                    for piece, i in enumerate(range(a, b, size)):
                        n = min(size, b - i)
                        out.append((part, seen[n], doc_id, piece, i - a, n, zlib.crc32(raw[4 * i : 4 * (i + n)])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    return run


def _place(table: np.ndarray):
    """Ranks to sequences and offsets, by search in the table of slots."""
    key = (table[:, 0] << 48) | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            row = table[np.searchsorted(key, (length << 48) | rank, "right") - 1]
            within = rank - row[:, 1]
            extra = [pa.array(row[:, 3] + within // row[:, 2]), pa.array(row[:, 4] + within % row[:, 2] * length)]
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            keep[3] = keep[3].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*keep, *extra], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: every piece of every document in a sequence of at most ``size`` ids.

    A document is its ids and id 0; only longer ones are cut. The histogram (at most ``size`` rows) comes to the driver, the
    plan (repeat counts of length patterns) goes back, and each piece finds its place by its rank among
    pieces of its length: the task's count before it, plus the counts of earlier tasks. Null texts
    count as empty, repeated rows each are packed, an empty table gives no rows.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = docs.mapInArrow(_cut(tokenizer, size), "part int, ord long, doc_id long, piece int, start long, length int, ids_crc32 long")
    pieces = written(pieces, "pieces")
    tasks = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    tasks = written(tasks, "piece-counts")
    counts = np.zeros(size + 1, np.int64)
    for length, n in tasks.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    table = slots(plan(counts))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    tasks = tasks.select(unplaced(F.col("length").cast("long"), "bigint").alias("_length"), F.col("part").alias("_part"), before.alias("before"))
    # a row for each length and task: it grows with the tasks, so it is joined by key and not sent to all
    ranked = pieces.join(tasks.hint("merge"), (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("ord")).alias("rank"))
    return ranked.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
