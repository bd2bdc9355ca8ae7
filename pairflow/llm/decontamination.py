"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import mix
from .common import written

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint in blocks, and the Hamming radius. Two fingerprints within it differ by ``NEAR`` bits or fewer in one block at least.
BLOCKS, BLOCK_BITS, NEAR = 16, 12, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Items that come to tasks at once, by the MB of their texts and by their number (8 KB of index each); a larger benchmark takes
#: more passes over the documents.
ITEMS_MB, MOST_ITEMS = 2.0, 8192

_MARKS = re.compile(r"[\W_]+")


class PlainKeys(dict):
    """Words to keys of their letters and digits in lower case; words without any have key 0."""

    def __missing__(self, word: bytes) -> int:
        plain = _MARKS.sub("", word.decode("utf-8", "replace").lower())
        key = self[word] = (xxhash.xxh3_64_intdigest(plain.encode()) | 1) if plain else 0
        return key


PLAIN = PlainKeys()


def plain_keys(text: bytes | None) -> np.ndarray:
    if len(PLAIN) > 300_000:
        PLAIN.clear()
    w = text.split() if text else []
    keys = np.fromiter(map(PLAIN.__getitem__, w), np.uint64, len(w))
    return keys[keys != 0]


def shingles(keys: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Keys of all runs of k words in order; a shorter text is one run."""
    if not len(keys):
        return keys
    n = min(k, len(keys))
    out = keys[: len(keys) - n + 1]
    for i in range(1, n):
        out = mix(out, keys[i : len(keys) - n + 1 + i])
    return out if n == k else mix(out, np.uint64(n))


def elements(run: np.ndarray) -> np.ndarray:
    """Shingles as a set: the second occurrence of one is another element than the first, and so on."""
    order = np.argsort(run, kind="stable")
    new = np.concatenate([[True], run[order][1:] != run[order][:-1]])
    first = np.flatnonzero(new)
    times = np.empty(len(run), np.uint64)
    times[order] = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
    return np.where(times > 0, mix(run, times), run)


def signs(s: np.ndarray) -> np.ndarray:
    """+1 or -1 for each element and each bit of a fingerprint."""
    words = [mix(s, np.uint64(0x51AB + i)) for i in range(-(-BLOCKS * BLOCK_BITS // 64))]
    bits = np.unpackbits(np.ascontiguousarray(np.stack(words, 1)).view(np.uint8), axis=1)
    return bits[:, : BLOCKS * BLOCK_BITS].astype(np.float64) * 2 - 1


def blocks(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, a row each: their blocks as integers."""
    bits = (sums > 1e-6).reshape(len(sums), BLOCKS, BLOCK_BITS)
    return bits @ (1 << np.arange(BLOCK_BITS))


#: For all pairs of a block's values the bits that differ are those of their exclusive or.
_ONES = np.array([i.bit_count() for i in range(1 << BLOCK_BITS)], np.uint8)
_BALL = np.flatnonzero(_ONES <= NEAR)


class Items:
    """A bounded set of benchmark items with their weighted shingles and the index of their fingerprints.

    A shingle counts in a fingerprint by the root of its weight, so that the cosine of two sets as similar as s is 2s / (1 + s) at least
    and a bit differs with a chance of 0.152 at most at 0.8. The index has, for each size of item, block and value of the block, the items
    within ``NEAR`` bits. ``shared`` has the keys in order and the holders of all shingles that two items or more of the whole benchmark hold.
    """

    def __init__(self, items: list[tuple[int, str, int]], shared: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY, k: int = SHINGLE):
        self.k, self.least = k, least
        # rarer shingles weigh more; a shingle that no item holds weighs as one that a single item holds
        self.shared, self.shared_weight = shared[0], 1.0 / (1.0 + np.log(shared[1]))
        keys = [(i, plain_keys((t or "").encode()), times) for i, t, times in items]
        keys = [x for x in keys if len(x[1])]
        self.ids = [i for i, _, _ in keys]
        self.times = [times for _, _, times in keys]
        self.size = [len(x) for _, x, _ in keys]
        runs = [shingles(x, k) for _, x, _ in keys]
        self.bags = [self.bag(r) for r in runs]
        prints = blocks(np.concatenate([self.sums(r) for r in runs])) if runs else np.empty((0, BLOCKS), np.int64)
        self.prints = prints
        self.of_size = {n: np.flatnonzero(np.array(self.size) == n) for n in set(self.size)}
        self.index = {}
        for n, own in self.of_size.items():
            near = np.zeros((BLOCKS, 1 << BLOCK_BITS, -(-len(own) // 8)), np.uint8)
            for at, i in enumerate(own):
                for b in range(BLOCKS):
                    near[b, prints[i, b] ^ _BALL, at // 8] |= 128 >> at % 8
            self.index[n] = near
        holders = defaultdict(set)
        for i, r in enumerate(runs):
            for s in r.tolist():
                holders[s].add(self.size[i])
        self.sizes_of = {s: tuple(n) for s, n in holders.items()}
        self.known = np.array(sorted(holders), np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def weights(self, run: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.ones(len(run))
        at = np.minimum(np.searchsorted(self.shared, run), len(self.shared) - 1)
        return np.where(self.shared[at] == run, self.shared_weight[at], 1.0)

    def bag(self, run: np.ndarray) -> dict[int, float]:
        """Shingles to weights, each as often as it occurs."""
        out: dict[int, float] = defaultdict(float)
        for s, w in zip(run.tolist(), self.weights(run).tolist(), strict=True):
            out[s] += w
        return out

    def sums(self, run: np.ndarray) -> np.ndarray:
        """What the bits of a window's fingerprint are the signs of, as a row."""
        return (signs(elements(run)) * np.sqrt(self.weights(run))[:, None]).sum(0)[None]

    def hits(self, run: np.ndarray) -> np.ndarray:
        """Places of shingles that some item holds. A window without one shares nothing with any item and needs no fingerprint."""
        at = np.flatnonzero(self.seen[(run & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(at):
            found = np.minimum(np.searchsorted(self.known, run[at]), len(self.known) - 1)
            at = at[self.known[found] == run[at]]
        return at

    def window_prints(self, part: np.ndarray, own: int) -> np.ndarray:
        """Fingerprints of all windows of ``own`` shingles over ``part`` (one of the whole part if that is shorter)."""
        own = min(own, len(part))
        n = len(part) - own + 1
        if n == 1:
            return blocks(self.sums(part))
        total = np.concatenate([np.zeros((1, BLOCKS * BLOCK_BITS)), np.cumsum(signs(part) * np.sqrt(self.weights(part))[:, None], 0)])
        sums = total[own:] - total[:n]
        # windows in which a shingle occurs again count its occurrences apart
        order = np.argsort(part, kind="stable")
        again = part[order][1:] == part[order][:-1]
        before, after = order[:-1][again], order[1:][again]
        close = after - before < own
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, np.maximum(0, after[close] - own + 1), 1)
        np.add.at(marks, np.minimum(n, before[close] + 1), -1)
        for q in np.flatnonzero(np.cumsum(marks[:n]) > 0).tolist():
            sums[q] = self.sums(part[q : q + own])[0]
        return blocks(sums)

    def matches(self, keys: np.ndarray) -> list[tuple[int, float, int]]:
        """``(item, similarity, first word)`` of the best window for each item that a window matches."""
        run = shingles(keys, self.k)
        at = self.hits(run)
        if not len(at):
            return []
        places = defaultdict(list)
        for p, s in zip(at.tolist(), run[at].tolist(), strict=True):
            for n in self.sizes_of[s]:
                places[n].append(p)
        best: dict[int, tuple[float, int]] = {}
        for size, held in sorted(places.items()):
            own, items, index = max(1, size - self.k + 1), self.of_size[size], self.index[size]
            for lo, hi in _ranges(held, own, max(0, len(run) - own)):
                prints = self.window_prints(run[lo : hi + own], own)
                near = index[0, prints[:, 0]]
                for b in range(1, BLOCKS):
                    near = near | index[b, prints[:, b]]
                window, item = np.nonzero(np.unpackbits(near, axis=1, count=len(items)))
                item = items[item]
                within = _ONES[prints[window] ^ self.prints[item]].sum(1) <= RADIUS
                for q, i in zip(window[within].tolist(), item[within].tolist(), strict=True):
                    sim = weighted_jaccard(self.bag(run[lo + q : lo + q + own]), self.bags[i])
                    if sim >= self.least and sim > best.get(i, (0.0, 0))[0]:
                        best[i] = (sim, lo + q)
        return [(i, sim, start) for i, (sim, start) in sorted(best.items())]


def _ranges(places: list[int], own: int, last: int, most: int = 4096) -> Iterator[tuple[int, int]]:
    """First and last starts, both up to ``last``, of the windows of ``own`` shingles over one of the ascending places, at most ``most`` at once."""
    lo = hi = None
    for p in places:
        a, b = min(max(0, p - own + 1), last), min(p, last)
        if hi is not None and (a > hi + 1 or b - lo >= most):
            yield lo, hi
            lo, a = None, max(a, hi + 1)
            if a > b:
                hi = None
                continue
        lo, hi = a if lo is None else lo, b
    if lo is not None:
        yield lo, hi


def weighted_jaccard(a: dict[int, float], b: dict[int, float]) -> float:
    both = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def shared_shingles(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and holders of the shingles that two rows or more of ``items`` hold, counted over all of them.

    Every block of items gets them all, as its windows also hold shingles of other blocks' items: 16 bytes for each shared shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("t").cast(pa.binary()):
                own = np.unique(shingles(plain_keys(t.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["s"])

    counts = items.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    got = written(counts, "shingle-holders").toArrow()
    keys, n = got.column("s").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


class ItemBlock:
    """What tasks get of one block of items: ``(id, text, equal rows)`` each, and the shared shingles of all blocks."""

    def __init__(self, items: list[tuple[int, str, int]], shared: tuple[np.ndarray, np.ndarray], least: float):
        self.key, self.items, self.shared, self.least = uuid.uuid4().hex, items, shared, least

    def index(self) -> Items:
        """Built once in each Python worker, which keeps the block that it met last."""
        if self.key not in _BUILT:
            _BUILT.clear()
            _BUILT[self.key] = Items(self.items, self.shared, self.least)
        return _BUILT[self.key]


_BUILT: dict[str, Items] = {}


def item_blocks(benchmark: DataFrame, text: str, item_id: str, least: float, mb: float = ITEMS_MB, most: int = MOST_ITEMS) -> Iterator[ItemBlock]:
    """The items in blocks of about ``mb`` MB of text or ``most`` items, whichever is less, one after the other. Equal rows are one item."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("t <> ''")
    apart = items.groupBy("i", "t").agg(F.count("*").alias("times"))
    size, rows = apart.agg(F.sum(F.octet_length("t")), F.count("*")).first()
    n = int(max((size or 0) / (mb * 1e6), rows / most)) + 1
    shared = shared_shingles(items)
    if n > 1:
        apart = written(apart, "items")
    for b in range(n):
        yield ItemBlock([tuple(r) for r in apart.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").collect()], shared, least)


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
    least: float = SIMILARITY, items_mb: float = ITEMS_MB, most_items: int = MOST_ITEMS,
) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: the best window of each row of ``docs`` for each item it matches.

    Windows have the item's number of words; case and punctuation don't count. Similarity is the weighted
    Jaccard of five-word shingles, as often as they occur; items and texts below five words are one shingle. Null and empty texts and items
    match nothing; repeated rows match each; of windows as similar the first counts. Weights count the holders over the whole benchmark,
    whatever the number of blocks.
    """
    out = None
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for block in item_blocks(benchmark, item_text, item_id, least, items_mb, most_items):
        found = docs.mapInArrow(_matching(block), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = found if out is None else out.union(found)
    return out


def _matching(block: ItemBlock):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.index()
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        for batch in batches:
            out = []
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for i, sim, start in index.matches(plain_keys(t.as_py())):
                    out += [(doc_id, index.ids[i], sim, start, index.size[i])] * index.times[i]
            if out:
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = SIMILARITY, items_mb: float = ITEMS_MB, most_items: int = MOST_ITEMS
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window matches a benchmark item; no shuffle of ``docs``."""
    for block in item_blocks(benchmark, "text", "item_id", least, items_mb, most_items):
        docs = docs.mapInArrow(_clean(block, text), docs.schema)
    return docs


def _clean(block: ItemBlock, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.index()
        for batch in batches:
            keep = [not index.matches(plain_keys(t.as_py())) for t in batch.column(text).cast(pa.binary())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
