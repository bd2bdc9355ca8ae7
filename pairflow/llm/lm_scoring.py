"""Language-model scores by a weighted backoff automaton that is sharded over the cluster."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import KEYS, blocks_of, got_keys, lowered_words, mix, planes, sent_keys, slices, unplanes, with_block
from .common import n_blocks, written

#: Weight of the shorter history in the distributions of histories of one and of two tokens, in occurrences. Pairs of words say little about
#: the next one, a history of two that is known says much: text that occurs more than once scores apart.
PRIORS = (256.0, 8.0)
START, STOP = np.uint64(0x5354415254), np.uint64(0x53544F50)
ORDERS = (1, 2, 3)
#: Rows of a scan task in one block: a block's n-grams, their counts and its part of the automaton take about 100 bytes a token in one Python worker.
ROWS = 1024


def trains(doc_id) -> bool:
    """Training rows: crc32 of the id as text modulo 5 is not 1; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def _block(table: pa.Table):
    """Of a block: ids, training flags, tokens (words and a stop each) as keys, and the documents' borders in them."""
    ids = table.column("doc_id").to_pylist()
    train = np.array([trains(i) for i in ids], bool)
    keys, ends = [], [0]
    for text in table.column("text").cast(pa.binary()):
        w = lowered_words(text.as_py())
        keys.append(KEYS.of(w))
        keys.append(np.array([STOP]))
        ends.append(ends[-1] + len(w) + 1)
    return ids, train, np.concatenate(keys) if keys else np.empty(0, np.uint64), np.array(ends)


class Grams:
    """Distinct n-grams of a block for each order: ascending ``keys``, training ``counts``, and ``at``, the n-gram that ends at each token.

    ``history[n]`` has for each token the n-gram before it, -1 where the document's start leaves none. A document starts with a mark, which is a
    history but no token.
    """

    def __init__(self, tokens: np.ndarray, ends: np.ndarray, train: np.ndarray):
        n = len(tokens)
        first = np.zeros(n, bool)
        first[ends[:-1]] = True
        in_train = np.repeat(train, np.diff(ends))
        before = np.concatenate([[START], tokens[:-1]])[:n].astype(np.uint64)
        before[first] = START
        pairs = mix(before, tokens)
        triples = mix(np.concatenate([[np.uint64(0)], pairs[:-1]])[:n].astype(np.uint64), tokens)
        self.keys, self.counts, self.at = {}, {}, {}
        for order, all_keys, there in ((1, np.append(tokens, START), None), (2, pairs, None), (3, triples, ~first)):
            keys, at = np.unique(all_keys if there is None else all_keys[there], return_inverse=True)
            at = at.astype(np.int32)
            where = at[:n] if there is None else np.full(n, -1, np.int32)
            if there is not None:
                where[there] = at
            counted = where[in_train & (where >= 0)]
            self.keys[order], self.at[order] = keys.astype(np.uint64), where
            self.counts[order] = np.bincount(counted, minlength=len(keys))
            if order == 1:
                start = at[-1]
                self.counts[1][start] = int(train.sum())
        one = np.concatenate([[start], self.at[1][:-1]])[:n]
        two = np.concatenate([[-1], self.at[2][:-1]])[:n]
        self.history = {1: np.where(first, start, one).astype(np.int32), 2: np.where(first, -1, two).astype(np.int32)}


def _requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks_of(batches):
            _, train, tokens, ends = _block(table)
            grams, out = Grams(tokens, ends, train), []
            for order in ORDERS:
                keys, counts = grams.keys[order], grams.counts[order]
                for bucket, a, b in slices(keys, buckets):
                    out.append((bucket, block, order, sent_keys(keys[a:b]), planes(counts[a:b].astype(np.uint32))))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "order", "keys", "counts"])

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Of a bucket: each block's keys answered by their counts over all blocks, and a row of statistics of the tokens."""
    out, all_rows = [], table.to_pylist()
    for order in ORDERS:
        rows = [r for r in all_rows if r["order"] == order]
        if not rows:
            continue
        parts = [got_keys(r["keys"]) for r in rows]
        counts = np.concatenate([unplanes(r["counts"], np.uint32) for r in rows])
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(at, counts, len(keys)).astype(np.int64)
        if order == 1:
            own = total[keys != START]
            out.append((rows[0]["bucket"], -1, order, None, int(own.sum()), int((own > 0).sum()), int((own == 1).sum()), int((own == 2).sum())))
        ends = np.cumsum([len(p) for p in parts])
        for r, end, p in zip(rows, ends, parts, strict=True):
            out.append((r["bucket"], r["block"], order, planes(total[at[end - len(p) : end]]), 0, 0, 0, 0))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 4)
    names = ("bucket", "block", "order", "totals", "n", "v", "n1", "n2")
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))


class Automaton:
    """Weighted backoff automaton over the n-grams that some block of documents meets.

    State 0 is the empty history; the states after it are the histories of one token that training has seen, then those of two. ``arc[n]`` has
    the log10 weight of each n-gram's arc, which leaves the state of its first n - 1 tokens, and NaN where training hasn't seen it (the root
    has an arc for every token). ``fail_to`` and ``fail_weight`` are each state's failure arc, to the history without its first token.
    Distributions over longer histories are drawn towards shorter ones by ``priors`` occurrences, unigrams are discounted by an absolute
    amount, whose mass goes to the unknown word.
    """

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], stats: dict, priors: tuple[float, float] = PRIORS):
        n, v, n1, n2 = (float(stats[k] or 0) for k in ("n", "v", "n1", "n2"))
        discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        unknown = discount * v / n if n else 1.0
        self.grams = grams
        self.state = {0: np.zeros(1, np.int64)}
        fail_weight, fail_to, last = [np.zeros(1)], [np.zeros(1, np.int64)], 1
        shorter = {}  # of each pair the token that it ends with
        shorter[2] = np.zeros(len(grams.keys[2]), np.int64)
        shorter[2][grams.at[2]] = grams.at[1]
        for order, prior in zip((1, 2), priors, strict=True):
            seen = counts[order] > 0
            self.state[order] = np.where(seen, last + np.cumsum(seen) - 1, -1)
            last += int(seen.sum())
            fail_weight.append(np.log10(prior / (counts[order][seen] + prior)))
            fail_to.append(np.zeros(int(seen.sum()), np.int64) if order == 1 else self.state[1][shorter[2][seen]])
        self.fail_weight, self.fail_to = np.concatenate(fail_weight), np.concatenate(fail_to)
        # probabilities from short to long; an n-gram's history and its shorter form are those where it stands
        p = np.where(counts[1] > 0, (counts[1] - discount) / max(n, 1.0), unknown)
        self.arc = {1: np.log10(p)}
        for order, prior in zip((2, 3), priors, strict=True):
            at = grams.at[order]
            there = at >= 0
            history, suffix = np.zeros(len(grams.keys[order]), np.int64), np.zeros(len(grams.keys[order]), np.int64)
            history[at[there]], suffix[at[there]] = grams.history[order - 1][there], grams.at[order - 1][there]
            p = (counts[order] + prior * p[suffix]) / (counts[order - 1][history] + prior)
            self.arc[order] = np.where(counts[order] > 0, np.log10(p), np.nan)

    def walk(self) -> np.ndarray:
        """The log10 weight that the traversal adds at each token.

        A token's arc leads to the longest known history that ends with it, so the state in front of each token is known from the tokens
        before it, and the steps of all documents are taken at once: from its state each token follows failure arcs until a state has an arc for it.
        """
        grams = self.grams
        n = len(grams.at[1])
        state, order = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in (1, 2):
            history = grams.history[k]
            known = np.where(history >= 0, self.state[k][history], -1) if len(self.state[k]) else np.full(n, -1)
            state, order = np.where(known >= 0, known, state), np.where(known >= 0, k, order)
        total, waiting = np.zeros(n), np.arange(n)
        for k in (2, 1, 0):
            here = waiting[order[waiting] == k]
            weight = self.arc[k + 1][grams.at[k + 1][here]] if len(here) else np.empty(0)
            found = ~np.isnan(weight)
            total[here[found]] += weight[found]
            failed = here[~found]
            total[failed] += self.fail_weight[state[failed]]
            state[failed], order[failed] = self.fail_to[state[failed]], k - 1
            waiting = np.concatenate([waiting[order[waiting] < k], failed]) if k else waiting[:0]
        return total


def _scores(stats: dict, priors: tuple[float, float]):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    n, v = float(stats["n"] or 0), float(stats["v"] or 0)

    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=list(names))
        ids, train, tokens, ends = _block(docs)
        grams, counts = Grams(tokens, ends, train), {}
        rows = sorted(totals.to_pylist(), key=lambda r: (r["order"], r["bucket"]))
        for order in ORDERS:
            got = [unplanes(r["totals"], np.int64) for r in rows if r["order"] == order]
            counts[order] = np.concatenate(got) if got else np.empty(0, np.int64)
            if len(counts[order]) != len(grams.keys[order]):
                raise ValueError("a block was dealt other documents than when its n-grams were counted")
        step = Automaton(grams, counts, stats, priors).walk()
        c1 = counts[1][grams.at[1]]
        base = np.log10((c1 + 0.5) / (n + 0.5 * (v + 1)))
        first = ends[:-1]
        out = (
            ids, ~train, np.diff(ends), np.add.reduceat((c1 > 0).astype(np.int64), first), np.full(len(ids), int(n)),
            np.add.reduceat(base, first), np.add.reduceat(step, first),
        )
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=list(names))

    return run


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", priors: tuple[float, float] = PRIORS, reread: bool = False) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row; log10 scores of whole texts.

    Each block of documents sends its distinct n-grams with training counts, gets the counts over the whole
    corpus back, and builds the part of the automaton that its documents walk through: no task and no
    broadcast holds the model. Null texts are a lone end token; null ids train; without training rows every token is unknown.
    ``reread``: ``docs`` is a plain read of a table; any other frame is written first, so that both passes see the same blocks.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs if reread else written(docs, "lm-docs")
    buckets = n_blocks(docs, block_mb=2)
    asked = with_block(docs, ROWS).mapInArrow(_requests(buckets), "bucket int, block long, order int, keys binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(_totals, "bucket int, block long, order int, totals binary, n long, v long, n1 long, n2 long")
    told = written(told, "lm-totals")
    stats = told.where("block = -1").agg(*[F.sum(c).alias(c) for c in ("n", "v", "n1", "n2")]).first().asDict()
    answers = told.where("block >= 0").select("block", "bucket", "order", "totals")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_block(docs, ROWS).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(stats, priors), schema)


def op2_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), reread=True)
