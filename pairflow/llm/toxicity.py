"""Toxicity: a learned lexicon in a trie, crossed with Levenshtein automata, and context windows that tell quotation from abuse."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that the lexicon and the weights are learned from, at most (those with the smallest hash).
MOST_LABELS = 20_000
#: An entry needs this many toxic families of texts, and this share of them, and odds this many times those of other texts.
LEAST_FAMILIES, LEAST_SHARE, LEAST_ODDS = 3, 0.004, 20.0
#: Words of at least this length are also matched with one edit; what an edited match counts.
FUZZY_FROM, FUZZY_COUNTS = 5, 0.7
#: Lengths of the stems that words are cut to.
STEMS = (4, 5, 6, 7, 8)
#: Words on each side that make up a hit's context.
CONTEXT = 8
THRESHOLD = 0.7

# Words that report speech, and marks of quotation.
REPORTING = frozenset(
    "said says wrote writes quoted quote quotes called sagte sagt schrieb zitiert nannte dit écrit cité appelé dijo dice escribió citó llamó".split()
)
QUOTES = re.compile(r"[\"“”„«»‹›]")
_LETTERS = re.compile(r"[^\W\d_]+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")


class Lexicon:
    """A trie of words and stems, walked together with Levenshtein automata of one edit.

    A state of the product is a set of (trie node, edits so far); states and steps are worked out when first met, so a
    word costs a look-up for each letter and ends early where no entry is left within reach. Words of ``FUZZY_FROM`` letters match
    with one edit, shorter ones and stems exactly; a stem matches every word that begins with it.
    """

    def __init__(self, entries: Iterable[tuple[str, bool]]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]  # edits that a word which ends here allows
        self.stem: list[bool] = [False]
        for text, stem in entries:
            at = 0
            for c in text:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(-1)
                    self.stem.append(False)
                at = self.next[at][c]
            if stem:
                self.stem[at] = True
            else:
                self.word[at] = int(len(text) >= FUZZY_FROM)
        self.fuzzy = [False] * len(self.next)  # whether a word that allows an edit lies below
        for at in range(len(self.next) - 1, -1, -1):
            self.fuzzy[at] = self.word[at] > 0 or any(self.fuzzy[n] for n in self.next[at].values())
        self.start = self._closed({(0, 0)})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.ends: dict[frozenset, int] = {}

    def _closed(self, state: set) -> frozenset:
        """With the letters that a text may have left out."""
        for node, edits in list(state):
            if edits == 0:
                state |= {(n, 1) for n in self.next[node].values() if self.fuzzy[n]}
        return frozenset(x for x in state if x[1] == 0 or (x[0], 0) not in state)

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, edits in state:
            if c in self.next[node]:
                out.add((self.next[node][c], edits))
            if edits == 0:
                if self.fuzzy[node]:
                    out.add((node, 1))
                out |= {(n, 1) for n in self.next[node].values() if self.fuzzy[n]}
        return self._closed({x for x in out if x[1] == 0 or self.fuzzy[x[0]]})

    def match(self, word: str) -> int:
        """0: none, 1: with one edit, 2: exactly or by its stem."""
        state = self.start
        for c in word:
            key = (state, c)
            nxt = self.steps.get(key)
            if nxt is None:
                nxt = self.steps[key] = self._step(state, c)
            state = nxt
            if not state:
                return 0
            if any(e == 0 and self.stem[n] for n, e in state):
                return 2
        if state not in self.ends:
            own = [e for n, e in state if self.word[n] >= e]
            self.ends[state] = 0 if not own else 2 - min(own)
        return self.ends[state]


class Matches(dict):
    """Lower-case tokens to their match, each walked once: the best of a token's runs of letters and of the token as a whole,
    in which digits and inner signs stand for letters (``gr0wler``, ``gro*ler``) and outer signs don't count unless that makes
    the match (``@mbler`` is ``ambler`` less one letter)."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        forms = {*_LETTERS.findall(token), _OUTER.sub("", token)}
        found = self[token] = max(map(self.lexicon.match, forms))
        return found


@lru_cache(maxsize=1)
def matches_of(entries: tuple[tuple[str, bool], ...]) -> Matches:
    """One for each Python worker, which keeps the automaton's steps from task to task."""
    return Matches(Lexicon(entries))


def features(text: str, matches: Matches) -> tuple[float, float, float]:
    """Sums over hits as abuse and as quotation, and abuse for each hundred words."""
    tokens = text.lower().split()
    hits = [(i, m) for i, m in enumerate(map(matches.__getitem__, tokens)) if m]
    abuse = quoted = 0.0
    for i, m in hits:
        weight = 1.0 if m == 2 else FUZZY_COUNTS
        around = tokens[max(0, i - CONTEXT) : i + CONTEXT + 1]
        before, after = tokens[max(0, i - CONTEXT) : i + 1], tokens[i : i + CONTEXT + 1]
        marks = any(QUOTES.search(t) for t in before) and any(QUOTES.search(t) for t in after)
        told = any(t.strip(",.:;!?\"“”„«»") in REPORTING for t in around)
        share = 0.7 if marks and told else 0.5 if marks else 0.2 if told else 0.0
        abuse, quoted = abuse + weight * (1 - share), quoted + weight * share
    return np.log1p(abuse), np.log1p(quoted), np.log1p(100 * abuse / max(20, len(tokens)))


def _features(entries: tuple[tuple[str, bool], ...], weights: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = matches_of(entries)
        for batch in batches:
            if len(matches) > 500_000:
                matches.clear()
            if len(matches.lexicon.steps) > 500_000:
                matches.lexicon.steps.clear()
                matches.lexicon.ends.clear()
            x = np.array([features(t or "", matches) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, 3)
            cols = [batch.column("doc_id")]
            if weights is None:
                cols += [batch.column("toxic"), *[pa.array(x[:, j]) for j in range(3)]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "toxic", "x0", "x1", "x2"])
            else:
                p = 1 / (1 + np.exp(-(x @ weights[1:] + weights[0])))
                held = [zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1 for i in batch.column("doc_id").to_pylist()]
                cols += [pa.array(held, pa.bool_()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    return run


def learned_entries(labelled: DataFrame) -> tuple[tuple[str, bool], ...]:
    """Words and stems (first letters) that toxic texts hold far more often than others, all of them.

    Copies count once: texts with one smallest word hash are a family. Each entry stands in a share of ``LEAST_SHARE`` of the toxic
    families at least, so there are at most 1 / ``LEAST_SHARE`` times as many as a toxic family of the bounded sample has words and
    stems on average.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    rows = labelled.withColumn("w", found).where(F.size("w") > 0)
    rows = rows.select("toxic", "w", F.array_min(F.transform("w", lambda w: F.xxhash64(w))).alias("family"))
    cut = lambda w: F.filter(F.array(*[F.when(F.length(w) > n, F.left(w, F.lit(n))) for n in STEMS]), lambda x: x.isNotNull())
    stems = F.flatten(F.transform("w", cut))
    entry = F.array_union(F.transform("w", lambda w: F.concat(F.lit("w"), w)), F.transform(stems, lambda w: F.concat(F.lit("s"), w)))
    rows = rows.select("toxic", "family", F.explode(entry).alias("entry")).distinct()
    families = labelled.select("toxic", F.array_min(F.transform(found, lambda w: F.xxhash64(w))).alias("family")).distinct()
    toxic, clean = families.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    counts = rows.groupBy("entry").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    odds = ((F.col("a") + 0.5) / (toxic + 1.0)) / ((F.col("b") + 0.5) / (clean + 1.0))
    best = counts.where((F.col("a") >= max(LEAST_FAMILIES, LEAST_SHARE * toxic)) & (odds >= LEAST_ODDS))
    return tuple((r[0][1:], r[0][0] == "s") for r in best.orderBy(F.desc("a"), "entry").select("entry").collect())


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; the quotation weight isn't above the abuse weight."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * np.r_[0, w[1:]]
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(np.r_[1e-6, np.full(x.shape[1], ridge)])
        w = w - np.linalg.solve(h, g)
    w[2] = min(w[2], w[1])
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Learns from labelled rows whose crc32 of the id modulo 3 is not 1, at most ``MOST_LABELS`` of them; everything else
    covers all rows in one pass without a shuffle. Null texts count as empty; null ids aren't
    held out; labels that are null are left out; an id labelled twice takes the higher label. Without toxic labels every score is low.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    usable = labels.where("toxic is not null and doc_id is not null").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    usable = usable.orderBy(F.xxhash64("_id"), "_id").limit(MOST_LABELS)
    labelled = docs.join(F.broadcast(usable), F.col("doc_id") == F.col("_id")).drop("_id")  # at most MOST_LABELS ids
    entries = learned_entries(labelled)
    seen = labelled.mapInArrow(_features(entries), "doc_id long, toxic int, x0 double, x1 double, x2 double")
    seen = np.array([tuple(r) for r in seen.select("toxic", "x0", "x1", "x2").collect()], np.float64).reshape(-1, 4)
    weights = fitted(seen[:, 1:], seen[:, 0]) if len(seen) and 0 < seen[:, 0].sum() < len(seen) else np.array([-5.0, 0, 0, 0])
    return docs.mapInArrow(_features(entries, weights), "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
