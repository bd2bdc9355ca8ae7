"""N-gram Jaccard join by vertical partitioning, down to components, without listing all pairs of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_ROWS, KEYS, blocks_of, got_keys, lowered_words, mix, planes, sent_keys, slices, unplanes, with_block
from .common import components, n_blocks, unplaced, written

#: The first fragment holds the shingles whose key is below this share of the key space.
FIRST = 0.25
#: Fragments of the order by frequency: shingles of 2 to 3, 4 to 15, 16 to 255 and more classes.
FRAGMENTS = (2, 4, 16, 256)
#: Rows of a block when sets are counted; bytes of text that a task takes at once.
SET_ROWS, PART_BYTES = 1024, 16_000_000
#: Stands for more than one row; the highest count that is told apart.
SEVERAL = np.uint16(0xFFFF)
MOST = 0xFFFE
_FIRST_TOP = np.uint64(int(FIRST * 2**64))
_HEAD = "ids array<long>, places array<long>, sizes array<long>, marks array<long>"


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Distinct k-word shingles as ascending 64-bit keys; fewer words are one shingle, none an empty set."""
    w = lowered_words(text)
    if not w:
        return np.empty(0, np.uint64)
    keys = KEYS.of(w)
    n = min(k, len(keys))
    out = keys[: len(keys) - n + 1]
    for i in range(1, n):
        out = mix(out, keys[i : len(keys) - n + 1 + i])
    return np.unique(out if n == k else mix(out, np.uint64(n)))


def _mark(s: np.ndarray) -> int:
    """A 63-bit key of a whole set."""
    with np.errstate(over="ignore"):
        x = (s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64) ^ s.sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(x >> np.uint64(1))


def _requests(k: int, buckets: int):
    """A block's distinct shingles of the first fragment, each with the row that holds it or ``SEVERAL``; besides a row of all sets' sizes and marks."""
    names = ["bucket", "block", "keys", "owners", "ids", "places", "sizes", "marks"]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks_of(batches, PART_BYTES):
            sets = [shingle_set(t.as_py(), k) for t in table.column("text").cast(pa.binary())]
            places = table.column("place").to_numpy()
            rows = [(block % buckets, block, None, None, table.column("doc_id").to_pylist(), places.tolist(), list(map(len, sets)), list(map(_mark, sets)))]
            firsts = [s[: np.searchsorted(s, _FIRST_TOP)] for s in sets]
            owners = np.repeat((places % BLOCK_ROWS).astype(np.uint16), list(map(len, firsts)))
            keys, at, times = np.unique(np.concatenate(firsts), return_index=True, return_counts=True)
            owners = np.where(times > 1, SEVERAL, owners[at])
            rows += [(b, block, sent_keys(keys[i:j]), planes(owners[i:j]), *[None] * 4) for b, i, j in slices(keys, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _answers(table: pa.Table) -> pa.Table:
    """For each block, how many shingles of a bucket each of its rows holds alone; rows without shingles pass."""
    rows = table.select(["keys", "owners"]).to_pylist()
    parts = [got_keys(r["keys"]) if r["keys"] else np.empty(0, np.uint64) for r in rows]
    keys, at, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    once = times[at] == 1
    told, end = [], 0
    for r, p in zip(rows, parts, strict=True):
        own = unplanes(r["owners"], np.uint16)[once[end : end + len(p)]] if len(p) else np.empty(0, np.uint16)
        end += len(p)
        who, many = np.unique(own[own != SEVERAL], return_counts=True)
        told.append((planes(who), planes(many.astype(np.uint32))))
    out = table.select(["block", "ids", "places", "sizes", "marks"])
    return out.append_column("who", pa.array([t[0] for t in told], pa.binary())).append_column("many", pa.array([t[1] for t in told], pa.binary()))


def _judged(percent: int):
    """The rows of a block: their set's size and mark, and whether it may have a link."""
    names, kinds = ["doc_id", "place", "n", "mark", "near"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def run(table: pa.Table) -> pa.Table:
        alone = np.zeros(BLOCK_ROWS, np.int64)
        for who, many in zip(table.column("who").to_pylist(), table.column("many").to_pylist(), strict=True):
            alone[unplanes(who, np.uint16)] += unplanes(many, np.uint32)
        heads = [r for r in table.select(["ids", "places", "sizes", "marks"]).to_pylist() if r["ids"] is not None]
        ids, places, sizes, marks = ([x for r in heads for x in r[c]] for c in ("ids", "places", "sizes", "marks"))
        n = np.array(sizes, np.int64)
        # a partner misses at most (100 - percent) % of the shingles, wherever they lie
        near = (n > 0) & (100 * alone[np.array(places, np.int64) % BLOCK_ROWS] <= (100 - percent) * n)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip((ids, places, n, marks, near), kinds, strict=True)], names=names)

    return run


def _sets(k: int):
    """The sets of rows with their size and mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k) for t in batch.column("text").cast(pa.binary())]
            cols = [batch.column("place"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_mark(s) for s in sets], pa.int64()), pa.array([sent_keys(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "mark", "keys"])

    return run


def _holders(buckets: int):
    """A block's distinct shingles, each with how many of its sets hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks_of(batches):
            keys, times = np.unique(np.concatenate([got_keys(x) for x in table.column("keys").to_pylist()]), return_counts=True)
            rows = [(b, block, sent_keys(keys[i:j]), planes(times[i:j].astype(np.uint16))) for b, i, j in slices(keys, buckets)]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "keys", "times"])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """For each block's shingles in a bucket, how many sets hold it; from ``MOST`` on just that."""
    rows = table.to_pylist()
    parts = [got_keys(r["keys"]) for r in rows]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    df = np.bincount(at, np.concatenate([unplanes(r["times"], np.uint16) for r in rows]))
    df = np.minimum(df, MOST).astype(np.uint16)[at]
    ends = np.cumsum([len(p) for p in parts])
    cols = ([r["bucket"] for r in rows], [r["block"] for r in rows], [planes(df[e - len(p) : e]) for e, p in zip(ends, parts, strict=True)])
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "df"])


def _fragments(percent: int):
    """Sets that may have a link, a row for each fragment: shingles that several sets hold, rarest first, with ``u`` (those that
    no other set holds) and ``before`` (the number in earlier fragments)."""
    names = ["id", "n", "u", "fragment", "before", "keys"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))

    def run(sets: pa.Table, told: pa.Table) -> pa.Table:
        parts = [got_keys(x) for x in sets.column("keys").to_pylist()]
        keys = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        rows = sorted(told.select(["bucket", "df"]).to_pylist(), key=lambda r: r["bucket"])
        df = np.concatenate([unplanes(r["df"], np.uint16) for r in rows]) if rows else np.empty(0, np.uint16)
        if len(df) != len(keys):
            raise ValueError("a block was dealt other sets than when its shingles were counted")
        out = []
        for i, s in zip(sets.column("id").to_pylist(), parts, strict=True):
            d = df[np.searchsorted(keys, s)]
            held, n, u = s[d > 1].view(np.int64), len(s), int((d == 1).sum())
            if 100 * u > (100 - percent) * n:
                continue
            d = d[d > 1]
            order = np.lexsort((held, d))
            held, ends = held[order], np.searchsorted(d[order], [*FRAGMENTS[1:], MOST + 1])
            out += [(i, n, u, f, int(a), held[a:b]) for f, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if a < b]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=names)

    return run


def possible(na: str, la: str, nb: str, lb: str, percent: int) -> Column:
    """Whether sets of these sizes may reach the similarity if they share at most ``la`` and ``lb`` shingles."""
    na, la, nb, lb = (F.col(c) for c in (na, la, nb, lb))
    most = F.least(la, lb)
    return 100 * most >= percent * (na + nb - most)


def star_pairs(index: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of each key's leader, the set with the fewest unshared members, with all others under it."""
    lead = index.groupBy("key").agg(F.min(F.struct("u", "id", "n")).alias("l"))
    lead = lead.select(unplaced(F.col("key"), "bigint").alias("_key"), F.col("l.id").alias("a"), F.col("l.n").alias("na"), (F.col("l.n") - F.col("l.u")).alias("la"))
    others = index.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), (F.col("n") - F.col("u")).alias("lb"))
    pairs = others.join(lead, F.col("key") == F.col("_key")).where(F.col("a") != F.col("b"))
    return pairs.where(possible("na", "la", "nb", "lb", percent)).select("a", "b").distinct()


def second_pairs(index: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that can still link two components of ``links``.

    Of two components under a key one is not the key's largest, so only sets outside that one look for partners. A pair is
    proposed where it may reach the similarity although it shares nothing before the key; its first common shingle always is
    such a key, so no link is missed.
    """
    of = components(links).select(F.col("id").alias("_id"), "component")
    placed = index.join(of, F.col("id") == F.col("_id"), "left").select("key", "id", "n", "left", F.coalesce("component", "id").alias("c"))
    placed = written(placed, "join-placed")
    counts = placed.groupBy("key", "c").agg(F.count("*").alias("m"))
    most = counts.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    most = most.select(unplaced(F.col("key"), "bigint").alias("_key"), "main")
    rest = placed.join(most, F.col("key") == F.col("_key")).where("c <> main")
    rest = rest.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("c").alias("ca"))
    others = placed.select(unplaced(F.col("key"), "bigint").alias("_key"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), "c")
    pairs = rest.join(others, (F.col("key") == F.col("_key")) & (F.col("ca") != F.col("c")) & possible("na", "la", "nb", "lb", percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, fragments: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that reach the similarity: overlaps counted in each fragment apart, then summed per pair."""
    side = lambda c, x: fragments.select(F.col("id").alias(f"_{c}"), F.col("fragment").alias(f"f{c}"), F.col("keys").alias(x))
    both = pairs.join(side("a", "ka"), F.col("a") == F.col("_a")).select("a", "b", "fa", "ka")
    both = both.join(side("b", "kb"), (F.col("b") == F.col("_b")) & (F.col("fa") == F.col("fb")))
    parts = both.select("a", "b", F.size(F.array_intersect("ka", "kb")).cast("long").alias("o"))
    whole = parts.groupBy("a", "b").agg(F.sum("o").alias("o"))
    n = lambda c: sizes.select(F.col("id").alias(f"_{c}"), F.col("n").alias(f"n{c}"))
    whole = whole.join(n("a"), F.col("a") == F.col("_a")).join(n("b"), F.col("b") == F.col("_b"))
    return whole.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def jaccard_components(
    docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", reread: bool = False
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row: components of documents whose k-shingle sets link.

    Two sets link when ``100 * |a & b| >= percent * |a | b|``. Exact, in four steps:

    1. The global order of shingles (by key) is cut; its first fragment is counted over all documents in one
       exchange, which leaves out the documents with too many shingles there that no other document holds. Texts stay
       where they are read: a shingle is sent with its row's place in the block, and back come counts for each row.
    2. Equal sets of the rest become one class each; one set of each class is made anew and kept. Shingles that a single class
       holds are dropped from the order of the rest (rarest first), which is cut into fragments by frequency.
    3. Prefixes of that order propose pairs: first each prefix shingle's leader with all its classes, then
       classes of different components so far, where their places in the order leave enough to share. Each pair's overlaps
       are counted fragment by fragment and summed.
    4. Links spread to components, which all copies inherit.

    Null and empty texts have no shingles and no links; null ids get no component but themselves. Repeated ids share one result each
    row. ``reread``: ``docs`` is a plain read of a table; other frames are written first.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs if reread else written(docs, "join-docs")
    buckets = n_blocks(docs, block_mb=16)
    rows = with_block(docs).withColumn("place", F.monotonically_increasing_id())
    asked = rows.mapInArrow(_requests(k, buckets), f"bucket int, block long, keys binary, owners binary, {_HEAD}")
    told = asked.groupBy("bucket").applyInArrow(_answers, f"block long, {_HEAD}, who binary, many binary")
    near = told.groupBy("block").applyInArrow(_judged(percent), "doc_id long, place long, n long, mark long, near boolean")
    near = written(near, "join-near")

    members = near.where("near and doc_id is not null")
    classes = members.groupBy("mark", "n").agg(F.min(F.struct("doc_id", "place")).alias("l"))
    classes = written(classes.select("mark", "n", F.col("l.doc_id").alias("doc_id"), F.col("l.place").alias("id")), "join-classes")
    of = classes.select(F.col("doc_id").alias("_id"), F.col("n").alias("_n"), unplaced(F.col("mark"), "bigint").alias("_mark"))
    linked = members.select("doc_id", "mark", "n").join(of, (F.col("mark") == F.col("_mark")) & (F.col("n") == F.col("_n")))
    copies = linked.select(F.col("doc_id").alias("a"), F.col("_id").alias("b"))

    # one set of each class: a bit for each row, 64 to a long
    word, bit = (lambda c: F.shiftright(c, 6)), (lambda c: c.bitwiseAND(F.lit(63)).cast("int"))
    bits = classes.groupBy(word(F.col("id")).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("id")))).alias("bits"))
    bits = written(bits, "join-bits")
    leads = rows.select("place", "text").join(bits, word(F.col("place")) == F.col("_word")).where(F.call_function("bit_get", "bits", bit(F.col("place"))) == 1)
    sets = written(leads.select("place", "text").mapInArrow(_sets(k), "id long, n long, mark long, keys binary"), "join-sets")
    seen = [t.agg(F.count("*"), F.bit_xor("id"), F.bit_xor("mark"), F.sum("n")).first() for t in (classes, sets)]
    if seen[0] != seen[1]:
        raise ValueError("a repeated scan dealt rows out in another way")

    blocked = with_block(sets.select("id", "keys"), SET_ROWS)
    asked = blocked.mapInArrow(_holders(buckets), "bucket int, block long, keys binary, times binary")
    told = asked.groupBy("bucket").applyInArrow(_counted, "bucket int, block long, df binary")
    kinds = "id long, n long, u long, fragment int, before long, keys array<long>"
    fragments = written(blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_fragments(percent), kinds), "join-fragments")
    live = written(fragments.where("before = 0").select("id", "n"), "join-live")
    # unshared shingles come first in the order; a prefix is one longer than what a partner may miss
    longest = F.floor((100 - percent) * F.col("n") / 100) + 1 - F.col("u")
    index = fragments.where(F.col("before") < longest).select("id", "n", "u", "before", longest.alias("longest"), F.posexplode("keys").alias("at", "key"))
    index = index.withColumn("rank", F.col("before") + F.col("at") + 1).where("rank <= longest")
    # what two sets share from this shingle on is at most what either holds from here on
    index = written(index.select("key", "id", "n", "u", (F.col("n") - F.col("u") - F.col("rank") + 1).alias("left")), "join-index")

    first = written(star_pairs(index, percent), "join-stars")
    links = written(verified(first, fragments, live, percent), "join-links")
    more = verified(written(second_pairs(index, links, percent), "join-second"), fragments, live, percent)

    for c in ("a", "b"):  # from places of rows to ids
        of = classes.select(F.col("id").alias("_id"), F.col("doc_id").alias(f"_{c}"))
        found = (links.union(more) if c == "a" else found).join(of, F.col(c) == F.col("_id")).drop("_id")
    of = components(copies.union(found.select("_a", "_b"))).select(F.col("id").alias("_id"), "component")
    out = near.select("doc_id", F.col("n").alias("n_shingles")).join(of, F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90, reread=True)


#: Brute force over the same definition; a link needs a shared shingle.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id AND 10 * b.n >= 9 * a.n AND 10 * a.n >= 9 * b.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, min(b) AS low FROM t GROUP BY a)
SELECT s.doc_id, len(s.g) AS n_shingles, r.low AS component_id FROM s JOIN r ON s.doc_id = r.a
"""
