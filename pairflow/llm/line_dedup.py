"""Fuzzy line deduplication: MinHash bands over character shingles, exact Jaccard, components, one line kept of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks_of, got_keys, mix, sent_keys, slices, with_block
from .common import components, n_blocks, small_batches, unplaced, written

#: Characters of a shingle, bands and rows of a signature, similarity that links two lines.
SHINGLE, BANDS, ROWS, SIMILARITY = 8, 16, 4, 0.8
#: Bits of the filter that spares lines which can't matter from being read on; its size is fixed, it only gets less sharp.
FILTER_BITS = 1 << 24
#: Bytes of text that a block of documents may hold in a worker; more are several blocks.
BLOCK_BYTES = 16_000_000
#: Documents in one Arrow batch.
BATCH_ROWS = 1024
#: Characters of lines whose sets of shingles a worker keeps while it checks pairs.
HELD = 400_000
#: Bits of a line's sketch, kept in integers of 64.
SKETCH_BITS = 1024
SKETCH = tuple(f"s{i}" for i in range(SKETCH_BITS // 64))


def line_id(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) >> 1


def lines_of(text: bytes | None) -> list[tuple[int, bytes]]:
    """Line numbers and lines without white space at their ends; lines without words are left out."""
    return [(i, s) for i, x in enumerate(text.split(b"\n")) if (s := x.strip())] if text else []


def shingle_hashes(lines: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(line, hash)`` of each place of a shingle; a line shorter than a shingle has its id as the only one."""
    sizes = np.array(list(map(len, lines)))
    chars = np.frombuffer(("".join(lines) + "\0" * SHINGLE).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(chars) - SHINGLE
    h, width = chars, 1  # of the ``width`` characters from each place on
    while 2 * width <= SHINGLE:
        h = h[:-width] * np.uint64(pow(0x100000001B3, width, 1 << 64)) + h[width:]
        width *= 2
    for i in range(width, SHINGLE):
        h = h[:-1] * np.uint64(0x100000001B3) + chars[i:]
    h = h[:n]
    ends = np.cumsum(sizes)
    line = np.repeat(np.arange(len(lines)), sizes)
    inside = np.arange(n) + SHINGLE <= ends[line]
    short = np.flatnonzero(sizes < SHINGLE)
    first = ends[short] - sizes[short]
    h[first], inside[first] = ids[short], True
    return line[inside], mix(h[inside], np.uint64(0x11AE))


def sketches(lines: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the number of distinct shingles and a sketch: bits that are each the parity of the shingles dealt to it.

    Two sketches differ in at most as many bits as there are shingles that only one of the lines holds.
    """
    line, h = shingle_hashes(lines, ids)
    order = np.lexsort((h, line))
    line, h = line[order], h[order]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (h[1:] != h[:-1])])
    line, h = line[new], h[new]
    bits = np.bincount(line * SKETCH_BITS + ((h >> np.uint64(40)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=len(lines) * SKETCH_BITS) & 1
    packed = np.packbits(bits.astype(np.uint8).reshape(len(lines), SKETCH_BITS), axis=1)
    return np.bincount(line, minlength=len(lines)), packed.view(np.int64)


def by_size(sizes: list[int], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Slices of at most 1000 lines and about ``most`` characters; a longer line stands alone."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and (i - first >= 1000 or total + n > most):
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def signatures(lines: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Keys of the bands of each line: one-permutation MinHash of its shingles, empty bins filled from the next full one."""
    line, h = shingle_hashes([x.decode("utf-8", "replace") for x in lines], ids)
    bins = BANDS * ROWS
    sig = np.full((len(lines), bins), 0xFFFFFFFF, np.uint32)
    np.minimum.at(sig.ravel(), line * bins + (((h >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)).astype(np.int64), (h & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    odd = np.flatnonzero((sig == 0xFFFFFFFF).any(1))
    part = sig[odd]
    while len(part) and (empty := part == 0xFFFFFFFF).any():
        nxt = np.roll(part, -1, 1)
        part = np.where(empty & (nxt != 0xFFFFFFFF), nxt ^ np.uint32(0x5BD1E995) & np.uint32(0xFFFFFFFE), part)
    sig[odd] = part
    sig = sig.reshape(len(lines), BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(lines), 1))
    for r in range(ROWS):
        key = mix(key, sig[:, :, r])
    return key


def _requests(buckets: int):
    """Of a block: for each band key one of its lines, dealt by key; all lines under a key that several of the block
    have, and lines that the block holds more than once, dealt by block (they are known to matter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks_of(batches, BLOCK_BYTES):
            found: dict[int, bytes] = {}
            twice = set()
            for t in table.column("text").cast(pa.binary()):
                for _, x in lines_of(t.as_py()):
                    i = line_id(x)
                    if i in found:
                        twice.add(i)
                    else:
                        found[i] = x
            if not found:
                continue
            ids, lines = np.fromiter(found, np.uint64, len(found)), list(found.values())
            keys = np.concatenate([signatures(lines[a:b], ids[a:b]) for a, b in by_size(list(map(len, lines)))])
            flat, own = keys.ravel(), np.repeat(ids, BANDS)
            order = np.argsort(flat)  # any line may lead its key
            flat, own = flat[order], own[order]
            lead = np.concatenate([[True], flat[1:] != flat[:-1]])
            several = ~lead | np.concatenate([~lead[1:], [False]])
            rows = [(int(block) % buckets, 1, sent_keys(flat[several]), own[several].tobytes())] if several.any() else []
            if twice:
                rows.append((int(block) % buckets, 2, b"", np.fromiter(twice, np.uint64, len(twice)).tobytes()))
            k, o = flat[lead], own[lead]
            rows += [(b, 0, sent_keys(k[i:j]), o[i:j].tobytes()) for b, i, j in slices(k, buckets)]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "kind", "keys", "ids"])

    return run


def _index(table: pa.Table) -> pa.Table:
    """Rows (key, id) under keys that several lines have; rows without key for lines that occur more than once."""
    out_keys, out_ids, repeated = [], [], []
    keys, ids = [], []
    for r in table.to_pylist():
        own = np.frombuffer(r["ids"], np.uint64)
        if r["kind"] == 2:
            repeated.append(own)
        else:
            (out_keys if r["kind"] else keys).append(got_keys(r["keys"]))
            (out_ids if r["kind"] else ids).append(own)
    if keys:
        k, i = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((i, k))
        k, i = k[order], i[order]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        new = new_key | np.concatenate([[True], i[1:] != i[:-1]])
        repeated.append(np.unique(i[~new]))  # the same line from another block
        k, i, new_key = k[new], i[new], new_key[new]
        group = np.cumsum(new_key) - 1
        many = np.bincount(group)[group] > 1
        out_keys.append(k[many])
        out_ids.append(i[many])
        # a leader of a block's several lines is in the index by that block's own rows
    key = np.concatenate(out_keys) if out_keys else np.empty(0, np.uint64)
    own = np.concatenate(out_ids) if out_ids else np.empty(0, np.uint64)
    again = np.unique(np.concatenate(repeated)) if repeated else np.empty(0, np.uint64)
    key_col = pa.concat_arrays([pa.array(key.view(np.int64)), pa.nulls(len(again), pa.int64())])
    return pa.Table.from_arrays([key_col, pa.array(np.concatenate([own, again]).view(np.int64))], names=["key", "id"])


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the ids' hashes."""
    bit = F.pmod(F.col("id"), F.lit(FILTER_BITS))
    maps = ids.groupBy(F.expr(f"bitmap_bucket_number(pmod(id, {FILTER_BITS}))").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m"))
    out = np.zeros(FILTER_BITS + 1 + (1 << 16), np.uint8)
    for b, m in maps.collect():  # at most FILTER_BITS / 32768 rows of 4 KB
        bits = np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")
        at = (b - 1) * 32768 + 1 if b > 0 else 0
        out[at : at + len(bits)] |= bits
    return out


def _occurrences(packed: bytes):
    """Lines that pass the filter: id, row, document, line number, and the text once for each line and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(packed, np.uint8)
        told: set[int] = set()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        for batch in batches:
            out = []
            if len(told) > 200_000:
                told.clear()
            for row, doc_id, t in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for number, x in lines_of(t.as_py()):
                    i = line_id(x)
                    at = i % FILTER_BITS
                    if bits[at >> 3] >> (at & 7) & 1:
                        out.append((i, row, doc_id, number, None if i in told else x.decode("utf-8", "replace")))
                        told.add(i)
            if out:
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "row", "doc_id", "number", "line"])

    return run


def _with_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to lines the number of their shingles and their sketches."""
    for batch in batches:
        for a, b in by_size([len(x) for x in batch.column("line").to_pylist()]):
            part = batch.slice(a, b - a)
            sizes, sketch = sketches(part.column("line").to_pylist(), part.column("id").to_numpy().view(np.uint64))
            cols = [part.column("id"), pa.array(sizes.astype(np.int32)), *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(SKETCH))]]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", *SKETCH])


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: str, b: str) -> float:
    return overlap(shingles(a), shingles(b))


def overlap(x: set[str], y: set[str]) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, set[str]] = {}  # leaders come again and again
    size, last, other = 0, None, set()  # the others stand together
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("la").to_pylist(), batch.column("lb").to_pylist(), strict=True):
            own = held.get(x)
            if own is None:
                own = shingles(x)
                if len(x) < 2000:
                    if size > HELD:
                        held.clear()
                        size = 0
                    held[x] = own
                    size += len(x)
            if y != last:
                last, other = y, held.get(y) or shingles(y)
            ok.append(overlap(own, other) >= SIMILARITY)
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    side = lambda c: lines.select(F.col("id").alias(f"_{c}"), F.col("line").alias(f"l{c}"))
    both = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return both.select("a", "b", "la", "lb").mapInArrow(_checked, "a long, b long")


def star_pairs(keyed: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of each key's leader with all others under it.

    The leader is the line that meets most lines over all its keys (``w``): of a line and its edited copies that is the line itself, as
    each copy shares fewer keys with other copies than with it.
    """
    lead = keyed.groupBy("key").agg(F.max(F.struct("w", "id")).alias("l")).select(unplaced(F.col("key"), "bigint").alias("_key"), F.col("l.id").alias("a"))
    pairs = keyed.join(lead, (F.col("key") == F.col("_key")) & (F.col("id") != F.col("a")))
    return pairs.select("a", F.col("id").alias("b")).distinct()


def near(a: str, b: str) -> Column:
    """Whether two lines may reach the similarity, by the sizes of their sets and the bits in which their sketches differ."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum(F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH)
    # at a similarity s, the shingles that one line alone holds are at most (1 - s) / (1 + s) of both sizes
    return (F.least(na, nb) >= SIMILARITY * F.greatest(na, nb)) & (differ * (1 + SIMILARITY) <= (na + nb) * (1 - SIMILARITY) + 1e-6)


def open_keys(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """``(key, id, c, rest)`` of the keys under which two components of ``links`` meet. Of two components under a key one is not the
    key's largest, so only lines outside that one (``rest``) look for partners. Keys within one component are done."""
    of = components(links).select(F.col("id").alias("_id"), "component")
    placed = keyed.join(of, F.col("id") == F.col("_id"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    placed = written(placed, "line-placed")
    counts = placed.groupBy("key", "c").agg(F.count("*").alias("m"))
    most = counts.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    most = most.select(unplaced(F.col("key"), "bigint").alias("_key"), "main")
    opened = placed.join(most, F.col("key") == F.col("_key"))
    return written(opened.select("key", "id", "c", (F.col("c") != F.col("main")).alias("rest")), "line-open")


def second_pairs(opened: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that can still link two components, by sizes and sketches, which only lines of open keys get."""
    own = texts.join(opened.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_semi").select("id", "line")
    kinds = "id long, n int, " + ", ".join(f"{s} long" for s in SKETCH)
    at = written(own.mapInArrow(_with_sketches, kinds), "line-sketches")
    at = at.select(unplaced(F.col("id"), "bigint").alias("_id"), F.struct("id", "n", *SKETCH).alias("at"))
    rest = opened.where("rest").join(at, F.col("id") == F.col("_id")).select("key", F.col("at").alias("x"), F.col("c").alias("cx"))
    others = opened.join(at, F.col("id") == F.col("_id"))
    others = others.select(unplaced(F.col("key"), "bigint").alias("_key"), F.col("at").alias("y"), F.col("c").alias("cy"))
    pairs = rest.join(others, (F.col("key") == F.col("_key")) & (F.col("cx") != F.col("cy")) & near("x", "y"))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``(row, drop)``: line numbers to drop from each row of ``docs (row, doc_id, text, block)``."""
    buckets = n_blocks(docs, block_mb=8)
    asked = docs.select("block", "text").mapInArrow(_requests(buckets), "bucket int, kind int, keys binary, ids binary")
    with small_batches(docs.sparkSession, BATCH_ROWS):
        index = written(asked.groupBy("bucket").applyInArrow(_index, "key long, id long"), "line-index")
    bits = np.packbits(_filter_of(index)[:FILTER_BITS], bitorder="little").tobytes()
    seen = docs.select("row", "doc_id", "text").mapInArrow(_occurrences(bits), "id long, row long, doc_id long, number int, line string")
    with small_batches(docs.sparkSession, BATCH_ROWS):
        seen = written(seen, "line-occurrences")
    keyed = written(index.where("key is not null").distinct(), "line-keys")
    # how many lines a line meets under its keys
    many = keyed.groupBy("key").agg(F.count("*").alias("m")).select(unplaced(F.col("key"), "bigint").alias("_key"), "m")
    met = keyed.join(many, F.col("key") == F.col("_key")).groupBy("id").agg(F.sum("m").alias("w")).select(F.col("id").alias("_id"), "w")
    texts = seen.where("line is not null").groupBy("id").agg(F.first("line").alias("line"))
    texts = written(texts.join(met, F.col("id") == F.col("_id")).select("id", "line", "w"), "line-texts")

    weighed = texts.select(unplaced(F.col("id"), "bigint").alias("_id"), "w")
    keyed = written(keyed.join(weighed, F.col("id") == F.col("_id")).select("key", "id", "w"), "line-keys")
    links = written(_verified(star_pairs(keyed), texts), "line-links")
    opened = open_keys(keyed, links)
    more = written(_verified(written(second_pairs(opened, texts), "line-second"), texts), "line-links")

    of = components(links.union(more)).select(F.col("id").alias("_id"), "component")
    group = F.coalesce("component", "id")
    seen = seen.select("id", "row", "doc_id", "number").join(of, F.col("id") == F.col("_id"), "left")
    seen = seen.select(group.alias("g"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "number").alias("at"))
    seen = written(seen, "line-groups")
    first = seen.groupBy("g").agg(F.min("at").alias("first")).select(unplaced(F.col("g"), "bigint").alias("_g"), "first")
    gone = seen.join(first, F.col("g") == F.col("_g")).where(F.col("at") != F.col("first"))
    return gone.groupBy(F.col("at.row").alias("row")).agg(F.collect_set("at.number").alias("drop"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", reread: bool = False) -> DataFrame:
    """All columns of ``docs``, with duplicate lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    Lines are what line feeds part; white space at their ends doesn't count, and lines without words are never
    dropped. Lines link when their sets of character shingles have a Jaccard similarity of at least 0.8 (proposed by MinHash bands, checked
    exactly); of each component the first line by document id and place stays. Null texts stay null; null ids come last; repeated rows
    lose the lines that the first of them has; columns named like a result are replaced.
    ``reread``: ``docs`` is a plain read of a table; other frames are written first.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the documents' own columns travel in a struct, so that none can clash with those of the work
    docs = (docs if reread else written(docs, "line-docs")).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    docs = with_block(docs).withColumn("row", F.monotonically_increasing_id())
    body = F.col("doc").getField(text)
    slim = docs.select("row", "block", F.col("doc").getField(doc_id).cast("long").alias("doc_id"), body.alias("text"))
    gone = written(dropped_lines(slim), "line-drops").select(F.col("row").alias("_row"), "drop")
    # documents are dealt out by row whatever the number of drops: what would be broadcast grows with the documents
    out = docs.select("row", "doc").join(gone.hint("merge"), F.col("row") == F.col("_row"), "left").select("doc", "drop", F.split(body, "\n", -1).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    cut = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    told = [F.when(F.col("drop").isNull(), body).otherwise(cut).alias(text) if c == text else F.col("doc").getField(c).alias(c) for c in names]
    return out.select(*told, F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, reread=True).select("doc_id", "n_lines", "n_dropped", "text")
