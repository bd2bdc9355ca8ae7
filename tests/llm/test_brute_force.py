"""Packing, line dedup, toxicity's automaton and the pipeline's stages against brute force and planted cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from pairflow.llm import line_dedup, packing, toxicity  # noqa: E402
from pairflow.llm.encoding import Encoder  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def sentence(rng, n, pool=4000):
    return " ".join(f"{'bcdfghklmnprstvw'[rng.randrange(16)]}{'aeiou'[rng.randrange(5)]}{rng.randrange(pool)}" for _ in range(n))


def test_packed_pieces_equal_the_library(spark):
    rng = random.Random(1)
    texts = [sentence(rng, rng.randrange(0, 90)) for _ in range(120)] + [None, "", "same text", "same text", sentence(rng, 900)]
    rows = [(i if i % 31 else None, t) for i, t in enumerate(texts)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORD_BPE, 256).collect()
    e, want = Encoder.at(WORD_BPE), Counter()
    for doc_id, t in rows:
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seats = {}
    for r in got:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seats.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 256
    assert len(seats) <= -(-sum(r.length for r in got) // 256) + 2  # next to the least possible


def brute_lines(rows):
    """Text of each row after every line but the first of its component is gone."""
    lines = [(doc, row, i, line.strip()) for row, (doc, text) in enumerate(rows) if text for i, line in enumerate(text.split("\n")) if line.strip()]
    distinct = sorted({x[3] for x in lines})
    of = {x: x for x in distinct}
    sets = {x: line_dedup.shingles(x) for x in distinct}
    for i, x in enumerate(distinct):
        for y in distinct[i + 1 :]:
            if line_dedup.overlap(sets[x], sets[y]) >= 0.8:
                a, b = of[x], of[y]
                of = {k: min(a, b) if v in (a, b) else v for k, v in of.items()}
    seen, gone = set(), set()
    for _, row, i, x in sorted(lines, key=lambda v: (v[0] is None, v[0] or 0, v[1], v[2])):
        if of[x] in seen:
            gone.add((row, i))
        seen.add(of[x])
    return [None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (row, i) not in gone) for row, (_, text) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    """Lines with one to three edits, chains of edits, exact copies, blank lines, many short ones."""
    rng = random.Random(seed)
    pool = [sentence(rng, rng.randrange(1, 14)) for _ in range(40)]
    for _ in range(80):
        line = list(rng.choice(pool))
        for _ in range(rng.randrange(1, 4)):
            line[rng.randrange(len(line))] = rng.choice("abcdefghij")
        pool.append("".join(line))
    rows = [(i, "\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randrange(1, 7)))) for i in range(90)] + [(200, None), (201, "")]
    names = ("row", "block", "_row", "_drop", "_lines", "drop", "lines", "doc", "id", "a.b")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"my {c}") for c in names}).coalesce(1)
    out = line_dedup.dedup_lines(docs).collect()
    assert all(r[c] == f"my {c}" for r in out for c in names) and list(out[0].asDict()) == [*docs.columns, "n_lines", "n_dropped"]
    got = {r.doc_id: r.text for r in out}
    assert got == {doc: text for (doc, _), text in zip(rows, brute_lines(rows), strict=True)}


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a == b or (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    name = lambda: "".join(rng.choices("abcd", k=rng.randrange(3, 9)))
    entries = sorted({name() for _ in range(25)})
    lexicon = toxicity.Lexicon([(e, False) for e in entries])
    for _ in range(4000):
        w = name() if rng.random() < 0.5 else "".join(c if rng.random() < 0.85 else rng.choice("abcd") for c in rng.choice(entries))
        # short entries allow no edit
        want = 2 if w in entries else int(any(within_one_edit(w, e) for e in entries if len(e) >= 5))
        assert lexicon.match(w) == want, (w, want)


def test_spellings_with_digits_and_signs_equal_edit_distance():
    rng = random.Random(16)
    entries = sorted({"".join(rng.choices("abcd", k=rng.randrange(4, 9))) for _ in range(25)})
    lexicon = toxicity.Lexicon([(e, False) for e in entries])
    matches = toxicity.Matches(lexicon)
    for _ in range(3000):
        w = list(rng.choice(entries))
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = rng.choice("0*@1")
        token = rng.choice(("", "(", '"')) + "".join(w) + rng.choice(("", ",", "!)"))
        # outer signs go, digits stay; each run of letters counts as a word too
        whole = token.strip('*@(",!)')
        runs = [r for r in "".join(c if c.isalpha() else " " for c in token).split()]
        want = max(2 if f in entries else int(any(within_one_edit(f, e) for e in entries if len(e) >= 5)) for f in (whole, *runs))
        assert matches[token] == want, (token, want)
    assert [toxicity.Matches(toxicity.Lexicon([("grumbler", False)]))[t] for t in ("gr*mbler", "(grumb1er!)", "@grumbler,", "$rumbler", "gr**bler", "--", "")] == [1, 1, 2, 1, 0, 0, 0]


def test_every_entry_of_a_large_lexicon_counts(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    marked = [f"zq{name(i)}" for i in range(3000)]
    rows = []
    for i in range(340):  # 40 toxic texts, of which ten hold each marked word; as many words are a text's own, so that families differ
        own = [f"y{name(j * 340 + i)}" for j in range(750 if i < 40 else 20)]
        rows.append((i, " ".join(own + [w for j, w in enumerate(marked) if i < 40 and (i - j) * 37 % 40 < 10]), int(i < 40)))
    entries = toxicity.learned_entries(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert {w for w, stem in entries if not stem} == set(marked)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Forty clean documents, copies, near copies, one that holds a benchmark passage, shared lines, junk, null and empty texts."""
    rng = random.Random(3)
    clean = {i: "\n".join(sentence(rng, 24) for _ in range(5)) for i in range(40)}
    passage = sentence(rng, 60)
    shared = sentence(rng, 20)
    docs = dict(clean)
    docs[3] += "\n" + shared
    docs[7] += "\n" + shared[:-1] + "x"
    docs[100] = docs[9] + " tail"  # all its lines go with those of 9
    docs[101] = docs[11] + "\n" + sentence(rng, 25)  # one line stays
    docs[102] = sentence(rng, 30) + " " + passage + " " + sentence(rng, 30)
    docs |= {103: "too short", 104: "again and again " * 60, 105: None, 106: ""}
    folder = tmp_path_factory.mktemp("planted")
    rows = [(i, t, "en", "web", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, clean


def test_pipeline_over_planted_cases(spark, planted):
    import corpus_pipeline

    folder, docs, clean = planted
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        seen[name] = {(r.doc_id, r.text) if "text" in out.columns else tuple(r) for r in out.collect()}
        if name != "pattern packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            now = spark.createDataFrame(out.collect(), out.schema)
    ids = {name: {r[0] for r in rows} for name, rows in seen.items()}
    assert ids["quality rules"] == {i for i in docs if i not in (103, 104, 105, 106)}
    texts = dict(seen["line dedup"])
    assert texts[3] == docs[3] and texts[7] == clean[7] and texts[9] == docs[9]
    assert ids["line dedup"] == ids["quality rules"] - {100} and texts[101] == docs[101].split("\n")[-1]
    assert ids["n-gram Jaccard join"] >= set(clean) and ids["benchmark decontamination"] == ids["n-gram Jaccard join"] - {102}
    assert ids["pattern packing"] == ids["benchmark decontamination"]
    last = corpus_pipeline.run(spark, folder)
    e = Encoder.at(WORD_BPE)
    sizes = {i: len(e.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in seen["benchmark decontamination"]}
    assert {r.doc_id: r.n for r in last.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == sizes


def test_near_copies_leave_one_document(spark):
    import corpus_pipeline

    rng = random.Random(8)
    base = sentence(rng, 120).split()
    near = [*base]
    near[60] = "changed"
    rows = [(5, " ".join(base)), (2, " ".join(near)), (9, " ".join(base)), (11, sentence(rng, 120)), (12, ""), (13, None), (12, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    from pairflow.llm.common import written

    got = sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, written(docs, "docs"), "").collect())
    assert got == [2, 11, 12, 13]


def test_stages_over_an_empty_table(spark, planted):
    import corpus_pipeline

    from pairflow.llm.common import written

    folder = planted[0]
    empty = written(spark.read.parquet(f"{folder}/documents.parquet").limit(0), "docs")
    assert [stage(spark, empty, folder).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
