"""Token alignment, byte-level BPE and spelling variants on small tables against the libraries and brute force."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
sentencepiece = pytest.importorskip("sentencepiece")

from pairflow.llm import byte_bpe, spelling_variants, token_alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SPACES = " \t\n\r\x0b\x0c\x1c\x85\xa0     　"
ODD = [
    "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a\n\nb", "a \nb", "a\n b", "a\r\n b\r", "it's we'll 'S x''s", "<s> </s> <|endoftext|> <0x0A> <unk>", "▁ a▁b", "ﬁ Å Å",
    "日本語 中文　字", "naïve Straße 10,000.5", "🙂🙂 👩‍👩‍👧", "a\x00b", "tab\tsep\t\tx", "x" * 500, "ab1" * 300, "\xa0nbsp\xa0", "a\x1cb \x1c c", "  lead", "trail  ", "a  b   c", "﻿bom", "é",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "abcdefgXYZéßñ" + "0123456789" + "'.,!-_<>|" + SPACES * 2 + "字語🙂"
    return ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.Codec.at(RANKS, PATTERN).known
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("part", [1, 3, 8, byte_bpe.PART])
def test_parts_code_as_the_whole(library, part, monkeypatch):
    codec = byte_bpe.Codec.at(RANKS, PATTERN)
    monkeypatch.setattr(byte_bpe, "LONG_SPACE", 1)  # all texts take the way of long ones
    monkeypatch.setattr(byte_bpe.Codec, "_plain", lambda self, t: [self.library.encode_to_numpy(p, disallowed_special=()).tobytes() for p in byte_bpe.safe_parts(t, part) if p])
    for t in [*ODD, *random_texts(1500, part)]:
        assert "".join(byte_bpe.safe_parts(t, part)) == t
        ids = np.frombuffer(codec.encode(t), np.uint32).tolist()
        assert ids == library.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()


def test_long_texts_and_long_runs_of_white_space(library):
    codec = byte_bpe.Codec.at(RANKS, PATTERN)
    body = " ".join(random_texts(8000, 5))
    assert np.frombuffer(codec.encode(body), np.uint32).tolist() == library.encode_ordinary(body)
    for t in (" " * 30_000 + "x", "a" + "\n \t" * 20_000, "b" + " " * 20_000 + "\nc" + "　" * 9000, " " * 5000):
        assert np.frombuffer(codec.encode(t), np.uint32).tolist() == library.encode_ordinary(t)
    run = " " * 2_000_000  # the library itself gives up here
    assert codec.decode(np.frombuffer(codec.encode(f"a{run}b"), np.uint32).tolist()) == f"a{run}b".encode()


def test_byte_bpe_over_a_table(spark, library):
    texts = [*ODD, None, "same", "same", "word " * 40_000]
    docs = spark.createDataFrame([(None if t == "a" else i % 40, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    rows = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    want = Counter((r[0], tuple(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.raw)) for r in rows) == want
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(docs.limit(0), RANKS, PATTERN), RANKS, PATTERN).count() == 0
    broken = spark.createDataFrame([(1, [171]), (2, None), (3, [])], "doc_id long, ids array<int>")  # half a character
    assert {r.doc_id: bytes(r.raw) for r in byte_bpe.decode_ids(broken, RANKS, PATTERN).collect()} == {1: library.decode_bytes([171]), 2: b"", 3: b""}


def whole(pair, text):
    """Ids and ends of both sides by the libraries over the whole text; None where they don't spell it."""
    if not text:
        return None
    a, b, raw = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text), (" " + text).encode()
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return None
    return a, b, np.cumsum([len(pair.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(pair.b_bytes[i]) for i in b]).tolist()


def brute_groups(a, b, ea, eb):
    out, i, j = [], 0, 0
    for end in sorted(set(ea) & set(eb)):
        x = a[i : ea.index(end) + 1]
        y = b[j : eb.index(end) + 1]
        i, j = i + len(x), j + len(y)
        out.append((x, y))
    return out


def test_parts_of_both_sides_code_as_whole_texts():
    pair = token_alignment.Pair.at(A, B)
    assert pair.parts_ok
    texts = [*ODD, *random_texts(3000, 11), "plain words only here", None]
    got_a, got_b = pair.encode(texts)
    for t, x, y in zip(texts, got_a, got_b, strict=True):
        want = whole(pair, t)
        assert (np.frombuffer(x, np.int32).tolist(), np.frombuffer(y, np.int32).tolist()) == (want[:2] if want else ([], [])), repr(t)


def test_words_are_learnt_without_the_signs_after_them():
    pair = token_alignment.Pair(A, B)
    texts = ["zebrula, zebrula. zebrula! zebrula", "x zebrula..."]
    got, _ = pair.encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [pair.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert [w for w in pair.coder.memo if "zebrula" in w] == ["zebrula"]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 3000])
def test_divide_and_conquer_finds_all_shared_ends(n):
    rng = np.random.default_rng(n)
    for share in (0.02, 0.3, 0.9):
        total = 4 * n
        a = np.unique([*rng.integers(1, total, n), total])
        b = np.unique([*rng.choice(a, int(share * len(a))), *rng.integers(1, total, n), total])
        got = token_alignment.shared_cuts(a, b, np.array([0]), np.array([len(a)]))
        assert a[got].tolist() == sorted((set(a.tolist()) & set(b.tolist())) - {total})
    lone = np.array([2, 4, 6, 8, 11])  # no inner end is shared
    assert len(token_alignment.shared_cuts(lone, np.array([1, 3, 5, 7, 11]), np.array([0]), np.array([5]))) == 0


@pytest.mark.parametrize("block, search, big", [(token_alignment.BLOCK_BYTES, token_alignment.SEARCH, token_alignment.BIG_GROUP), (300, 16, 2)])
def test_alignment_equals_brute_force(spark, block, search, big, monkeypatch):
    for name, v in (("BLOCK_BYTES", block), ("SEARCH", search), ("BIG_GROUP", big)):
        monkeypatch.setattr(token_alignment, name, v)
    pair = token_alignment.Pair.at(A, B)
    texts = [*ODD, *random_texts(60, 23), *["The quick brown fox jumps over unfathomable hyperparameters."] * 5, None, "Überraschung unfathomable " * 200]
    rows = [(None if i == 3 else i, t, "x", 1) for i, t in enumerate(texts)] + [(9, texts[9], "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, keys string, block int").repartition(3)
    found = [whole(pair, t) for _, t, *_ in rows]
    groups = [brute_groups(*w) if w else [] for w in found]
    links = [Counter((u, v) for x, y in g for u in x for v in y) for g in groups]
    count = Counter(k for one in links for k in one)
    best = defaultdict(int)
    for (u, _), n in count.items():
        best[u] = max(best[u], n)
    want = Counter()
    for (doc_id, *_), w, g, one in zip(rows, found, groups, links, strict=True):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        want[
            doc_id, len(w[0]) if w else 0, len(w[1]) if w else 0, len(g), sum(one.values()), sum(n for k, n in one.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in one.items()),
            hashlib.sha256(told.encode()).hexdigest() if w else "",
        ] += 1
    scored, known = token_alignment.align_tokens(docs, A, B)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r) for r in scored.select(*names).collect()) == want
    assert {(r.a, r.b): (r.n, r.best) for r in known.collect()} == {k: (n, n == best[k[0]]) for k, n in count.items()}


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert [d.count() for d in token_alignment.align_tokens(empty, A, B)] == [0, 0]
    scored, known = token_alignment.align_tokens(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B)
    assert {tuple(r) for r in scored.collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")} and known.count() == 0


def brute_counts(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(count):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, n in count.items():
        f = min(near[w], key=lambda v: (-count[v], v), default=None)
        if f is not None and count[f] >= 5 * n:
            form[w] = f
    out = set()
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n, len(near[w]), count[f] if f else None))
    return out


def variant_rows(seed):
    """Words with edits of edits (chains of forms), repeated letters, accents, ties and one word that fills a third of the table."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdeé" if i % 3 else "ab", k=rng.randrange(6, 14))) for i in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "Zürichsee", "ababababab", "×÷×÷×÷"]
    said = []
    for s in stems:
        n = 130 if rng.random() < 0.2 else rng.randrange(5, 40)
        said += [s] * n
        for _ in range(6):
            i, c = rng.randrange(len(s)), rng.choice("abcdeé")
            v = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])
            said += [v] * rng.randrange(1, 9)
            s = v if rng.random() < 0.3 else s
    said += ["chainone"] * 200 + ["chainon"] * 35 + ["chaino"] * 6
    said += ["Frequent"] * (len(said) // 2)
    rng.shuffle(said)
    return [(i if i % 17 else None, " ".join(said[20 * i : 20 * i + 20]) + ", short 123 ΑΒΓΔΕΖ") for i in range(len(said) // 20 + 1)] + [(1, None), (2, ""), (3, "tiny")]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(spelling_variants, "HELD", 10)
    rows = variant_rows(seed)
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = brute_variants(brute_counts(rows))
    assert {tuple(r) for r in spelling_variants.group_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
    assert any(f and r != f for _, f, r, *_ in want) and any(n > 3 for *_, n, _ in want)


@pytest.mark.parametrize("frequent", [0, 3, 10**6])
def test_each_place_has_one_gram_and_bounds_hold(spark, frequent):
    """With any pruning, from all grams long to all short; the two words of a pair share what their bounds promise."""
    count = brute_counts(variant_rows(3))
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    lists = spelling_variants.gram_lists(words, spelling_variants.gram_dictionary(words, frequent))
    got = {r.word: r for r in lists.collect()}
    assert got.keys() == count.keys() and all(sorted(g.at for g in r.grams) == list(range(1, len(w) + 1)) for w, r in got.items())
    assert all(1 <= r.affected <= spelling_variants.MOST and r.len - r.affected >= 1 for r in got.values())
    pairs = {(r.a, r.b) for r in spelling_variants.near_words(lists).collect()}
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in count for b in count if one_edit(a, b)} and all((len(a), a) < (len(b), b) for a, b in pairs)


def test_variants_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants.group_variants(docs).count() == 0
    assert spelling_variants.group_variants(spark.createDataFrame([(1, None), (2, "few words")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling_variants.group_variants(docs, times=2)


def test_ascii_lowering_only(spark):
    docs = spark.createDataFrame([(1, "ÀÉÎÕÜABC " * 5)], "doc_id long, text string")
    word = spelling_variants.group_variants(docs).first().word
    assert word == "ÀÉÎÕÜabc" and unicodedata.is_normalized("NFC", word) and spelling_variants.counted_words(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")), "t", "i").first().n == 5


def test_words_of_parts_are_not_remembered_twice(monkeypatch):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("one two, three. four\n five  six").join("ab") for _ in range(draw.randrange(40))) or None for _ in range(60)]
    pair = token_alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    whole = pair.encode(texts)
    assert not pair.coder.memo and pair.memo
    monkeypatch.setattr(token_alignment, "SLICE", 50)
    monkeypatch.setattr(token_alignment, "MEMO", 20)
    assert pair.encode(texts) == whole and len(whole[0]) == len(texts)
    assert pair.encode([]) == ([], [])


def test_exploded_words_are_not_broadcast(spark, tmp_path):
    """Files of some MB, or of a few hundred bytes as here, hold far more once their places are exploded."""
    path = str(tmp_path / "words")
    spark.range(500).select(F.concat(F.lit("wording"), F.col("id").cast("string")).alias("word"), F.lit(5).cast("long").alias("n")).write.parquet(path)
    words = spark.read.parquet(path)
    lists = spelling_variants.gram_lists(words, spelling_variants.gram_dictionary(words).where("gram <> ''"))
    for df in (spelling_variants.near_words(lists), lists):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan
