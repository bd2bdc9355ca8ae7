"""Spelling variants of words: pairs one edit apart by an index of variable-length grams, and the frequent form that each leads to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unplaced, written

#: Runs of letters (fixed values), lower-cased from A to Z only.
LETTERS = "A-Za-zÀ-ÿ"
#: Words have this many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: Runs whose checksum this divides lose a letter.
LOSSES = 199
#: Lengths of grams. A word has a gram for each of its letters, and an edit touches at most ``MOST`` of them, so one of six letters keeps one.
LEAST, MOST = 2, 5
#: A gram in more places than this is extended by the next letter, as far as ``MOST`` allows.
FREQUENT = 32
#: A form has this many times the occurrences of its word.
TIMES = 5
#: Follows word ends; not a letter.
END = "$"
#: Distinct words that a task counts before it sends them on.
HELD = 200_000


def counted_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH) -> DataFrame:
    """``(word, n)``: runs of letters of at least ``least_length`` code points, with their occurrences over all rows of ``docs``.

    Runs are lower-cased from A to Z. A run whose crc32 with its document's id is a multiple of 199 loses one letter (in each occurrence in the
    document), and counts as what is left. Tasks send partial counts, so a word of every document costs a row a task. Null texts have no runs;
    a null id is told as an empty string.
    """
    run_of = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            lowered = pc.ascii_lower(batch.column("text"))
            for key, value in zip(batch.column("doc_id").to_pylist(), lowered, strict=True):
                body = value.as_py()
                if not body:
                    continue
                start = zlib.crc32(f"{key}:".encode() if key is not None else b":")
                for word, n in Counter(run_of.findall(body)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % LOSSES == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield sent()
        yield sent()

    found = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``(gram, f)``: the shortest grams of 2 to 5 letters that stand in at most ``frequent`` places of ``words``, and of five letters also the others.

    Frequencies are counted for all lengths; a gram that is rare enough ends its branch, so longer ones that begin with it are pruned.
    No gram of the dictionary begins another, so at each place of a word exactly one of them fits.
    """
    padded = F.concat("word", F.lit(END * (MOST - 1)))
    places = words.select(padded.alias("_padded"), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    counted = [places.select(F.substr("_padded", "at", F.lit(q)).alias("gram")).groupBy("gram").agg(F.count("*").alias("f")) for q in range(LEAST, MOST + 1)]
    kept = counted[0]
    out = kept.where(F.col("f") <= frequent)
    for q, longer in zip(range(LEAST + 1, MOST + 1), counted[1:], strict=True):
        branch = kept.where(F.col("f") > frequent).select(unplaced(F.col("gram"), "string").alias("_prefix"))
        kept = longer.join(branch, F.substring("gram", 1, q - 1) == F.col("_prefix"), "left_semi")
        out = out.union(kept if q == MOST else kept.where(F.col("f") <= frequent))
    return out


def gram_lists(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(word, n, len, ids, affected, grams)`` for each word: the distinct numbers of its grams, the most grams that one edit can touch,
    and ``grams`` as ``(f, gram, at)``, rarest first.

    An edit at a place touches the grams that reach over it: those that begin at most four letters before. Every other gram of either
    word stands in the other too, at the same place or one further on.
    """
    padded = F.concat("word", F.lit(END * (MOST - 1)))
    places = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"), padded.alias("_padded"))
    each = F.array(*[F.substr("_padded", "at", F.lit(q)) for q in range(LEAST, MOST + 1)])
    places = places.select("word", "n", "at", F.explode(each).alias("gram"))
    known = dictionary.select(unplaced(F.col("gram"), "string").alias("_gram"), "f")
    found = places.hint("merge").join(known.hint("merge"), F.col("gram") == F.col("_gram"))
    found = found.groupBy("word").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "gram", "f"))).alias("g"))
    size = F.length("word")
    reach = lambda i: F.size(F.filter("g", lambda x: (x["at"] <= i) & (i < x["at"] + F.length(x["gram"]))))
    affected = F.array_max(F.transform(F.sequence(F.lit(1), size), reach))
    ids = F.array_distinct(F.transform("g", lambda x: F.hash(x["gram"])))
    grams = F.array_sort(F.transform("g", lambda x: F.struct(x["f"].alias("f"), x["gram"].alias("gram"), x["at"].alias("at"))))
    return found.select("word", "n", size.alias("len"), ids.alias("ids"), affected.alias("affected"), grams.alias("grams"))


def near_words(lists: DataFrame) -> DataFrame:
    """``(a, b, na, nb)``: each pair of words exactly one inserted, deleted or replaced code point apart, once; ``a`` is the shorter or smaller.

    Two near words share all but ``affected`` grams of either, so in each word's own order, rarest first, the first shared gram is among
    the first ``affected + 1``. These short lists, keyed by gram, place and length, propose pairs; the long lists of frequent
    grams are never read. A pair's lists are then merged: pairs that share fewer grams than the bound of either word go (a
    repeated gram counts once, so as many more are allowed as both words repeat), and the edit distance of the rest is verified.
    """
    carried = ("word", "n", "len", "ids", "affected")
    short = lists.select(*carried, F.explode(F.slice("grams", F.lit(1), F.col("affected") + 1)).alias("x"))
    short = short.select(*carried, F.col("x.gram").alias("gram"), F.col("x.at").alias("at"))
    ask = F.array(*[F.struct((F.col("at") + i).alias("at"), (F.col("len") + j).alias("len")) for i, j in ((0, 0), (0, 1), (1, 1))])
    asked = short.withColumn("ask", F.explode(ask))
    asked = asked.select(*[F.col(c).alias(f"_{c}") for c in (*carried, "gram")], F.col("ask.at").alias("_at"), F.col("ask.len").alias("_want"))
    fits = (F.col("gram") == F.col("_gram")) & (F.col("at") == F.col("_at")) & (F.col("len") == F.col("_want"))
    fits &= (F.col("_len") < F.col("len")) | (F.col("_word") < F.col("word"))
    bound = F.greatest(F.col("_len") - F.col("_affected"), F.col("len") - F.col("affected"))
    repeated = F.least(F.col("_len") - F.size("_ids"), F.col("len") - F.size("ids"))
    pairs = short.hint("merge").join(asked.hint("merge"), fits).where(F.size(F.array_intersect("_ids", "ids")) + repeated >= bound)
    pairs = pairs.where(F.levenshtein("_word", "word", 1) == 1)
    return pairs.select(F.col("_word").alias("a"), F.col("word").alias("b"), F.col("_n").alias("na"), F.col("n").alias("nb")).distinct()


def group_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs`` with at least ``least_count`` occurrences.

    ``form`` is the near word with most occurrences (ties: the smallest in code-point order) if it has at least ``times`` those of the word;
    ``root`` is where forms lead to. Counts grow by ``times`` with each form, so chains are short and have no cycles: five rounds of
    pointer doubling pass 32 forms, and five to the 28th is beyond any count. Words and pairs are written once each; nothing is
    collected. Joins are merged on both sides' keys: Spark sizes a table after an explode as before it, and by its compressed files, so the places of
    some MB of words would be broadcast through the driver as GB of rows. Null and empty texts have no words, repeated rows count again, an empty table gives no rows, other columns aren't carried.
    """
    if times < 5:
        raise ValueError("forms of less than five times the occurrences may chain further than the rounds reach")
    words = written(counted_words(docs, text, doc_id).where(F.col("n") >= least_count), "words")
    lists = written(gram_lists(words, gram_dictionary(words)), "gram-lists")
    pairs = written(near_words(lists), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m"))
    both = both.union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near"))).alias("x"))
    best = best.select(unplaced(F.col("word"), "string").alias("_word"), "n_near", F.col("x.near").alias("near"), (-F.col("x.m")).alias("m"))
    out = words.join(best.hint("merge"), F.col("word") == F.col("_word"), "left")
    is_form = F.col("m") >= times * F.col("n")
    out = out.select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("m")).alias("form_n"))
    out = written(out, "forms")
    to = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(5):
        then = to.select(unplaced(F.col("word"), "string").alias("_word"), F.col("root").alias("_root"))
        to = written(to.join(then.hint("merge"), F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")
    to = to.select(unplaced(F.col("word"), "string").alias("_word"), "root")
    return out.join(to.hint("merge"), F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows: checksums bit by bit from the polynomial, near words by what is left when one letter goes.
OP13_SQL = f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS cased,
      translate(cased, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
coded AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
summed AS (SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM coded, tab),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {LOSSES} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.v = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(a := -m, b := other)) AS other, max(m) AS m FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, CASE WHEN m >= {TIMES} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
steps(word, here) AS (SELECT word, word FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON s.here = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.here AS root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s ON s.word = f.word JOIN formed e ON e.word = s.here WHERE e.form IS NULL
"""
