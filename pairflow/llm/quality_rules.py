"""Quality rules: text statistics and robust multivariate outliers per language and source (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, unplaced, words, written

#: name, expression over the statistics, least standard deviation that an estimate may have
FEATURES = (
    ("f_words", "ln(1 + n_words)", 0.5),
    ("f_length", "ln(1 + word_chars / n_words)", 0.1),
    ("f_symbols", "ln(1 + 100 * n_symbols / word_chars)", 0.3),
    ("f_lines", "ln(1 + 100 * n_dup_lines / n_words)", 0.3),
    ("f_repeats", "ln(1 + 10 * n_repeat_words / n_words)", 0.2),
    ("f_capitals", "ln(1 + 10 * n_capitals / word_chars)", 0.1),
    ("f_marks", "ln(1 + 10 * n_marks / word_chars)", 0.1),
)
LEAST_WORDS = 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks")
#: Share of a group's rows that the determinant is minimised over, concentration steps from all starts, steps at most, change of a log
#: determinant that ends them.
SUPPORT, FIRST_STEPS, STEPS, SETTLED = 0.75, 2, 8, 0.01
#: Share of normal rows within the ellipsoid whose rows give the final estimate.
WITHIN = 0.975
#: Rows by which the estimate of a wider group counts in that of a narrower one.
PRIOR = 100.0
#: Groups whose estimates are sent to all tasks: some 36 numbers each, 15 MB in all.
MOST_GROUPS = 50_000
#: A clean row lies beyond the cut-off with this probability under the normal model. It is this small so that of some 10^10 documents
#: hardly one is lost by chance, and as real statistics have longer tails than normal ones.
TAIL = 1e-12


def chi2_quantile(p: float, k: float) -> float:
    """Wilson and Hilferty's approximation, by bisection of the normal tail."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    if p > 0.5:  # the upper tail keeps its digits
        lo, hi = -40.0, 40.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 0.5 * math.erfc(mid / math.sqrt(2)) > 1 - p else (lo, mid)
    return k * (1 - 2 / (9 * k) + lo * math.sqrt(2 / (9 * k))) ** 3


def chi2_cdf(x: float, k: float) -> float:
    return 0.5 * math.erfc(-(((x / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k))) / math.sqrt(2))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where ``body`` uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(placed: Column) -> Column:
    """Words under the windows whose hash occurs more than once; ``placed``: sorted (hash, place) pairs."""
    same = lambda x, j: F.coalesce(F.get(placed, j)["k"] == x["k"], F.lit(False))
    twice = F.filter(placed, lambda x, j: same(x, j - 1) | same(x, j + 1))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    none = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
    return F.aggregate(at, none, step)["n"]


def repeated_words(w: Column) -> Column:
    """How many words stand in a 3-word window that occurs at least twice. Windows are hashed to 64 bits; only
    texts with a repeated hash go on to sort the windows and to add up the places they cover."""
    n = F.size(w)
    keys = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    pairs = lambda k: F.array_sort(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
    several = let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), let(pairs(k), _covered)).otherwise(F.lit(0)))
    return F.when(n < 4, F.lit(0)).otherwise(several).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks`` (all long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    dense = F.array_join("_words", "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    out = docs.withColumn("_words", words(F.col(text)))
    left = lambda pattern: F.length(F.regexp_replace(dense, pattern, ""))
    return out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(dense).cast("long"),
            "n_symbols": left(r"[^#*$%&|<>]+").cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
            "n_capitals": left(r"[^\p{Lu}]+").cast("long"),
            "n_marks": left(r"[\p{L}\p{N}]+").cast("long"),
        }
    ).drop("_words")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _levels(rows: DataFrame) -> DataFrame:
    """Each row three times, with ``g`` its language and source, its language, and all rows."""
    return rows.withColumn("g", F.explode(F.array("g2", "g1", F.lit("0")))).drop("g1", "g2")


def _sized(estimates: DataFrame, groups: int) -> DataFrame:
    """A small table of estimates to be sent to all tasks; one with too many groups for that is joined like any other."""
    return F.broadcast(estimates) if groups <= MOST_GROUPS else estimates


def _cholesky(stats: DataFrame, floors: tuple[float, ...], factor: float) -> DataFrame:
    """``c{i}_{j}`` times ``factor`` to the triangle ``l{i}_{j}``, and ``logdet``. Pivots below a feature's floor are raised to it."""
    p = len(floors)
    for i in range(p):
        for j in range(i + 1):
            c = F.col(f"c{i}_{j}") * factor
            for k in range(j):
                c = c - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            stats = stats.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(c, F.lit(floors[i] ** 2))) if i == j else c / F.col(f"l{j}_{j}"))
    return stats.withColumn("logdet", 2 * sum((F.ln(f"l{i}_{i}") for i in range(1, p)), F.ln("l0_0")))


def _with_distance(rows: DataFrame, estimates: DataFrame, names: list[str], key: str = "g") -> DataFrame:
    """Joins ``rows`` with the estimates of their group and adds ``distance2``, by substitution along the triangle."""
    placed = estimates.select(unplaced(F.col("g"), "string").alias("_g"), *[c for c in estimates.columns if c != "g"])
    out = rows.join(placed, F.col(key) == F.col("_g"), "left")
    for i, f in enumerate(names):
        z = F.col(f) - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}_{j}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}_{i}"))
    total = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(names))), F.col("z0") * F.col("z0"))
    return out.withColumn("distance2", total)


def _moments(rows: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Count, means and covariances, from sums of deviations from the last means ``m{i}``, which are near enough to lose no digits."""
    p = len(names)
    rows = rows.select(*keys, *[f"m{i}" for i in range(p)], *[(F.col(f) - F.col(f"m{i}")).alias(f"d{i}") for i, f in enumerate(names)])
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.max(f"m{i}").alias(f"old{i}") for i in range(p)], *[F.sum(f"d{i}").alias(f"a{i}") for i in range(p)],
        *[F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"b{i}_{j}") for i in range(p) for j in range(i + 1)],
    )
    mean = lambda c: F.col(c) / F.col("n")
    return sums.select(
        *keys, "n", *[(F.col(f"old{i}") + mean(f"a{i}")).alias(f"m{i}") for i in range(p)],
        *[(mean(f"b{i}_{j}") - mean(f"a{i}") * mean(f"a{j}")).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)],
    )


def _starts(rows: DataFrame, names: list[str], floors: tuple[float, ...]) -> tuple[DataFrame, int]:
    """Three first estimates for each ``g``, all at the medians: deviations alone, the covariance of values whose tails are bent (tanh), and
    that of directions from the medians. Also returns the number of groups."""
    p = len(names)
    quartiles = rows.groupBy("g").agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 10000).alias(f) for f in names])
    middle = written(quartiles.select(
        unplaced(F.col("g"), "string").alias("_g"), *[F.col(f)[1].alias(f"m{i}") for i, f in enumerate(names)],
        *[F.greatest((F.col(f)[2] - F.col(f)[0]) / 1.349, F.lit(floors[i])).alias(f"s{i}") for i, f in enumerate(names)],
    ), "quality-medians")
    groups = middle.count()
    z = rows.join(_sized(middle, groups), F.col("g") == F.col("_g"))
    z = z.select("g", *[((F.col(f) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"t{i}") for i, f in enumerate(names)])
    norm = F.sqrt(sum((F.col(f"t{i}") * F.col(f"t{i}") for i in range(1, p)), F.col("t0") * F.col("t0")))
    bent = z.select("g", F.lit(1).alias("start"), *[F.tanh(f"t{i}").alias(f"t{i}") for i in range(p)])
    turned = z.select("g", F.lit(2).alias("start"), *[F.coalesce(F.try_divide(F.col(f"t{i}"), norm), F.lit(0.0)) * math.sqrt(p) for i in range(p)])
    both = bent.union(turned)
    products = both.groupBy("g", "start").agg(*[F.avg(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"r{i}_{j}") for i in range(p) for j in range(i + 1)])
    alone = middle.select(F.col("_g").alias("g"), F.lit(0).alias("start"), *[F.lit(float(i == j)).alias(f"r{i}_{j}") for i in range(p) for j in range(i + 1)])
    first = alone.unionByName(products).join(middle, F.col("g") == F.col("_g")).drop("_g")
    for i in range(p):
        for j in range(i + 1):
            first = first.withColumn(f"c{i}_{j}", F.col(f"r{i}_{j}") * F.col(f"s{i}") * F.col(f"s{j}"))
    return first.select("g", "start", *[f"m{i}" for i in range(p)], *[f"c{i}_{j}" for i in range(p) for j in range(i + 1)]), groups


def robust_estimates(rows: DataFrame, features=FEATURES, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group ``g`` of ``rows``: ``(g, n, m{i}, c{i}_{j})``, consistent and reweighted.

    From each of three starts, concentration steps re-estimate mean and covariance from the ``support`` share of a group's rows that are
    nearest to the last estimate. After ``FIRST_STEPS`` the start with the least determinant goes on alone, until no group's log determinant
    changes by more than ``SETTLED`` (or after ``steps``). Rows within its 97.5 % ellipsoid then give the final estimate. All steps are grouped sums over
    narrow rows and limits by mergeable quantile sketches (ranks within 1 in 10,000), so a hot group needs no task of its own.
    """
    names, floors = [f[0] for f in features], tuple(f[2] for f in features)
    p = len(names)
    factor = support / chi2_cdf(chi2_quantile(support, p), p + 2)
    kept = [f"m{i}" for i in range(p)] + [f"l{i}_{j}" for i in range(p) for j in range(i + 1)]
    first, groups = _starts(rows, names, floors)
    now = written(_cholesky(first, floors, 1.0).select("g", "start", "logdet", *kept), "quality-estimates")
    for step in range(steps):
        near = _with_distance(rows, _sized(now, groups), names)
        limit = written(near.groupBy("g", "start").agg(F.percentile_approx("distance2", support, 10000).alias("limit")), "quality-limits")
        limit = limit.select(unplaced(F.col("g"), "string").alias("_h"), F.col("start").alias("_start"), "limit")
        near = near.join(_sized(limit, groups), (F.col("g") == F.col("_h")) & (F.col("start") == F.col("_start")) & (F.col("distance2") <= F.col("limit")))
        stats = _cholesky(_moments(near, names, "g", "start"), floors, factor).select("g", "start", "logdet", *kept)
        old = now.select(F.col("g").alias("_g"), F.col("start").alias("_start"), F.col("logdet").alias("_logdet"))
        now = written(stats.join(old, (F.col("g") == F.col("_g")) & (F.col("start") == F.col("_start"))).drop("_g", "_start"), "quality-estimates")
        fall = now.agg(F.max(F.abs(F.col("_logdet") - F.col("logdet")))).first()[0]
        now = now.drop("_logdet")
        if step == FIRST_STEPS - 1:
            best = now.groupBy("g").agg(F.min_by(F.struct("start", "logdet", *kept), F.struct("logdet", "start")).alias("b"))
            now = written(best.select("g", "b.*"), "quality-best")
        elif step >= FIRST_STEPS and (fall is None or fall <= SETTLED):
            break
    within = _with_distance(rows, _sized(now, groups), names).where(F.col("distance2") <= chi2_quantile(WITHIN, p))
    again = WITHIN / chi2_cdf(chi2_quantile(WITHIN, p), p + 2)
    found = _moments(within, names, "g")
    return found.select("g", "n", *[f"m{i}" for i in range(p)], *[(F.col(f"c{i}_{j}") * again).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)])


def _shrunk(estimates: DataFrame, groups: DataFrame, p: int) -> DataFrame:
    """Estimates of each ``g2``, drawn towards that of its language and that one towards the estimate of all rows, as by ``PRIOR`` rows more."""
    stats = [f"m{i}" for i in range(p)] + [f"c{i}_{j}" for i in range(p) for j in range(i + 1)]
    side = lambda tag: estimates.select(F.col("g").alias(f"_{tag}"), F.struct("n", *stats).alias(tag))
    out = groups.join(side("own"), F.col("g2") == F.col("_own"), "left").join(side("lang"), F.col("g1") == F.col("_lang"), "left")
    out = out.crossJoin(F.broadcast(estimates.where("g = '0'").select(F.struct("n", *stats).alias("whole"))))  # one row

    def drawn(tag: str, c: str, to):
        n = F.coalesce(F.col(f"{tag}.n"), F.lit(0))
        return (n * F.coalesce(F.col(f"{tag}.{c}"), F.lit(0.0)) + PRIOR * to) / (n + PRIOR)

    return out.select(F.col("g2").alias("g"), *[drawn("own", c, drawn("lang", c, F.col(f"whole.{c}"))).alias(c) for c in stats])


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """All columns of ``docs`` plus the statistics, ``base_failed``, ``distance2`` and ``kept``.

    Rows that fail a base rule aren't kept and don't enter the estimates; the others are kept unless
    their distance passes the chi-square cut-off for ``tail``. Null texts count as empty and fail; null
    languages and sources are groups of their own; repeated rows count each; an empty table stays
    empty; a very long text costs time in proportion. Columns named like a result are replaced by it; others may have any name.
    """
    docs = docs.drop(*STATISTICS, "base_failed", "distance2", "kept")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    packed = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"), named(lang).alias("lang"), named(source).alias("source"))
    return _judged(packed, tail).select("doc.*", *STATISTICS, "base_failed", "distance2", "kept")


def _judged(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """``docs (text, lang, source, ...)`` without these three, with statistics and verdicts; ``text`` isn't written."""
    keys = {"g2": F.concat_ws("\t", F.lit("2"), "lang", "source"), "g1": F.concat_ws("\t", F.lit("1"), "lang")}
    rows = with_statistics(docs).drop("text").withColumns(keys).drop("lang", "source").withColumn("base_failed", base_failed())
    rows = written(rows.withColumns({n: F.when(~F.col("base_failed"), F.expr(e)) for n, e, _ in FEATURES}), "quality-statistics")
    names, floors = [f[0] for f in FEATURES], tuple(f[2] for f in FEATURES)
    good = rows.where("not base_failed").select("g1", "g2", *names)
    groups = written(good.select("g1", "g2").distinct(), "quality-groups")
    estimates = written(robust_estimates(_levels(good)), "quality-estimates")
    final = _cholesky(_shrunk(estimates, groups, len(names)), floors, 1.0)
    kept = [f"m{i}" for i in range(len(names))] + [f"l{i}_{j}" for i in range(len(names)) for j in range(i + 1)]
    final = written(final.select("g", *kept), "quality-estimates")
    cut = chi2_quantile(1 - tail, len(FEATURES))
    out = _with_distance(rows, _sized(final, groups.count()), names, "g2").withColumn("distance2", F.when(~F.col("base_failed"), F.col("distance2")))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cut, F.lit(True)))
    return out.select(*[c for c in rows.columns if c not in (*names, "g1", "g2")], "distance2", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    judged = _judged(docs.select("doc_id", "text", named("lang").alias("lang"), named("source").alias("source")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
