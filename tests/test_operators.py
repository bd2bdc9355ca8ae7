"""Edge rules on small hand-made tables; the registered queries are held against SQL in test_queries."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairflow.functions.tails import correlation_p, normal_p
from pairflow.operators import classes, cleaning, crosscorr, differencing, filters, graph, information, pairing, places, ranks, regression, resample, series as whole, spatial, trend
from pairflow.plans.tables import steps_of
from pairflow.sources import readers

D = dt.date


def series(spark, rows):
    return spark.createDataFrame(rows, "entity string, date date, wte double")


def test_pchip_passes_knots_and_stays_between(spark):
    knots = [("a", D(2020, 1, 15), 1.0), ("a", D(2020, 2, 15), 3.0), ("a", D(2020, 5, 15), 3.0), ("a", D(2020, 6, 15), 2.0)]
    got = {r.date: r.wte for r in resample.pchip(series(spark, knots)).collect()}
    assert got[D(2020, 1, 15)] == 1.0 and got[D(2020, 2, 15)] == 3.0 and got[D(2020, 6, 15)] == 2.0
    assert got[D(2020, 3, 15)] == 3.0 and len(got) == 6
    daily = [r.wte for r in resample.pchip(series(spark, knots), grid="daily").orderBy("date").collect()]
    assert min(daily) >= 1 - 1e-12 and max(daily) <= 3 + 1e-12 and len(daily) == 153


def test_pchip_leaves_out_whole_entities(spark):
    rows = [("one", D(2020, 1, 1), 1.0), ("twice", D(2020, 1, 1), 1.0), ("twice", D(2020, 1, 1), 2.0), ("twice", D(2020, 3, 1), 2.0), ("null", D(2020, 1, 1), None), ("null", D(2020, 4, 1), 1.0),
            ("gap", D(2020, 1, 16), 1.0), ("gap", D(2020, 1, 30), 2.0), ("two", D(2020, 1, 1), 0.0), ("two", D(2020, 1, 29), 28.0)]
    got = resample.pchip(series(spark, rows)).collect()
    assert [(r.entity, round(r.wte, 9)) for r in got] == [("two", 14.0)]


def test_iqr_needs_rows_and_a_range(spark):
    flat = [("flat", D(2020, 1, i + 1), 5.0 if i < 9 else 50.0) for i in range(10)]
    few = [("few", D(2020, 1, i + 1), v) for i, v in enumerate([1.0, 2.0, 3.0, 900.0])]
    wide = [("wide", D(2020, 1, i + 1), float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 900])]
    got = cleaning.iqr_outliers(series(spark, flat + few + wide)).where("is_outlier").collect()
    assert [(r.entity, r.wte) for r in got] == [("wide", 900.0)]


def test_regression_guards(spark):
    rows = [("line", float(i), 2.0 * i + 1) for i in range(12)] + [("flat_x", 1.0, float(i)) for i in range(12)] + [("flat_y", float(i), 1.0) for i in range(12)]
    rows += [("few", float(i), float(i * i)) for i in range(9)] + [("nulls", None, 1.0)] * 12
    got = regression.regression(spark.createDataFrame(rows, "grp string, delta_wte double, delta_q double"), ("grp",), least=10, p=True).collect()
    assert [r.grp for r in got] == ["line"]
    assert got[0].slope == pytest.approx(2) and got[0].intercept == pytest.approx(1) and got[0].r2 == pytest.approx(1) and got[0].p < 1e-10


def test_spearman_shares_ranks_of_ties(spark):
    rows = [("g", x, y) for x, y in [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 5.0)]]
    got = regression.spearman(spark.createDataFrame(rows, "grp string, delta_wte double, delta_q double"), ("grp",)).first()
    a, b = np.array([1.5, 1.5, 3, 4]), np.array([1, 2.5, 2.5, 4])
    assert got.spearman == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_tail_probabilities(spark):
    # t with 8 degrees: r = 0.6319 is the 5 % point of 10 pairs; with 1 degree the law is Cauchy's
    got = spark.createDataFrame([(0.631897, 10), (math.sqrt(0.5), 3), (1.0, 5), (None, 5), (0.3, 2)], "r double, n long").select(correlation_p("r", "n").alias("p")).collect()
    assert got[0].p == pytest.approx(0.05, abs=1e-5) and got[1].p == pytest.approx(0.5) and got[2].p == 0.0 and got[3].p is None and got[4].p is None
    assert spark.range(1).select(normal_p(F.lit(1.959964)).alias("p")).first().p == pytest.approx(0.05, abs=1e-6)


def beta_inc(a, b, x):
    """Regularised incomplete beta function by its continued fraction."""
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 5000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            out *= d * c
    return front * out


def test_tail_probabilities_over_a_grid(spark):
    assert beta_inc(2.0, 3.0, 0.5) == pytest.approx(0.6875)
    grid = [(r, n) for n in (3, 4, 5, 10, 37, 1000, 250_000, 10_000_000) for r in (1e-4, 0.0004, 0.03, -0.2, 0.55, -0.9, 0.9999)]
    got = spark.createDataFrame(grid, "r double, n long").select("r", "n", correlation_p("r", "n").alias("p")).collect()
    for row in got:
        assert row.p == pytest.approx(beta_inc((row.n - 2) / 2, 0.5, 1 - row.r * row.r), rel=1e-7, abs=1e-300), row
    zs = [0.0, 1e-6, -0.5, 1.0, 3.3, -9.0, 37.0]
    for row in spark.createDataFrame([(z,) for z in [*zs, None]], "z double").select("z", normal_p("z").alias("p")).collect():
        assert row.p is None if row.z is None else row.p == pytest.approx(math.erfc(abs(row.z) / math.sqrt(2)), rel=1e-11)


def test_mutual_information_edges(spark):
    flat = [("flat", 1.0, float(i)) for i in range(10)]
    same = [("same", float(i % 10), float(i % 10)) for i in range(20)]
    few = [("few", float(i), float(i)) for i in range(9)]
    got = {r.grp: r.mi for r in information.mutual_information(spark.createDataFrame(flat + same + few, "grp string, delta_wte double, delta_q double"), ("grp",)).collect()}
    assert got["flat"] == 0 and got["same"] == pytest.approx(math.log(10)) and got["few"] is None


def test_lag_clips_month_ends_and_fans_out(spark):
    rows = [("a", "g", D(2020, 2, 29), 2.0), ("a", "g", D(2019, 2, 28), 1.0), ("b", "g", D(2020, 1, 1), 1.0), ("b", "h", D(2020, 1, 1), 1.0), ("b", "g", D(2021, 1, 1), 3.0)]
    df = spark.createDataFrame(rows, "entity string, grp string, date date, delta_wte double")
    got = pairing.lagged(df, 1)
    assert got.where("entity = 'a'").count() == 1 and got.where("entity = 'b'").count() == 2
    assert pairing.lagged(df, 1, by=("entity", "grp")).where("entity = 'b'").count() == 1


def test_baseline_takes_each_column_apart(spark):
    rows = [("a", "g", D(2020, 1, 1), 1.0, None, 1), ("a", "g", D(2020, 2, 1), 2.0, 20.0, 1), ("b", "g", D(2020, 1, 1), 1.0, 1.0, 0)]
    got = {r.entity: (r.wte0, r.q0) for r in pairing.with_baseline(spark.createDataFrame(rows, "entity string, grp string, date date, wte double, q double, bfd int")).collect()}
    assert got == {"a": (1.0, 20.0), "b": (None, None)}


def test_mann_kendall_line_ties_and_short_series(spark):
    rows = [("line", i, float(3 * i)) for i in range(8)] + [("short", i, 1.0) for i in range(3)] + [("flat", i, 1.0) for i in range(5)]
    got = {r.k: r for r in trend.mann_kendall(spark.createDataFrame(rows, "k string, date int, x double"), "k").collect()}
    assert got["line"].slope == 3 and got["line"].s == 28 and got["line"].trend == "increasing" and got["line"].tau == 1
    assert got["short"].trend == "insufficient data" and got["short"].s is None and got["flat"].trend == "no trend"


def brute_slopes(x):
    i, j = np.triu_indices(len(x), 1)
    return (x[j] - x[i]) / (j - i)


def test_counting_and_selection_equal_all_pairs():
    rng = np.random.default_rng(7)
    for n in (2, 3, 5, 31, 64, 65, 257, 300, 501):
        for x in (rng.normal(size=n), rng.integers(0, 4, n).astype(float), 3.0 * np.arange(n), np.ones(n), rng.normal(size=n).cumsum() * 1e6):
            i, j = np.triu_indices(n, 1)
            assert trend.falls(x, True) == (x[j] <= x[i]).sum() and trend.falls(x, False) == (x[j] < x[i]).sum()
            assert trend.median_slope(x) == pytest.approx(np.median(brute_slopes(x)), rel=1e-9, abs=1e-12)
            for k in {1, n * (n - 1) // 2, n * (n - 1) // 3 + 1}:
                assert trend._slope(x, k) == pytest.approx(np.sort(brute_slopes(x))[k - 1], rel=1e-9, abs=1e-9 * (1 + abs(x).max()))


def test_mann_kendall_of_a_century_of_days(spark):
    """36,500 points, whose 666 million pairs are only counted here, in blocks."""
    n = 36_500
    x = np.array([i // 50 + i * 7919 % 211 + math.sin(i) for i in range(n)])
    rows = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("date"), (F.floor(F.col("id") / 50) + F.col("id") * 7919 % 211 + F.sin("id")).alias("x"))
    got = trend.mann_kendall(rows, "k").first()
    s = below = up_to = 0
    for a in range(0, n, 500):
        j = np.arange(a, n)
        own = np.arange(a, min(n, a + 500))
        later = j[None, :] > own[:, None]
        d = x[None, j] - x[own][:, None]
        s += int(np.sign(d)[later].sum())
        m = got.slope * (j[None, :] - own[:, None])
        below += int((d < m - 1e-9)[later].sum())
        up_to += int((d < m + 1e-9)[later].sum())
    assert got.n == n and got.s == s and below <= n * (n - 1) // 4 <= up_to and got.trend == "increasing"


def test_series_are_whole_in_order_and_apart(spark):
    """Keys with nulls, series longer than a batch, series without rows out."""
    rows = [(k, None if k == "b" else 1, i, float(i)) for k in ("a", "b", None) for i in range(50)] + [("a", 2, 0, 9.0), ("few", 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "k string, g int, at int, x double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        told = lambda x: None if x[0] == 1.0 else ([len(x)], [float((np.diff(x) == 1).all())])
        got = {(r.k, r.g): (r.n, r.whole) for r in whole.by_series(df, ("k", "g"), ("at",), ("x",), told, "n long, whole double").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {("a", 1): (50, 1.0), ("b", None): (50, 1.0), (None, 1): (50, 1.0), ("a", 2): (1, 1.0)}
    assert whole.by_series(df.limit(0), ("k", "g"), ("at",), ("x",), told, "n long, whole double").count() == 0


def test_series_stay_whole_after_a_join_that_becomes_a_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    own = spark.conf.get(name)
    spark.conf.set(name, "256KB")  # less than the plan's estimate, more than the sizes at run time
    try:
        rows = spark.range(400000, numPartitions=8).select((F.col("id") % 10).cast("string").alias("k"), F.col("id").alias("at"), F.col("id").cast("double").alias("x"))
        good = rows.groupBy("k").agg(F.count("*").alias("n")).where("n >= 10")
        got = whole.by_series(rows.join(good.select("k"), "k", "left_semi"), ("k",), ("at",), ("x",), lambda x: ([len(x)], [x[0]]), "n long, first double")
        assert sorted(tuple(r) for r in got.collect()) == [(str(k), 40000, float(k)) for k in range(10)]
    finally:
        spark.conf.set(name, own)


def test_cross_correlation_over_ten_years_of_lags(spark):
    n, limit = 9000, 3650
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=n).cumsum(), rng.normal(size=n)
    y[40:] += x[:-40]
    rows = spark.createDataFrame([("g", "e", i, float(x[i]), float(y[i])) for i in range(n)], "grp string, entity string, date int, delta_wte double, delta_q double")
    got = {r.lag: (r.n, r.c) for r in crosscorr.cross_correlation(rows).collect()}
    zx, zy = ((v - v.mean()) / v.std() for v in (x, y))
    direct = lambda lag: sum(zx[max(0, lag) : n + min(0, lag)] * zy[max(0, -lag) : n - max(0, lag)]) / n
    assert sorted(got) == list(range(-limit, limit + 1))
    assert all(got[lag] == (n, pytest.approx(direct(lag), abs=1e-9)) for lag in (-limit, -3649, -777, -40, -1, 0, 1, 40, 2000, limit))
    late = {r.lag: (r.n, r.r) for r in crosscorr.lagged_correlation(rows, limit=limit).collect()}
    assert len(late) == limit + 1
    assert all(late[lag] == (n - lag, pytest.approx(np.corrcoef(x[: n - lag], y[lag:])[0, 1], abs=1e-9)) for lag in (0, 1, 40, 999, limit))
    assert np.allclose(crosscorr.lag_sums(x, y, -7, 9, chunk=100), [sum(x[i] * y[i - k] for i in range(n) if 0 <= i - k < n) for k in range(-7, 10)])


def test_lags_over_constant_rows_are_left_out(spark):
    x = [1.0] * 30 + [2.0, 3.0, 1.0, 5.0, 2.0, 9.0]
    rows = spark.createDataFrame([("g", "e", i, x[i], float(i * i % 11)) for i in range(36)], "grp string, entity string, date int, delta_wte double, delta_q double")
    assert {r.lag for r in crosscorr.lagged_correlation(rows, limit=60).collect()} == set(range(6))
    assert crosscorr.lagged_correlation(rows.limit(35)).count() == 0 and crosscorr.cross_correlation(rows.limit(35)).count() == 0


def test_exact_quantiles_and_ranks(spark):
    rows = [(k, v) for k in ("a", "b", None) for v in [None, 3.0, 1.0, 1.0, 2.5, -4.0, 7.0][: 7 if k else 3]] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.005, 0.25, 0.5, 0.9, 1.0]
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()}
    got = {r.k: r.q for r in ranks.exact_quantiles(df, "v", probs, ["k"]).collect()}
    assert got == {k: q for k, q in want.items() if k != "empty"}
    assert ranks.exact_quantiles(df, "v", probs).first().q == df.agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).first().q
    assert ranks.exact_quantiles(df.limit(0), "v", [0.5]).first().q == [None]
    big = spark.range(20_000).select((F.col("id") * 7919 % 5003).cast("double").alias("v"))
    got = {r.value: (r.c, r.before, r.n) for r in ranks.value_ranks(big, "v").collect()}
    seen = 0
    for v in sorted(got):
        assert got[v][1:] == (seen, 20_000)
        seen += got[v][0]


def test_consecutive_differences_only(spark):
    rows = [("a", "g", D(y, m, 15), float(y), 1.0) for y in (2001, 2002, 2004) for m in range(1, 8)]
    got = differencing.annual(spark.createDataFrame(rows, "entity string, grp string, date date, wte double, q double")).collect()
    assert [(r.year, r.delta_wte) for r in got] == [(2002, 1.0)]


def test_lag_signs(spark):
    x = [math.sin(i * i) for i in range(60)]
    rows = [("g", "e", D(2000, 1, 1) + dt.timedelta(days=i), x[i], x[i - 3] if i >= 3 else 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "grp string, entity string, date date, delta_wte double, delta_q double")
    assert crosscorr.peaks(crosscorr.cross_correlation(df)).first().best_lag == -3
    assert crosscorr.peaks(crosscorr.lagged_correlation(df, limit=12), value="r").first().best_lag == 3


def test_graph_cases(spark):
    net = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 10)] + [(i, i + 1) for i in range(100, 260)], "src long, dst long")
    gages = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("d", 10), ("e", 77), ("f", 260)], "id string, link long")
    assert {r.id for r in graph.terminal_groups(gages, net).collect()} == {"d", "e", "f"}
    below = {r.link: (r.gage, r.depth) for r in graph.first_gage_below(gages, net).collect()}
    assert below[1] == ("a", 0) and below[2] == ("b", 1) and below[11] == ("d", 1) and 160 not in below and below[161] == ("f", 99) and 4 not in below
    up = graph.upstream_links(gages.where("id in ('a', 'b', 'd')"), net)
    assert {(r.gage, r.upstream_link) for r in up.collect()} == {("a", 1), ("b", 1), ("b", 2), ("b", 3), ("d", 10), ("d", 11)}


def brute_upstream(net, links, lengths):
    """Each link's upstream nodes with links and length on the first way down."""
    below, out = dict(net), {}
    for start in {n for e in net for n in e} | set(links):
        node, steps, along, seen = start, 0, 0.0, set()
        while node is not None and node not in seen:
            seen.add(node)
            if node in links:
                out[node, start] = (steps, along)
            steps, along, node = steps + 1, along + lengths.get(node, 0.0), below.get(node)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_interval_labels_find_all_upstream_nodes(spark, seed):
    """Random forests with chains, stars, cycles with trees on them, nested gages and links outside the network."""
    rng = np.random.default_rng(seed)
    net = {i: int(rng.integers(0, i)) for i in range(1, 60)} | {i: i - 1 for i in range(101, 170)} | {i: 200 for i in range(201, 230)}
    net |= {300: 301, 301: 302, 302: 300, 303: 301, 304: 303, 305: 302, 310: 310, 311: 310}
    if seed == 3:
        net = {k: v for k, v in net.items() if k < 300}
    lengths = {n: float(n % 7) for n in net if n % 5}
    links = [0, 3, 7, 20, 59, 100, 130, 169, 200, 210, 300, 302, 304, 310, 999]
    frame = spark.createDataFrame(list(net.items()), "src long, dst long")
    far = spark.createDataFrame(list(lengths.items()), "link long, length double")
    wanted = spark.createDataFrame([(n,) for n in [*links, None, 3]], "link long")
    rows = graph.upstream_pairs(wanted, frame, far).collect()
    assert {(r.link, r.node): (r.steps, r.along) for r in rows} == brute_upstream(list(net.items()), links, lengths) and len(rows) == len({(r.link, r.node) for r in rows})


def test_upstream_summary_and_unsettled_networks(spark):
    net = spark.createDataFrame([(1, 2), (2, 3), (4, 3)], "src long, dst long")
    gages = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 3)], "id string, link long")
    far = spark.createDataFrame([(1, 10.0), (2, 1.0), (4, None)], "link long, length double")
    got = {r.gage: tuple(r)[1:] for r in graph.upstream_summary(gages.where("id in ('a', 'c')"), gages, net, far).collect()}
    assert got == {"a": (1, 0, None, None), "c": (4, 4, 1.0, 3.0)}
    with pytest.raises(RuntimeError):
        graph.terminal_groups(gages, spark.createDataFrame([(i, i + 1) for i in range(1, 99)], "src long, dst long"), rounds=2)


def test_blocks_make_up_each_interval(spark):
    rows = [(a, b) for a in (0, 1, 5, 64, 1000) for b in (0, 1, 7, 63, 64, 65, 999, 5000) if a <= b]
    for r in spark.createDataFrame(rows, "a long, b long").select("a", "b", graph._blocks(F.col("a"), F.col("b")).alias("x")).collect():
        assert sorted(i for c in r.x for i in range(c["index"] << c.level, (c["index"] + 1) << c.level)) == list(range(r.a, r.b + 1)) and len(r.x) <= 2 * 13


def points_frame(spark, n, seed):
    rng = np.random.default_rng(seed)
    spread = np.concatenate([rng.normal(0, 1, (n // 2, 2)), rng.normal(0, 300, (n - n // 2, 2)), [[1e5, -3e4]]])
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spread)], "point_id int, x double, y double"), spread


def line_of(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def test_nearest_line_of_all_sizes_and_distances(spark):
    """Lines from a thousandth to thousands of cells long, in clusters and apart, against all distances."""
    rng = np.random.default_rng(5)
    points, spread = points_frame(spark, 120, 1)
    lines = []
    for i in range(150):
        at = rng.normal(0, [1, 50, 2000][i % 3], 2)
        size = 10.0 ** rng.uniform(-3, 3.5)
        lines.append((i, line_of(at, at + rng.normal(0, size, 2), at + rng.normal(0, size, 2))))
    lines += [(150, lines[0][1]), (151, line_of((3, 3), (3, 3))), (152, line_of((0, 0)))]
    got = {r.point_id: (r.line_id, r.distance) for r in spatial.nearest_line(points, spark.createDataFrame(lines, "line_id int, line array<struct<x:double,y:double>>"), 0.7).collect()}

    def apart(p, a, b):
        d = b - a
        t = min(1.0, max(0.0, (p - a) @ d / (d @ d))) if d @ d else 0.0
        return math.hypot(*(p - a - t * d))

    pieces = [(i, np.array([a["x"], a["y"]]), np.array([b["x"], b["y"]])) for i, line in lines for a, b in zip(line, line[1:], strict=False)]
    for i, p in enumerate(spread):
        distance, line = min((apart(p, a, b), n) for n, a, b in pieces)
        assert got[i] == (line, pytest.approx(distance, abs=1e-6)), i
    empty = spark.createDataFrame([], "line_id int, line array<struct<x:double,y:double>>")
    assert spatial.nearest_line(points, empty, 1.0).count() == 0
    lost = spark.createDataFrame([(1, None, 2.0)], "point_id int, x double, y double")
    assert spatial.nearest_line(lost, spark.createDataFrame(lines, "line_id int, line array<struct<x:double,y:double>>"), 1.0).count() == 0


def test_covers_stay_small_and_find_all(spark):
    """Polygons from one to a million cells; each has 25 cells at most, and joins equal those of all pairs."""
    points, spread = points_frame(spark, 200, 2)
    rng = np.random.default_rng(8)
    rings = [(i, line_of(*(rng.normal(0, 50, 2) + 10.0 ** rng.uniform(-1, 3.2) * np.array([(math.cos(a), math.sin(a)) for a in np.sort(rng.uniform(0, 6.28, 7))])))) for i in range(60)]
    polygons = spark.createDataFrame(rings, "polygon_id int, ring array<struct<x:double,y:double>>")
    cells = polygons.select(F.size(spatial._own_cells(spatial._box(F.col("ring")), 0.001)).alias("n")).agg(F.max("n")).first()[0]
    assert cells <= 25

    def within(p, ring):
        odd = False
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a["y"] > p[1]) != (b["y"] > p[1]) and p[0] < (b["x"] - a["x"]) * (p[1] - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                odd = not odd
        return odd

    want = {(i, n) for i, p in enumerate(spread) for n, ring in rings if within(p, ring)}
    rows = spatial.points_in_polygons(points, polygons, 0.5).collect()
    assert {(r.point_id, r.polygon_id) for r in rows} == want and len(rows) == len(want)
    twice = points.union(points)
    assert sorted(r.point_id for r in spatial.within_any(twice, polygons, 0.5).collect()) == sorted(2 * [i for i in {i for i, _ in want}])
    lines = spark.createDataFrame([(i, line_of(p, p + rng.normal(0, 10.0 ** rng.uniform(-2, 3), 2))) for i, p in enumerate(spread)], "line_id int, line array<struct<x:double,y:double>>")
    met = {(r.line_id, r.polygon_id) for r in spatial.lines_meeting_polygons(lines, polygons, 0.5).collect()}
    every = {(r.line_id, r.polygon_id) for r in spatial.lines_meeting_polygons(lines, polygons, 1e7).collect()}  # one cell for all
    assert met == every and met >= want and len(met) > len(want)


def test_utm_of_known_places(spark):
    """On the central meridian the northing is 0.9996 of the meridian arc; a degree beside it, eastings are mirrored."""
    f, a = spatial.FLATTENING, spatial.AXIS
    e2 = f * (2 - f)
    phi = np.linspace(0, math.radians(40), 200_001)
    arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, phi)
    rows = spark.createDataFrame([(-111.0, 40.0), (-112.0, 40.0), (-110.0, 40.0), (-111.0, 0.0)], "lon double, lat double")
    east, north = spatial.to_utm(F.col("lon"), F.col("lat"))
    got = [tuple(r) for r in rows.select(east.alias("e"), north.alias("n")).collect()]
    assert got[0] == (pytest.approx(500_000, abs=1e-6), pytest.approx(0.9996 * arc, abs=1e-3)) and got[3] == (pytest.approx(500_000, abs=1e-6), pytest.approx(0, abs=1e-6))
    assert got[1][0] + got[2][0] == pytest.approx(1_000_000, abs=1e-6) and got[1][1] == pytest.approx(got[2][1], abs=1e-6) and 414_000 < got[1][0] < 415_000


def test_reaches_with_elevation_and_gage_below(spark):
    shape = "line_id long, line array<struct<x:double,y:double>>"
    lines = spark.createDataFrame([(1, line_of((-111.1, 40.0), (-111.0, 40.0))), (2, line_of((-111.0, 40.0), (-110.9, 40.0))), (9, line_of((-100.0, 30.0), (-100.1, 30.0)))], shape)
    points = spark.createDataFrame([("p", -111.05, 40.01), ("q", -110.95, 39.99), ("far", -100.05, 30.3)], "entity string, lon double, lat double")
    heights = spark.createDataFrame([(1, 1500.0), (1, 1400.0)], "line_id long, reach_elevation double")
    net = spark.createDataFrame([(1, 2)], "src long, dst long")
    got = {r.entity: r for r in places.reaches_of(points, lines, heights, net, spark.createDataFrame([("g", 2)], "id string, link long")).collect()}
    assert tuple(got["p"])[1:3] == (1, 1400.0) and got["p"].downstream_gage == "g" and 1105 < got["p"].distance < 1115
    assert tuple(got["q"])[1:3] == (2, None) and got["q"].downstream_gage == "g" and got["far"].reach == 9 and got["far"].downstream_gage is None


def test_within_excludes_sides(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)]
    polygon = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "polygon_id int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 0.0, 0.0), (4, 2.0, 0.0), (5, 3.0, 3.0), (6, 9.0, 9.0)], "point_id int, x double, y double")
    assert [r.point_id for r in spatial.points_in_polygons(points, polygon, 1.0).collect()] == [1]


def test_nearest_line_ties_go_to_the_smallest_id(spark):
    vertex = "line_id int, line array<struct<x:double,y:double>>"
    lines = spark.createDataFrame([(2, [{"x": 0.0, "y": 1.0}, {"x": 5.0, "y": 1.0}]), (1, [{"x": 0.0, "y": -1.0}, {"x": 5.0, "y": -1.0}]), (3, [{"x": 50.0, "y": 0.0}, {"x": 60.0, "y": 0.0}])], vertex)
    points = spark.createDataFrame([("p", 2.0, 0.0), ("q", 40.0, 0.0)], "point_id string, x double, y double")
    got = {r.point_id: (r.line_id, r.distance) for r in spatial.nearest_line(points, lines, 0.5).collect()}
    assert got == {"p": (1, 1.0), "q": (3, 10.0)}


def test_top_n_is_deterministic_without_nulls(spark):
    df = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 1.0), ("g", "c", None), ("g", "d", 0.5)], "grp string, entity string, m double")
    assert [r.entity for r in filters.top_n(df, 2, "m").orderBy("rank").collect()] == ["a", "b"]


def test_bins_are_right_closed(spark):
    rows = series(spark, [("a", D(2020, 1, 1), 0.0)])
    for height, label in ((-20.0, "< -20"), (0.0, "-5 to 0"), (30.0, "20 to 30")):
        reach = spark.createDataFrame([("a", height)], "entity string, reach_elevation double")
        assert filters.elevation_filter(rows, reach)[1].first().bin == label


def test_readers_resolve_aliases(spark):
    df = spark.createDataFrame([("12.0", "2020-01-02", "1.5"), ("7", "bad", "x")], "WELL_ID string, Date string, lev_va string")
    got = readers.levels(df).orderBy("entity").collect()
    assert [(r.entity, r.date, r.wte) for r in got] == [("12", D(2020, 1, 2), 1.5), ("7", None, None)]
    with pytest.raises(ValueError):
        readers.levels(df.drop("Date"))


def test_flow_folder_reads_ids_from_names(spark, tmp_path):
    (tmp_path / "g1.csv").write_text("date,q,ML_BFD\n2020-01-01,1.5,1\n2020-01-02,2,0\n")
    (tmp_path / "g2.csv").write_text("date,q,ML_BFD\n2020-01-01,3,1\n")
    got = {(r.grp, r.q) for r in readers.flow_folder(spark, str(tmp_path)).collect()}
    assert got == {("g1", 1.5), ("g2", 3.0)}


def test_steps():
    assert steps_of("all") == (1, 9) and steps_of("3-5") == (3, 5) and steps_of("7,4") == (4, 7) and steps_of("2") == (2, 2)


def test_classes_and_names_of_unknown_keys(spark):
    df = spark.createDataFrame([("1", 2.0), ("2", -1.0), ("3", None), (None, 5.0)], "grp string, z double")
    kinds = spark.createDataFrame([(1, "Ref"), (1, "Ref"), (2, "Non-ref"), (3, "other")], "grp int, class string")
    got = {r.grp: r["class"] for r in classes.with_class(df, kinds).collect()}
    assert got == {"1": "Regulated", "2": "Unregulated", "3": "Unclassified", None: "Unclassified"}
    named = classes.with_name(df, kinds.withColumnRenamed("class", "name"), "grp")
    assert named.columns == ["grp", "name", "z"] and named.count() == 4 and named.where("grp is null").first().name is None
    assert {r.grp for r in classes.without_outer_noise(df, ("z",), 2.0).collect()} == {"1", "2"}
    assert classes.pearson(df, ("grp",), "z", "z").count() == 0 and classes.slope_split(df, slope="z").where("grp = '2'").first().n_negative == 1


def test_nine_steps_and_resume(spark, tmp_path):
    """Two gages on one river; the lower one is terminal and has both catchments. Well w3 lies in none, w2 too far below its reach."""
    from pairflow.plans import study
    from pairflow.plans.tables import StaleStep, Store

    square = lambda i, x: (i, [(x, 0.0), (x + 1.0, 0.0), (x + 1.0, 1.0), (x, 1.0)])
    days = [(2000 + m // 12, m % 12 + 1) for m in range(60)]
    levels = [(w, dt.date(y, m, 5), base + m + (y - 2000) * 2.0) for w, base in (("w1", 5000.0), ("w2", 100.0), ("w3", 5000.0)) for y, m in days]
    inputs = {
        "network": spark.createDataFrame([(1, 2), (2, 0)], "link long, below long"),
        "gages": spark.createDataFrame([("a", 1), ("b", 2)], "id string, link long"),
        "points": spark.createDataFrame([("w1", 0.5, 0.5), ("w2", 1.5, 0.5), ("w3", 9.5, 9.5)], "entity string, x double, y double"),
        "catchments": spark.createDataFrame([square(1, 0.0), square(2, 1.0)], "polygon_id long, ring array<struct<x: double, y: double>>"),
        "lines": spark.createDataFrame([(7, [(0.0, 0.4), (2.0, 0.4)])], "line_id long, line array<struct<x: double, y: double>>"),
        "elevations": spark.createDataFrame([(7, 1500.0)], "line_id long, reach_elevation double"),
        "levels": spark.createDataFrame(levels, "entity string, date date, wte double"),
        "flows": spark.createDataFrame([("b", dt.date(y, m, 9), 120.0 * y + 10 * m, 1) for y, m in days], "grp string, date date, q double, bfd int"),
    }
    store = Store(spark, str(tmp_path))
    got = study.run(store, inputs, cell=0.5).collect()
    assert [(r.entity, r.grp) for r in got] == [("w1", "b")] and got[0].r2 > 0.5
    assert {(r.entity, r.grp) for r in store.load("members").collect()} == {("w1", "b"), ("w2", "b")}
    assert {r.entity for r in store.load("near_stream").collect()} == {"w1"}
    assert study.run(store, {}, "8-9").collect() == got
    assert study.run(store, inputs, "6", buffer=5000.0).select("entity").distinct().count() == 2
    with pytest.raises(ValueError):
        study.run(store, inputs, "9", no_such=1)
    seen = {r.step: r for r in study.observed(store).collect()}
    assert len(seen) == 9 and seen["checked"].rows == 120 and seen["checked"].about_entity == 2 and seen["monthly"].first_date == "2000-01-15"
    for steps, how in (("8-9", {}), ("7", {"buffer": 30.0}), ("5-6", {"years": 1.0})):  # step 6 has been written anew, with another buffer
        with pytest.raises(StaleStep):
            study.run(store, {}, steps, **how)
    study.run(store, inputs, "7-9", buffer=5000.0)
    with pytest.raises(StaleStep):
        study.run(store, inputs | {"levels": inputs["levels"].limit(5)}, "9")
    (tmp_path / "deltas" / "_manifest.json").unlink()
    with pytest.raises(StaleStep, match="half-written"):
        study.run(store, {}, "9")
    with pytest.raises(StaleStep, match="never"):
        Store(spark, str(tmp_path / "none")).load("fits")


def unsteady(spark, n, *columns):
    """``id`` 0 to n - 1, ``columns``, and ``x``, which is another number whenever it is read, as sums of doubles may be."""
    return spark.range(n, numPartitions=4).select(*columns, F.udf(lambda i: random.random(), "double").asNondeterministic()(F.col("id")).alias("x"))


def test_first_values_are_those_of_their_own_rows(spark):
    rows = unsteady(spark, 400, (F.col("id") % 40).cast("string").alias("entity"), F.lit("g").alias("grp"), F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("id") / 40).cast("int")).alias("date"))
    rows = rows.select("entity", "grp", "date", F.col("x").alias("wte"), F.col("x").alias("q"), F.lit(1).alias("bfd"))
    got = pairing.with_deltas(pairing.with_baseline(rows)).where("date = '2020-01-01'").collect()
    assert len(got) == 40 and all(r.delta_wte == 0 for r in got)


def test_rows_at_a_quantile_are_within(spark):
    rows = unsteady(spark, 250, (F.col("id") % 50).cast("string").alias("grp"), F.col("id").cast("string").alias("entity"))
    got = filters.above_group_quantile(rows, 0.5, "x").groupBy("grp").count().collect()
    assert len(got) == 50 and all(r["count"] == 3 for r in got)
    assert filters.trimmed(unsteady(spark, 1001, "id"), ["x"]).count() == 991
    chosen = places.six_selections({"m": rows.withColumnRenamed("x", "value")}, shares=(0.5,), n=3).groupBy("grp").agg(F.count_distinct("entity").alias("n")).collect()
    assert all(r.n == 3 for r in chosen)


def test_long_crossing_lines_are_keyed_by_the_cells_they_run_through(spark):
    draw = random.Random(5)
    ends = [[draw.uniform(0, 100) for _ in range(4)] for _ in range(300)] + [[7.0, 3.0, 7.0, 90.0], [1.0, 5.0, 99.0, 5.0], [4.0, 4.0, 4.0, 4.0]]
    pieces = spark.createDataFrame([(i, *map(float, e)) for i, e in enumerate(ends)], "line_id int, x1 double, y1 double, x2 double, y2 double")
    for r in pieces.withColumn("c", spatial._path_cells(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], 1.0)).collect():
        cells = {(c.cx, c.cy) for c in r.c}
        width = 2.0 ** r.c[0].level
        assert len(cells) <= 200  # the box of a diagonal holds thousands
        for k in range(1001):
            assert (math.floor((r.x1 + (r.x2 - r.x1) * k / 1000) / width), math.floor((r.y1 + (r.y2 - r.y1) * k / 1000) / width)) in cells
    points = [(i, draw.uniform(-20, 120), draw.uniform(-20, 120)) for i in range(400)]
    lines = pieces.select("line_id", F.expr("array(struct(x1 AS x, y1 AS y), struct(x2 AS x, y2 AS y))").alias("line"))
    near = spatial.nearest_line(spark.createDataFrame(points, "point_id int, x double, y double"), lines, 20.0)
    assert "SortAggregate" not in near._jdf.queryExecution().executedPlan().toString()  # pairs aren't sorted
    got = {r.point_id: (r.line_id, r.distance) for r in near.collect()}

    def distance(x, y, e):
        dx, dy = e[2] - e[0], e[3] - e[1]
        t = min(1.0, max(0.0, ((x - e[0]) * dx + (y - e[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(x - e[0] - t * dx, y - e[1] - t * dy)

    for i, x, y in points:
        d, line = min((distance(x, y, e), k) for k, e in enumerate(ends))
        assert got[i][1] == pytest.approx(d, abs=1e-9) and got[i][0] == line
