"""Link networks (each link has at most one link below) by pointer doubling: at most log2(depth) self-joins, tables never larger than the links."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.plans.tables import kept


def edges(links: DataFrame, link: str = "link", below: str = "below") -> DataFrame:
    """``(src, dst)`` of links with a positive link below; nodes are ends of edges only."""
    return links.where((F.col(below) > 0) & (F.col(link) > 0)).select(F.col(link).cast("bigint").alias("src"), F.col(below).cast("bigint").alias("dst")).distinct()


def _doubling(state: DataFrame, merged: dict, rounds: int, steady: tuple[str, ...], bounded: bool = False) -> DataFrame:
    """``state(node, nxt, ...)``: each round joins a row with that of its ``nxt`` (columns ``b_*``), merges them and jumps twice as far.

    Ends when no row goes on, or when a round has changed none of the ``steady`` columns: they are merged by rules that absorb what they
    already hold, so a round without change is followed by none with one. Cycles, which always go on, end that way. More rounds than
    ``rounds`` are an error, unless they are the bound that is asked for (``bounded``).
    """
    for _ in range(rounds):
        names = [c for c in state.columns if c != "node"]
        far = state.select(F.col("node").alias("b_node"), *[F.col(c).alias(f"b_{c}") for c in names])
        out = state.join(far, F.col("nxt") == F.col("b_node"), "left")
        same = [F.col(c).eqNullSafe(merged[c]) for c in steady]
        moved = ~reduce(and_, same)
        out = kept(out.select("node", F.col("b_nxt").alias("nxt"), *[e.alias(c) for c, e in merged.items()], moved.alias("_moved")))
        goes_on, moves = out.agg(F.max(F.col("nxt").isNotNull()), F.max("_moved")).first()
        state = out.drop("_moved")
        if not (goes_on and moves):
            return state
    if not bounded:
        raise RuntimeError(f"the network did not settle in {rounds} rounds")
    return state


def _nodes(net: DataFrame, extra: DataFrame) -> DataFrame:
    return net.select("src").union(net.select("dst")).union(extra).distinct().withColumnRenamed("src", "node")


def terminal_groups(gages: DataFrame, net: DataFrame, remove: DataFrame | None = None, add: DataFrame | None = None, rounds: int = 62) -> DataFrame:
    """Gages ``(id, link)`` from whose link no other gage's link is reached (two on one link rule each other out).

    ``remove(id)`` are taken out, ``add(id)`` put in if they are matched and not yet there. A link outside the network reaches itself only; cycles are safe.
    """
    own = gages.groupBy("link").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    state = _nodes(net, gages.select(F.col("link").alias("src"))).join(net, F.col("node") == F.col("src"), "left").join(own, F.col("node") == F.col("link"), "left")
    state = kept(state.select("node", F.col("dst").alias("nxt"), "lo", "hi"))
    state = _doubling(state, {"lo": F.least("lo", "b_lo"), "hi": F.greatest("hi", "b_hi")}, rounds, ("lo", "hi"))
    reach = state.select("node", "lo", "hi")
    out = gages.join(reach, F.col("link") == F.col("node")).where((F.col("lo") == F.col("id")) & (F.col("hi") == F.col("id"))).select(*gages.columns)
    if remove is not None:
        out = out.join(remove.select("id").distinct(), "id", "left_anti")
    if add is not None:
        out = out.unionByName(gages.join(add.select("id").distinct(), "id", "left_semi").join(out.select("id"), "id", "left_anti"))
    return out.select(*gages.columns)


def first_gage_below(gages: DataFrame, net: DataFrame, most: int = 100) -> DataFrame:
    """``(link, gage, depth)``: the first gage at or below each link within ``most`` links; of several on a link the smallest id."""
    own = gages.groupBy("link").agg(F.min("id").alias("gage"))
    state = _nodes(net, gages.select(F.col("link").alias("src"))).join(net, F.col("node") == F.col("src"), "left").join(own, F.col("node") == F.col("link"), "left")
    state = state.select("node", F.col("dst").alias("nxt"), "gage", F.when(F.col("gage").isNotNull(), 0).alias("depth"), F.lit(1).alias("step"))
    merged = {"gage": F.coalesce("gage", "b_gage"), "depth": F.coalesce("depth", F.col("b_depth") + F.col("step")), "step": F.col("step") + F.coalesce("b_step", F.lit(0))}
    state = _doubling(kept(state), merged, max(1, (most - 1).bit_length()), ("gage",), bounded=True)
    return state.where(F.col("depth") < most).select(F.col("node").alias("link"), "gage", "depth")


def _path_sums(state: DataFrame, sums: tuple[str, ...], most: int, sizes: bool) -> tuple[DataFrame, bool]:
    """``state(node, nxt, root, ...)`` with ``sums`` added up along each node's way to its root, and ``size``, the nodes that reach it, itself included.

    After k rounds a row holds the sums of up to 2^k steps and the nodes fewer than 2^k steps above it: those farther off are above the
    nodes 2^k steps above. True if some ways have no end within ``most`` nodes, that is, lead into cycles.
    """
    steps = 1
    while True:
        far = state.select(F.col("node").alias("_node"), F.col("nxt").alias("_nxt"), F.col("root").alias("_root"), *[F.col(c).alias(f"_{c}") for c in sums])
        out = state.join(far, F.col("nxt") == F.col("_node"), "left")
        if sizes:
            above = state.where("nxt is not null").groupBy(F.col("nxt").alias("_below")).agg(F.sum("size").alias("_size"))
            out = out.join(above, F.col("node") == F.col("_below"), "left").withColumn("size", F.col("size") + F.coalesce("_size", F.lit(0)))
        out = out.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums})
        out = out.withColumns({"root": F.coalesce("_root", "root"), "nxt": F.col("_nxt")})
        state = kept(out.select(*state.columns))
        steps *= 2
        if state.where("nxt is not null").isEmpty():
            return state, False
        if steps > most:
            return state, True


def _cycles(net: DataFrame, reached: DataFrame) -> DataFrame:
    """``(node, ring, around, cut)``: the nodes of cycles, given those that every way ends on; the links and the length of their cycle, and its smallest node."""
    state = net.join(reached, "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("nxt"), F.col("src").alias("cut"))
    for _ in range(62):
        far = state.select(F.col("node").alias("_node"), F.col("nxt").alias("_nxt"), F.col("cut").alias("_cut"))
        out = state.join(far, F.col("nxt") == F.col("_node")).withColumn("moved", F.col("_cut") < F.col("cut"))
        state = kept(out.select("node", F.col("_nxt").alias("nxt"), F.least("cut", "_cut").alias("cut"), "moved"))
        if state.where("moved").isEmpty():
            break
    return state.join(net, F.col("node") == F.col("src")).select("node", "cut", "length")


def interval_labels(net: DataFrame, extra: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """``(node, root, start, last, steps, along, ring, around)`` of each node of ``net(src, dst)`` and of ``extra(node)``: what lies upstream of a node is
    exactly the nodes of its root whose ``start`` is between its ``start`` and ``last``.

    Starts number a root's nodes in preorder, siblings by id: a node's is the sum, along its way down, of one and the nodes above its
    smaller siblings. Both that sum and the numbers of nodes above come from pointer doubling, so rounds follow the logarithm of the
    depth and not how gages nest. ``steps`` and ``along`` are the links and the length (``lengths(link, length)``, 0 where unknown)
    down to the root. Each cycle is cut below its smallest node, which is its root; ``ring`` and ``around`` are a cycle's links and
    length for the nodes on it, each of which everything of its root reaches, and 0 elsewhere.
    """
    nodes = net.select(F.col("src").alias("node")).union(net.select("dst"))
    nodes = (nodes if extra is None else nodes.union(extra)).distinct()
    far = net.select("src", "dst", F.lit(0.0).alias("length"))
    if lengths is not None:
        own = lengths.groupBy("link").agg(F.max(F.col("length").cast("double")).alias("length"))
        far = net.join(own, F.col("src") == F.col("link"), "left").select("src", "dst", F.coalesce("length", F.lit(0.0)).alias("length"))
    far = kept(far)

    def forest(edges_: DataFrame) -> DataFrame:
        out = nodes.join(edges_, F.col("node") == F.col("src"), "left")
        step = F.when(F.col("dst").isNotNull(), 1).otherwise(0).cast("bigint").alias("steps")
        root = F.coalesce("dst", "node").alias("root")
        return kept(out.select("node", F.col("dst").alias("nxt"), root, F.lit(1).cast("bigint").alias("size"), step, F.coalesce("length", F.lit(0.0)).alias("along")))

    state, endless = _path_sums(forest(far), ("steps", "along"), far.count() + 1, sizes=True)
    rings = None
    if endless:
        on = _cycles(far, state.where("nxt is not null").select(F.col("nxt").alias("src")).distinct())
        rings = kept(on.groupBy("cut").agg(F.count("*").alias("ring"), F.sum("length").alias("around"), F.collect_list("node").alias("nodes")))
        far = kept(far.join(rings.select(F.col("cut").alias("src")), "src", "left_anti"))
        state, _ = _path_sums(forest(far), ("steps", "along"), far.count() + 1, sizes=True)
    sized = state.select("node", "root", "size", "steps", "along").join(far.select("src", "dst"), F.col("node") == F.col("src"), "left")
    before = F.sum("size").over(W.partitionBy("dst").orderBy("node")) - F.col("size")
    starts = sized.where("dst is not null").select("node", F.col("dst").alias("nxt"), F.col("dst").alias("root"), (before + 1).alias("start"))
    roots = sized.where("dst is null").select("node", F.col("dst").alias("nxt"), F.col("node").alias("root"), F.lit(0).cast("bigint").alias("start"))
    starts, _ = _path_sums(kept(starts.union(roots)), ("start",), far.count() + 1, sizes=False)
    out = state.select("node", "root", "size", "steps", "along").join(starts.select("node", "start"), "node")
    out = out.withColumn("last", F.col("start") + F.col("size") - 1)
    if rings is None:
        out = out.withColumns({"ring": F.lit(0).cast("bigint"), "around": F.lit(0.0)})
    else:
        out = out.join(rings.select(F.explode("nodes").alias("node"), "ring", "around"), "node", "left").na.fill({"ring": 0, "around": 0.0})
    return kept(out.select("node", "root", "start", "last", "steps", "along", "ring", "around"))


def _blocks(start, last):
    """The aligned blocks ``(level, index)`` of 2^level numbers that make up ``start`` to ``last``: two of each level at most."""
    begin = F.struct(start.alias("a"), (last + 1).alias("b"), F.array().cast("array<struct<level:int,index:bigint>>").alias("out"))

    def step(s, level):
        block = lambda i: F.array(F.struct(level.cast("int").alias("level"), i.alias("index")))
        none = F.array().cast("array<struct<level:int,index:bigint>>")
        left, right = (s["a"] < s["b"]) & (s["a"] % 2 == 1), (s["a"] < s["b"]) & (s["b"] % 2 == 1)
        out = F.concat(s["out"], F.when(left, block(s["a"])).otherwise(none), F.when(right, block(s["b"] - 1)).otherwise(none))
        half = lambda v: F.floor(v / 2).cast("bigint")
        return F.struct(half(F.when(left, s["a"] + 1).otherwise(s["a"])).alias("a"), half(F.when(right, s["b"] - 1).otherwise(s["b"])).alias("b"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(52)), begin, step, lambda s: s["out"])


def upstream_pairs(links: DataFrame, net: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """``(link, node, steps, along)``: every node upstream of each link of ``links(link)``, itself included, with the links and the length down to it.

    A link's upstream set is an interval of labels. It is taken apart into blocks of powers of two, and each node looks up its block of
    each size in use: an equi-join that makes the pairs of the result and no others, however links nest.
    """
    at = links.select(F.col("link").alias("node")).where(F.col("node").isNotNull()).distinct()
    labels = interval_labels(net, at, lengths)
    own = labels.select(F.col("node").alias("link"), F.col("root").alias("_root"), *[F.col(c).alias(f"_{c}") for c in ("start", "last", "steps", "along", "ring", "around")])
    own = own.join(at, F.col("link") == F.col("node"), "left_semi")
    whole = labels.where("node = root").select(F.col("node").alias("_top"), F.col("last").alias("_all"))
    own = own.join(whole, F.col("_root") == F.col("_top"))
    ring = F.col("_ring") > 0
    cover = _blocks(F.when(ring, F.lit(0).cast("bigint")).otherwise(F.col("_start")), F.when(ring, F.col("_all")).otherwise(F.col("_last")))
    own = kept(own.withColumn("_b", F.explode(cover)).drop("_top", "_all"))
    levels = sorted(r[0] for r in own.select("_b.level").distinct().collect())  # powers of two, 53 at most
    block = lambda n: F.struct(F.lit(n).alias("level"), F.shiftright("start", n).alias("index"))
    nodes = labels.select("node", "root", "start", "steps", "along", F.explode(F.array(*map(block, levels or [0]))).alias("_own"))
    pairs = nodes.join(own, (F.col("root") == F.col("_root")) & (F.col("_own") == F.col("_b")))
    # within a cycle the way to a node that lies above the cut goes once around
    turn = ~F.col("start").between(F.col("_start"), F.col("_last"))
    steps = F.col("steps") - F.col("_steps") + F.when(turn, F.col("_ring")).otherwise(0)
    along = F.col("along") - F.col("_along") + F.when(turn, F.col("_around")).otherwise(0.0)
    return pairs.select("link", "node", steps.alias("steps"), along.alias("along"))


def upstream_links(terminals: DataFrame, net: DataFrame, name: str | None = None) -> DataFrame:
    """``(gage, gage_name, terminal_link, upstream_link)`` for every link that drains to a terminal gage's, itself included."""
    label = F.coalesce(F.col(name).cast("string"), F.concat(F.lit("Gage "), F.col("id"))) if name else F.concat(F.lit("Gage "), F.col("id"))
    found = upstream_pairs(terminals, net).select(F.col("link").alias("_link"), "node")
    both = terminals.join(found, F.col("link") == F.col("_link"))
    return both.select(F.col("id").alias("gage"), label.alias("gage_name"), F.col("link").alias("terminal_link"), F.col("node").alias("upstream_link"))


def upstream_summary(terminals: DataFrame, gages: DataFrame, net: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """``(gage, n_links, n_gages, mean_steps, mean_distance)`` of each terminal gage: the links above it, itself included, the other gages there, and
    their mean number of links and mean length down to it (null without any)."""
    found = kept(upstream_pairs(terminals, net, lengths).withColumnRenamed("link", "_link"))
    links = terminals.join(found, F.col("link") == F.col("_link")).groupBy(F.col("id").alias("gage")).agg(F.count("*").alias("n_links"))
    others = gages.select(F.col("id").alias("other"), F.col("link").alias("_at"))
    own = terminals.select(F.col("id").alias("_gage"), F.col("link").alias("_own"))
    near = found.join(others, F.col("node") == F.col("_at")).join(own, (F.col("_link") == F.col("_own")) & (F.col("other") != F.col("_gage")))
    near = near.groupBy("_gage").agg(F.count("*").alias("n_gages"), F.avg("steps").alias("mean_steps"), F.avg("along").alias("mean_distance"))
    out = links.join(near, F.col("gage") == F.col("_gage"), "left")
    return out.select("gage", "n_links", F.coalesce("n_gages", F.lit(0)).alias("n_gages"), "mean_steps", "mean_distance")


def upstream_counts(upstream: DataFrame) -> DataFrame:
    """Links above each terminal gage, itself included."""
    return upstream.groupBy("gage").agg(F.count("*").alias("n_links"))
