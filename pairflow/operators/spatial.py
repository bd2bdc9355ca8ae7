"""Points, rings and lines as column expressions; candidates by cells whose width follows each geometry, never all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairflow.plans.tables import kept

# The WGS 84 ellipsoid.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * AXIS, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * AXIS


def to_utm(lon: Column, lat: Column, zone: int = 12) -> tuple[Column, Column]:
    """Easting and northing (northern half) by the series of the transverse Mercator projection to the third order of n."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(zone * 6 - 183)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * radius * east, 0.9996 * radius * north


def sides(ring: Column) -> Column:
    """Structs ``a, b`` of the ring's sides, closed."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, shifted, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies within a ring by ray casting; points on a side aren't within."""
    s = sides(ring)
    cross = lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y)
    at = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
    odd = F.size(F.filter(s, lambda e: F.when(cross(e), x < at(e)).otherwise(False))) % 2 == 1
    turn = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    within = lambda e: x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))
    return odd & ~F.exists(s, lambda e: (turn(e) == 0) & within(e))


def _cells(level: Column, lo_x: Column, hi_x: Column, lo_y: Column, hi_y: Column, cell: float) -> Column:
    """Structs ``level, cx, cy`` of the cells that a box meets at a level; widths double with each level."""
    width = cell * F.pow(F.lit(2.0), level)
    span = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    at = lambda cx, cy: F.struct(level.cast("int").alias("level"), cx.alias("cx"), cy.alias("cy"))
    return F.flatten(F.transform(span(lo_x, hi_x), lambda cx: F.transform(span(lo_y, hi_y), lambda cy: at(cx, cy))))


def _level(lo_x: Column, hi_x: Column, lo_y: Column, hi_y: Column, cell: float) -> Column:
    """The level of a box: its longer side is at most four cells wide, so it meets 25 cells at most, whatever its size."""
    return F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(F.greatest(hi_x - lo_x, hi_y - lo_y) / cell)) - 2, F.lit(0))).cast("int")


def _own_cells(box: tuple[Column, Column, Column, Column], cell: float) -> Column:
    return _cells(_level(*box, cell), *box, cell)


def _path_cells(x1: Column, y1: Column, x2: Column, y2: Column, cell: float) -> Column:
    """Structs ``level, cx, cy`` of the cells that a straight piece runs through, at a level where its longer side is at most 64 cells wide:
    130 cells or so at most. Column by column, with the heights that the piece has there and a millionth of a cell about them."""
    side = F.greatest(F.abs(x2 - x1), F.abs(y2 - y1))
    level = F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(side / cell)) - 6, F.lit(0))).cast("int")
    width = cell * F.pow(F.lit(2.0), level)
    swap = x1 > x2
    xa, ya, xb, yb = F.when(swap, x2).otherwise(x1), F.when(swap, y2).otherwise(y1), F.when(swap, x1).otherwise(x2), F.when(swap, y1).otherwise(y2)
    rise = F.try_divide(yb - ya, xb - xa)
    at = lambda x, end: F.when(rise.isNull(), end).otherwise(F.greatest(F.least(ya + (x - xa) * rise, F.greatest(ya, yb)), F.least(ya, yb)))

    def column(cx: Column) -> Column:
        from_, to = at(F.greatest(xa, cx * width), ya), at(F.least(xb, (cx + 1) * width), yb)
        rows = F.sequence(F.floor(F.least(from_, to) / width - 1e-6), F.floor(F.greatest(from_, to) / width + 1e-6))
        return F.transform(rows, lambda cy: F.struct(level.alias("level"), cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(F.floor(xa / width - 1e-6), F.floor(xb / width + 1e-6)), column))


def _levels(df: DataFrame, cells: str) -> list[int]:
    """The levels in use: one for each doubling of size, some dozens at most."""
    return sorted(r[0] for r in df.select(F.explode(cells).alias("c")).select("c.level").distinct().collect()) or [0]


def _point_cells(x: Column, y: Column, levels: list[int], cell: float) -> Column:
    """A point's cell at each level."""
    at = lambda v, n: F.floor(v / (cell * 2.0**n))
    return F.array(*[F.struct(F.lit(n).alias("level"), at(x, n).alias("cx"), at(y, n).alias("cy")) for n in levels])


def _with_coarser(cells: Column, levels: list[int]) -> Column:
    """Structs ``c, own``: a geometry's cells at its own level, and those that hold them at each coarser level in use, once each.

    Two geometries that meet share a cell at the coarser of their levels, where one of them is at its own.
    """
    half = lambda v, by: F.floor(v / F.pow(F.lit(2.0), by))

    def lifted(n: int):
        return lambda c: F.struct(F.lit(n).alias("level"), half(c["cx"], n - c["level"]).alias("cx"), half(c["cy"], n - c["level"]).alias("cy"))

    told = lambda own: lambda c: F.struct(c.alias("c"), F.lit(own).alias("own"))
    finer = lambda n: F.filter(cells, lambda c: c["level"] < n)
    up = [F.transform(F.array_distinct(F.transform(finer(n), lifted(n))), told(False)) for n in levels]
    return F.concat(F.transform(cells, told(True)), *up)


def _box(vertices: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    return F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, ring: str = "ring") -> DataFrame:
    """Join of points ``(x, y)`` with the polygons they lie within.

    Candidates share a cell. Each polygon is covered by at most 25 cells of a width that follows its box (``cell`` is the least
    width), and a point looks at its one cell of each width in use, so neither large nor small polygons multiply.
    """
    boxed = polygons.withColumn("_own", _own_cells(_box(F.col(ring)), cell))
    levels = _levels(boxed, "_own")
    keyed = points.withColumn("_p", F.explode(_point_cells(F.col("x"), F.col("y"), levels, cell)))
    boxed = boxed.withColumn("_c", F.explode("_own")).drop("_own")
    return keyed.join(boxed, (F.col("_p") == F.col("_c")) & inside(F.col("x"), F.col("y"), F.col(ring))).drop("_p", "_c", ring)


def within_any(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Points within the union of polygons."""
    spots = points_in_polygons(points.select("x", "y").distinct(), polygons.select("ring"), cell).distinct()
    return points.join(spots.select(F.col("x").alias("_x"), F.col("y").alias("_y")), (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left_semi")


def segments(lines: DataFrame, line_id: str = "line_id", vertices: str = "line") -> DataFrame:
    """``(line_id, x1, y1, x2, y2)`` of each straight piece."""
    v = F.col(vertices)
    pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return lines.where(F.size(v) > 1).select(line_id, F.inline(pairs))


def segment_distance(x: Column, y: Column) -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = x - (F.col("x1") + t * dx), y - (F.col("y1") + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _gap(x: Column, y: Column, c: Column, cell: float) -> Column:
    """The distance from a point to a cell, 0 within it."""
    width = cell * F.pow(F.lit(2.0), c["level"])
    off = lambda v, i: F.greatest(i * width - v, v - (i + 1) * width, F.lit(0.0))
    return F.sqrt(F.pow(off(x, c["cx"]), 2.0) + F.pow(off(y, c["cy"]), 2.0))


def nearest_line(points: DataFrame, lines: DataFrame, cell: float, point_id: str = "point_id", line_id: str = "line_id", vertices: str = "line") -> DataFrame:
    """``(point_id, line_id, distance)``: the nearest line of each point, of equal ones the smallest id.

    A few joins, whatever the distances. Pieces of lines are keyed by the cells that they run through, of ``cell``'s width or of one that
    about suits four points a cell, whichever is less (wider ones for long pieces), and each cell of any width names one
    of its pieces. A point measures the pieces named by its cell and the three nearest cells of every width; the least distance
    bounds the true one by a small factor. Then it meets all pieces in the cells within that bound, at a width as large as the bound: at most nine
    cells, and the few of wider pieces. Only the least distance is kept on the way, a number that needs no sorting of pairs; the line is looked up in the
    cells within that distance. Without any line no point has a row; points without coordinates have none.
    """
    pieces = segments(lines, line_id, vertices)
    spots = points.select(point_id, "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    low = lambda a, b: F.min(F.least(a, b))
    high = lambda a, b: F.max(F.greatest(a, b))
    lo_x, lo_y, hi_x, hi_y = pieces.agg(low("x1", "x2"), low("y1", "y2"), high("x1", "x2"), high("y1", "y2")).first()
    p_lo_x, p_lo_y, p_hi_x, p_hi_y, n_spots = spots.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).first()
    if lo_x is None or p_lo_x is None:
        return spots.join(pieces.select(line_id), F.lit(False)).select(point_id, line_id, F.col("x").alias("distance"))
    lo_x, lo_y = min(lo_x, p_lo_x), min(lo_y, p_lo_y)
    span = max(hi_x - lo_x, hi_y - lo_y, p_hi_x - lo_x, p_hi_y - lo_y)
    if span > 0:
        cell /= 2.0 ** max(0, math.ceil(math.log2(cell * math.sqrt(n_spots) / (2 * span))))
    top = max(0, math.ceil(math.log2(max(span / cell, 1)))) + 1  # everything in one cell

    # cells count from the lower left corner of all, so that those of the top level coincide
    sx = {c: F.col(c) - (lo_x if c[0] == "x" else lo_y) for c in ("x1", "x2", "y1", "y2", "x", "y")}
    keyed = kept(pieces.withColumn("_own", _path_cells(sx["x1"], sx["y1"], sx["x2"], sx["y2"], cell)))
    own_levels = _levels(keyed, "_own")
    named = F.min(F.struct(F.col(line_id).alias("i"), "x1", "y1", "x2", "y2"))
    ends = ("x1", "y1", "x2", "y2")
    first = keyed.select(line_id, *ends, F.explode("_own").alias("_c")).groupBy("_c").agg(named.alias("l"))
    first = first.select(F.col("l.i").alias(line_id), *[F.col(f"l.{c}") for c in ends], F.explode(_with_coarser(F.array("_c"), list(range(top + 1)))["c"]).alias("_c"))
    first = first.groupBy("_c").agg(named.alias("l")).select("_c", "l.x1", "l.y1", "l.x2", "l.y2")

    x, y = F.col("x"), F.col("y")
    near = []
    for n in range(own_levels[0], top + 1):
        width = cell * 2.0**n
        cx, cy = F.floor(sx["x"] / width), F.floor(sx["y"] / width)
        side = lambda v, i, w=width: F.when(v / w - i < 0.5, i - 1).otherwise(i + 1)
        near += [F.struct(F.lit(n).alias("level"), a.alias("cx"), b.alias("cy")) for a in (cx, side(sx["x"], cx)) for b in (cy, side(sx["y"], cy))]
    bound = spots.withColumn("_p", F.explode(F.array(*near))).join(first, F.col("_p") == F.col("_c"))
    bound = kept(bound.groupBy(point_id, "x", "y").agg(F.min(segment_distance(x, y)).alias("r")))

    searched = [n for n in range(top + 1)]  # a level for each doubling of distance
    told = lambda any_: lambda c: F.struct(c.alias("c"), F.lit(any_).alias("any"))
    there = keyed.withColumn("_c", F.explode(_with_coarser(F.col("_own"), searched))).drop("_own")

    def met(within: DataFrame) -> DataFrame:
        """Points of ``within`` with each piece in the cells that lie within ``r`` of them."""
        r = F.col("r") * (1 + 1e-9) + 1e-9 * cell
        level = F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(F.col("r") / cell)), F.lit(0))).cast("int")
        within = within.withColumn("_at", F.least(level, F.lit(top)))
        around = lambda n: F.filter(_cells(n, sx["x"] - r, sx["x"] + r, sx["y"] - r, sx["y"] + r, cell), lambda c: _gap(sx["x"], sx["y"], c, cell) <= r)
        own = [F.when(F.lit(n) > F.col("_at"), around(F.lit(n))) for n in own_levels]
        asked = [F.transform(F.coalesce(c, F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>")), told(False)) for c in own]
        asked = within.withColumn("_p", F.explode(F.concat(F.transform(around(F.col("_at")), told(True)), *asked)))
        return asked.join(there, (F.col("_p.c") == F.col("_c.c")) & (F.col("_p.any") | F.col("_c.own")))

    least = kept(met(bound).groupBy(point_id, "x", "y").agg(F.min(segment_distance(x, y)).alias("r")))
    best = met(least).where(segment_distance(x, y) <= F.col("r")).groupBy(point_id, F.col("r").alias("distance")).agg(F.min(line_id).alias(line_id))
    return best.select(point_id, line_id, "distance")


def containing_or_nearest(points: DataFrame, polygons: DataFrame, cell: float, point_id: str = "point_id", polygon_id: str = "polygon_id") -> DataFrame:
    """``(point_id, polygon_id, distance)``: the polygon that each point lies within (distance 0; of several the smallest id), else the one whose
    ring is nearest. Points without any polygon in reach stay out."""
    inside_ = points_in_polygons(points, polygons.select(polygon_id, "ring"), cell)
    held = kept(inside_.groupBy(point_id).agg(F.min(polygon_id).alias(polygon_id)).withColumn("distance", F.lit(0.0)))
    closed = polygons.select(polygon_id, F.concat("ring", F.slice("ring", 1, 1)).alias("line"))
    rest = points.join(held.select(point_id), point_id, "left_anti")
    return held.unionByName(nearest_line(rest, closed, cell, point_id, polygon_id))


def centroids(lines: DataFrame, line_id: str = "line_id", vertices: str = "line") -> DataFrame:
    """Length-weighted centroid of each line; a line without length has the mean of its points."""
    s = segments(lines, line_id, vertices)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    s = s.withColumns({"w": F.sqrt(dx * dx + dy * dy), "mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})
    mid = lambda c: F.coalesce(F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum("w")), F.avg(c))
    return s.groupBy(line_id).agg(mid("mx").alias("x"), mid("my").alias("y"))


def lines_meeting_polygons(lines: DataFrame, polygons: DataFrame, cell: float, line_id: str = "line_id", polygon_id: str = "polygon_id") -> DataFrame:
    """``(line_id, polygon_id)`` of lines that share a point with a polygon: a vertex within, or a piece that crosses a side."""
    pieces = segments(lines, line_id)
    box = (F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2"))
    pieces = pieces.withColumn("_own", _own_cells(box, cell))
    rings = polygons.select(polygon_id, "ring").withColumn("_own", _own_cells(_box(F.col("ring")), cell))
    levels = sorted({*_levels(pieces, "_own"), *_levels(rings, "_own")})
    pieces = pieces.withColumn("_c", F.explode(_with_coarser(F.col("_own"), levels))).drop("_own")
    rings = rings.withColumn("_d", F.explode(_with_coarser(F.col("_own"), levels))).drop("_own")
    turn = lambda ax, ay, bx, by, cx, cy: F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    p = [F.col(c) for c in ("x1", "y1", "x2", "y2")]

    def crosses(e: Column) -> Column:
        q = (e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])
        apart = (turn(*p, q[0], q[1]) * turn(*p, q[2], q[3]) <= 0) & (turn(*q, p[0], p[1]) * turn(*q, p[2], p[3]) <= 0)
        boxes = (F.greatest(p[0], p[2]) >= F.least(q[0], q[2])) & (F.greatest(q[0], q[2]) >= F.least(p[0], p[2])) & (F.greatest(p[1], p[3]) >= F.least(q[1], q[3])) & (F.greatest(q[1], q[3]) >= F.least(p[1], p[3]))
        return apart & boxes

    meets = inside(p[0], p[1], F.col("ring")) | F.exists(sides(F.col("ring")), crosses)
    same = (F.col("_c.c") == F.col("_d.c")) & (F.col("_c.own") | F.col("_d.own"))
    return pieces.join(rings, same & meets).select(line_id, polygon_id).distinct()


def gradient(df: DataFrame, wte: str = "wte", reach: str = "reach_elevation", distance: str = "distance") -> DataFrame:
    """Head over the reach, its gradient over the distance (null at distance 0), and what the stream does."""
    head = F.col(wte) - F.col(reach)
    told = F.when(head > 0, "gaining").when(head < 0, "losing").otherwise("neutral")
    return df.withColumns({"head": head, "gradient": F.when(F.col(distance) > 0, head / F.col(distance)), "direction": told})


def direction_counts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each direction of :func:`gradient` and their share in percent, per ``by`` or over all."""
    out = df.groupBy(*by, "direction").agg(F.count("*").alias("n"))
    total = df.groupBy(*by).agg(F.count("*").alias("_all"))
    out = out.join(total, list(by)) if by else out.join(F.broadcast(total))  # one row
    return out.select(*by, "direction", "n", (100.0 * F.col("n") / F.col("_all")).alias("pct"))
