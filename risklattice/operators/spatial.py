"""Point, polygon and distance joins on a grid of cells.

Polygons are (code, rings) with rings as array of rings of [x, y] points; a hole is one more ring.
Every join is an equi-join on a grid cell. Polygons are turned once into a table of the cells they cover, and points and
neighbours look cells up. Polygons and cells come from the closed area dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklattice.operators.ranking import top_k
from risklattice.session import cut_lineage, scratch_path

SNAP_TOLERANCE = 0.025
ADJACENCY_TOLERANCE = 0.002


def segments(polygons: DataFrame, code: str = "code", rings: str = "rings") -> DataFrame:
    """One row per boundary segment (code, x1, y1, x2, y2); open rings are closed."""
    ring = polygons.select(code, F.explode(rings).alias("r")).filter(F.size("r") > 1)
    n = F.size("r")
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get(F.get("r", i), F.lit(0)).alias("x1"), F.get(F.get("r", i), F.lit(1)).alias("y1"),
        F.get(F.get("r", (i + 1) % n), F.lit(0)).alias("x2"), F.get(F.get("r", (i + 1) % n), F.lit(1)).alias("y2"),
    ))
    out = ring.select(code, F.explode(ends).alias("s")).select(code, "s.*")
    return out.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def crossed_cells(segs: DataFrame, cell: float, halo: float) -> DataFrame:
    """One row per segment and grid cell (cx, cy) that lies at most ``halo`` from it.

    The segment is traced column by column: a column takes only the rows that the piece of the segment inside it reaches, so a
    long slanted segment is filed along its line and not over its whole box.
    """
    size, reach = F.lit(float(cell)), F.lit(halo + 1e-9 * cell)  # the last part covers rounding of the traced ends
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    column = segs.select("*", F.explode(F.sequence(F.floor((left - reach) / size), F.floor((right + reach) / size))).alias("cx"))

    def height(x: Column) -> Column:
        at = F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
        return F.greatest(low, F.least(high, at))

    begin = height(F.greatest(left, F.least(right, F.col("cx") * size - reach)))
    end = height(F.greatest(left, F.least(right, (F.col("cx") + 1) * size + reach)))
    flat = F.col("x1") == F.col("x2")
    lowest = F.when(flat, low).otherwise(F.least(begin, end)) - reach
    highest = F.when(flat, high).otherwise(F.greatest(begin, end)) + reach
    return column.select("*", F.explode(F.sequence(F.floor(lowest / size), F.floor(highest / size))).alias("cy"))


def _side(x: Column, y: Column, s: Column | None = None) -> Column:
    """Positive where (x, y) lies left of an upward segment. One expression decides all crossings at a point, so they agree."""
    x1, y1, x2, y2 = [F.col(c) if s is None else s[c] for c in ("x1", "y1", "x2", "y2")]
    return (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)


def cell_cover(polygons: DataFrame, cell: float, halo: float, code: str = "code") -> DataFrame:
    """The cells of each polygon: (cx, cy, code, odd, segs), written once to the shared folder.

    ``segs`` are the boundary segments at most ``halo`` from the cell, null where there are none; ``odd`` tells whether the cell's
    lower left corner is inside, by the parity of crossings of a ray to the right, which for a cell without segments holds for
    the whole cell. Cells outside a polygon and off its boundary have no row. A corner counts as lying a hair right of and above
    itself, so corners on vertices and edges need no special case. The work follows outlines and covered cells, whatever the number of points.
    """
    segs, size = segments(polygons, code), F.lit(float(cell))
    # Columns up to which a segment's crossing with the line under a row lies right of the corners.
    lined = segs.filter("y1 <> y2").select("*", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.ceil(F.greatest("y1", "y2") / size))).alias("cy"))
    lined = lined.withColumn("_y", F.col("cy") * size).filter((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y")))
    guess = F.floor((F.col("x1") + (F.col("_y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))) / size)

    def right_of(k: Column) -> Column:
        return _side(k * size, F.col("_y")) * F.signum(F.col("y2") - F.col("y1")) > 0

    lined = lined.withColumn("_k", guess)
    last = F.when(right_of(F.col("_k") + 1), F.col("_k") + 1).when(right_of(F.col("_k")), F.col("_k")).otherwise(F.col("_k") - 1)
    rows = lined.select(code, "cy", last.alias("_k")).groupBy(code, "cy").agg(F.sort_array(F.collect_list("_k")).alias("_ks"))
    spans = rows.select(code, "cy", F.explode(F.transform(F.sequence(F.lit(0), F.size("_ks") - 2, F.lit(2)), lambda i: F.struct((F.get("_ks", i) + 1).alias("a"), F.get("_ks", i + 1).alias("b")))).alias("_s"))
    inner = spans.filter("_s.a <= _s.b").select("cy", code, F.explode(F.sequence("_s.a", "_s.b")).alias("cx"), F.lit(True).alias("odd"))
    # ``left``: the segment meets the cell's left edge above the corner; higher there, or through the corner and rising to the right.
    x0, y0 = F.col("cx") * size, F.col("cy") * size
    rise, run = F.signum(F.col("y2") - F.col("y1")), F.signum(F.col("x2") - F.col("x1"))
    left = ((F.col("x1") > x0) != (F.col("x2") > x0)) & ((-_side(x0, y0) * run > 0) | ((_side(x0, y0) == 0) & (rise * run > 0)))
    edge = crossed_cells(segs, cell, halo).select("cx", "cy", code, F.struct("x1", "y1", "x2", "y2", rise.alias("rise"), run.alias("run"), left.alias("left")).alias("seg"))
    both = inner.withColumn("seg", F.lit(None).cast(edge.schema["seg"].dataType)).unionByName(edge.withColumn("odd", F.lit(False)))
    cover = both.groupBy("cx", "cy", code).agg(F.max("odd").alias("odd"), F.collect_list("seg").alias("segs"))
    path = scratch_path(polygons.sparkSession, "cover")
    cover.withColumn("segs", F.when(F.size("segs") > 0, F.col("segs"))).write.parquet(path)
    return polygons.sparkSession.read.parquet(path)


def _inside(px: Column, py: Column, x0: Column, odd: Column, segs: Column) -> Column:
    """Parity at a point of a cell: that of the corner, changed by segments on the way up the cell's left edge and then right to the point."""

    def changes(s: Column) -> Column:
        at_bend = _side(x0, py, s)
        above_bend = (-at_bend * s["run"] > 0) | ((at_bend == 0) & (s["rise"] * s["run"] > 0))
        across = ((s["y1"] > py) != (s["y2"] > py)) & (at_bend * s["rise"] > 0) & ~(_side(px, py, s) * s["rise"] > 0)
        return F.when(s["left"] & ~above_bend, 1).otherwise(0) + across.cast("int")

    crossings = F.aggregate(segs, F.lit(0), lambda n, s: n + changes(s))
    return F.coalesce((crossings % 2 == 1) != odd, odd)


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    along = F.when(length > 0, ((px - x1) * dx + (py - y1) * dy) / length).otherwise(F.lit(0.0))
    along = F.greatest(F.least(along, F.lit(1.0)), F.lit(0.0))
    ex, ey = px - (x1 + along * dx), py - (y1 + along * dy)
    # Rounding in the foot point must not lift a boundary point off the boundary.
    on_line = (px - x1) * dy == (py - y1) * dx
    on_segment = on_line & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
    return F.when(on_segment, F.lit(0.0)).otherwise(F.sqrt(ex * ex + ey * ey))


def locate(points: DataFrame, polygons: DataFrame, cell: float, tolerance: float = SNAP_TOLERANCE, x: str = "x", y: str = "y", code: str = "code") -> DataFrame:
    """Add ``code`` and ``how`` (inside, snapped, outside) to points.

    Inside is strict, so a boundary point is not inside; it then snaps at distance 0. A point that is in
    no polygon takes the nearest boundary within the tolerance, ties to the smaller code. Points without a finite place are outside.

    A point looks up its cell of the cover, in one join that keeps the points where they are if the cover is small (Spark checks
    the written table's size) and splits hot cells otherwise. Cells inside a polygon answer at once; only boundary cells carry
    segments, their own.
    """
    size = F.lit(float(cell))
    cells = cell_cover(polygons, cell, tolerance, code).groupBy(F.col("cx").alias("_cx"), F.col("cy").alias("_cy")).agg(F.collect_list(F.struct(code, "odd", "segs")).alias("_near"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    finite = F.coalesce((F.abs(px) < float("inf")) & (F.abs(py) < float("inf")), F.lit(False))  # not a number is above infinity here
    placed = points.withColumns({"_cx": F.when(finite, F.floor(px / size)), "_cy": F.when(finite, F.floor(py / size))})

    def option(e: Column) -> Column:
        gap = F.array_min(F.transform(e["segs"], lambda s: point_segment_distance(px, py, s["x1"], s["y1"], s["x2"], s["y2"])))
        return F.struct(_inside(px, py, F.col("_cx") * size, e["odd"], e["segs"]).alias("inside"), gap.alias("gap"), e[code].alias("code"))

    def rank(o: Column) -> Column:
        near = F.struct(F.lit(1).alias("tier"), o["gap"].alias("gap"), o["code"].alias("code"))
        contained = o["inside"] & F.coalesce(o["gap"] > 0, F.lit(True))
        return F.when(contained, F.struct(F.lit(0).alias("tier"), F.lit(0.0).alias("gap"), o["code"].alias("code"))).when(o["gap"] <= float(tolerance), near)

    best = F.array_min(F.array_compact(F.transform(F.transform("_near", option), rank)))
    found = placed.join(cells, ["_cx", "_cy"], "left").withColumn("_best", best)
    how = F.when(F.col("_best.tier") == 0, "inside").when(F.col("_best.tier") == 1, "snapped").otherwise("outside")
    return found.select(*points.columns, F.col("_best.code").alias(code), how.alias("how"))


def _within_reach(px: Column, py: Column, s: list[Column], reach: float) -> Column:
    """Whether a point is at most ``reach`` from a segment of some length; a point on it is, whatever the rounding."""
    x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    along = F.greatest(F.least(((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy), F.lit(1.0)), F.lit(0.0))
    ex, ey = px - (x1 + along * dx), py - (y1 + along * dy)
    on_it = ((px - x1) * dy == (py - y1) * dx) & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
    return (ex * ex + ey * ey <= reach * reach) | on_it


def _segments_cross(a: list[Column], b: list[Column]) -> Column:
    ax, ay, bx, by = a
    cx, cy, dx, dy = b

    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)


def adjacency(polygons: DataFrame, cell: float, tolerance: float = ADJACENCY_TOLERANCE, code: str = "code") -> DataFrame:
    """Pairs (a < b) of polygons at most ``tolerance`` apart.

    Polygons meet only inside a shared cell of their cover, where the box of each one's segments is compared first; segments
    are spread out only for pairs whose boxes are in reach. A polygon of which a part lies within another is found by looking up
    one vertex of each of its rings in the cover.
    """
    size, reach = F.lit(float(cell)), F.lit(float(tolerance))
    cover = cell_cover(polygons, cell, tolerance / 2, code)
    edges = cover.filter("segs is not null")
    box = {
        "w": F.array_min(F.transform("segs", lambda s: F.least(s["x1"], s["x2"]))), "e": F.array_max(F.transform("segs", lambda s: F.greatest(s["x1"], s["x2"]))),
        "s": F.array_min(F.transform("segs", lambda s: F.least(s["y1"], s["y2"]))), "n": F.array_max(F.transform("segs", lambda s: F.greatest(s["y1"], s["y2"]))),
    }
    left, right = [edges.select("cx", "cy", F.col(code).alias(p), F.col("segs").alias(f"{p}_segs"), *[v.alias(f"{p}_{k}") for k, v in box.items()]) for p in "ab"]
    in_reach = (F.col("a_w") - reach <= F.col("b_e")) & (F.col("b_w") - reach <= F.col("a_e")) & (F.col("a_s") - reach <= F.col("b_n")) & (F.col("b_s") - reach <= F.col("a_n"))
    pairs = left.join(right, ["cx", "cy"]).filter((F.col("a") < F.col("b")) & in_reach)
    pairs = pairs.select("a", "b", F.explode("a_segs").alias("s"), "b_segs").select("a", "b", "s", F.explode("b_segs").alias("t"))
    s, t = [[F.col(f"{v}.{c}") for c in ("x1", "y1", "x2", "y2")] for v in "st"]
    boxes = [F.least(s[i], s[i + 2]) - reach <= F.greatest(t[i], t[i + 2]) for i in (0, 1)] + [F.least(t[i], t[i + 2]) - reach <= F.greatest(s[i], s[i + 2]) for i in (0, 1)]
    close = _within_reach(s[0], s[1], t, tolerance) | _within_reach(s[2], s[3], t, tolerance) | _within_reach(t[0], t[1], s, tolerance) | _within_reach(t[2], t[3], s, tolerance) | _segments_cross(s, t)
    # An aggregate works out parts that the tests share once; as a filter each test would work out its own.
    touching = pairs.filter(boxes[0] & boxes[1] & boxes[2] & boxes[3]).groupBy("a", "b").agg(F.bool_or(close).alias("close")).filter("close").select("a", "b")
    ring = polygons.select(F.col(code).alias("owner"), F.explode("rings").alias("_r")).filter(F.size("_r") > 0)
    vertex = ring.select("owner", F.get(F.get("_r", F.lit(0)), F.lit(0)).alias("px"), F.get(F.get("_r", F.lit(0)), F.lit(1)).alias("py"))
    vertex = vertex.withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
    inside = _inside(F.col("px"), F.col("py"), F.col("cx") * size, F.col("odd"), F.col("segs"))
    within = vertex.join(cover, ["cx", "cy"]).filter((F.col("owner") != F.col(code)) & inside)
    return touching.union(within.select(F.least("owner", code), F.greatest("owner", code))).distinct()


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2.0))
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def nearest_target(centroids: DataFrame, targets: DataFrame, cell: float, area: str = "area", x: str = "x", y: str = "y") -> DataFrame:
    """Nearest target centroid in km for each area (itself excluded, ties to the lowest target), exact anywhere on the globe, by widening grid rings.

    Places become points of the unit sphere, where the straight distance grows with the distance along the ground and neither
    poles nor the date line are borders. Areas of one place look once, for the two nearest targets, of which at most one is the area
    itself; of the targets of one place the two lowest count. Each round files the targets on a 3-D grid twice as coarse (``cell``
    degrees at first, less where that would hold more than about one target place a cell) and lets open places look at the 27 cells
    around. Anything further off is at least one cell away, so a second-best distance below that is final.
    Rounds are written to the shared folder, since each one narrows the next.
    """
    import math

    def sphere(df: DataFrame, prefix: str) -> DataFrame:
        lon, lat = F.radians(F.col(f"{prefix}x")), F.radians(F.col(f"{prefix}y"))
        return df.withColumns({f"{prefix}1": F.cos(lat) * F.cos(lon), f"{prefix}2": F.cos(lat) * F.sin(lon), f"{prefix}3": F.sin(lat)})

    own = centroids.select(F.col(area).alias("_area"), F.col(x).alias("ax"), F.col(y).alias("ay"))
    left = cut_lineage(sphere(own.select("ax", "ay").distinct(), "a"))
    goal = targets.select(F.col(area).alias("target"), F.col(x).alias("tx"), F.col(y).alias("ty")).distinct()
    goal = cut_lineage(sphere(top_k(goal, ["tx", "ty"], [F.col("target")], 2), "t").drop("rank"))
    spots = max(1, goal.select("tx", "ty").distinct().count())
    steps = [F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias(f"s{k}") for k in (1, 2, 3)]
    size, found = min(math.radians(cell), math.sqrt(4 * math.pi / spots)), None
    while True:
        last = size >= 2
        spread = left.select("*", steps[0]).select("*", steps[1]).select("*", steps[2])
        spread = spread.select("ax", "ay", "a1", "a2", "a3", *[(F.floor(F.col(f"a{k}") / size) + F.col(f"s{k}")).alias(f"c{k}") for k in (1, 2, 3)])
        filed = goal.select("*", *[F.floor(F.col(f"t{k}") / size).alias(f"c{k}") for k in (1, 2, 3)])
        km = haversine_km(F.col("ax"), F.col("ay"), F.col("tx"), F.col("ty"))
        chord = F.sqrt(sum((F.col(f"a{k}") - F.col(f"t{k}")) * (F.col(f"a{k}") - F.col(f"t{k}")) for k in (1, 2, 3)))
        near = spread.join(filed, ["c1", "c2", "c3"]).groupBy("ax", "ay", "target").agg(F.min(F.struct(km.alias("km"), chord.alias("chord"))).alias("b")).select("ax", "ay", "target", "b.*")
        two = top_k(near, ["ax", "ay"], [F.col("km"), F.col("target")], 2)
        best = two.groupBy("ax", "ay").agg(F.sort_array(F.collect_list(F.struct("km", "target"))).alias("near"), F.max("chord").alias("far"))
        if not last:
            best = best.filter((F.size("near") == 2) & (F.col("far") <= size * (1 - 1e-9)))
        best = cut_lineage(best.drop("far"))
        found = best if found is None else found.unionByName(best)
        left = cut_lineage(left.join(best.select("ax", "ay"), ["ax", "ay"], "left_anti"))
        if last or left.isEmpty():
            break
        size *= 2
    other = own.join(found, ["ax", "ay"]).select("_area", F.get(F.filter("near", lambda n: n["target"] != F.col("_area")), F.lit(0)).alias("b")).filter("b is not null")
    return other.groupBy(F.col("_area").alias(area)).agg(F.min("b").alias("b")).select(area, "b.km", "b.target")
