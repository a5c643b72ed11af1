"""Polygons as vertex and edge tables.

A vertex table has (key, part, ring, seq, x, y): ring 0 of a part is its outer one, further rings are holes. A table
without part or ring columns holds one ring a key. An edge table adds the next vertex and unit, a hash of key and part: a point
is inside a polygon if it is inside a unit, and inside a unit if a ray crosses an odd number of its edges. The
exclusive or of the units of all crossed edges tells this in one aggregate: it is zero only if every unit was crossed an
even number of times. So holes are left out, parts may overlap, and edges of one polygon need not meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_RADIUS_KM
from .state import materialised

RING = ("part", "ring")


def edges(vertices: DataFrame, key: str, *, seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """(key, part, ring, seq, x1, y1, x2, y2, unit): each vertex with the next of its ring, the last with the first."""
    v = vertices.withColumns({c: F.lit(0) for c in RING if c not in vertices.columns})
    ring = Window.partitionBy(key, *RING).orderBy(seq)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    e = v.select(key, *RING, F.col(seq).alias("seq"), F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"), after(x).cast("double").alias("x2"), after(y).cast("double").alias("y2"))
    return e.withColumn("unit", F.xxhash64(key, "part"))


def crosses(px: Column, py: Column, edge: Callable[[str], Column] = F.col) -> Column:
    """Whether a ray to the right of the point crosses the row's edge; edges are half open in y. edge gives its coordinates by name."""
    x1, y1, x2, y2 = map(edge, ("x1", "y1", "x2", "y2"))
    return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)


def on_edge(px: Column, py: Column, edge: Callable[[str], Column] = F.col) -> Column:
    x1, y1, x2, y2 = map(edge, ("x1", "y1", "x2", "y2"))
    return ((x2 - x1) * (py - y1) == (y2 - y1) * (px - x1)) & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))


def in_a_unit(crossed: Column) -> Column:
    """Aggregate over a polygon's edges: inside one of its units."""
    return F.bit_xor(F.when(crossed, F.col("unit")).otherwise(F.lit(0).cast("long"))) != 0


# --- pairs of edges through a grid -----------------------------------------------------------


def edge_cells(e: DataFrame, by: Sequence[str]) -> DataFrame:
    """e with the cell (_r, _c) of each box of a grid that an edge passes; a grid for each by group, its boxes as wide and high as the edges are on average.

    An edge is cut at the grid's rows and takes the columns of each cut, so it meets the boxes along it. On average
    these are about three, whatever the edges' lengths.
    """
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    box = e.groupBy(*by).agg(F.min("x1").alias("_x"), F.greatest(F.avg(dx), (F.max("x1") - F.min("x1")) / F.count("*"), F.lit(1e-9)).alias("_w"), F.min("y1").alias("_y"), F.greatest(F.avg(dy), (F.max("y1") - F.min("y1")) / F.count("*"), F.lit(1e-9)).alias("_h"))
    named = box.select(*[F.col(b).alias(f"_by_{b}") for b in by], "_x", "_y", "_w", "_h")
    j = e.join(named, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]).drop(*[f"_by_{b}" for b in by])
    row = lambda y: F.floor((y - F.col("_y")) / F.col("_h"))
    column = lambda x: F.floor((x - F.col("_x")) / F.col("_w"))
    slack_x, slack_y = F.col("_w") * 1e-6, F.col("_h") * 1e-6
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    j = j.withColumn("_r", F.explode(F.sequence(row(low - slack_y), row(high + slack_y))))
    floor_y = F.col("_y") + F.col("_r") * F.col("_h")
    at = lambda y: F.when(F.col("y1") != F.col("y2"), F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    a = F.coalesce(at(F.greatest(low, floor_y - slack_y)), F.col("x1"))
    b = F.coalesce(at(F.least(high, floor_y + F.col("_h") + slack_y)), F.col("x2"))
    j = j.withColumn("_c", F.explode(F.sequence(column(F.least(a, b) - slack_x), column(F.greatest(a, b) + slack_x))))
    return j.drop("_x", "_y", "_w", "_h")


def edge_pairs(e: DataFrame, by: Sequence[str], label: Sequence[str]) -> DataFrame:
    """Pairs of edges of a by group that share a box: the columns of the second with the prefix o_; each pair of labels once, or once for several boxes."""
    cells = edge_cells(e, by)
    keep = [*label, "x1", "y1", "x2", "y2", "unit"]
    other = cells.select(*[F.col(b).alias(f"o_by_{b}") for b in by], F.col("_r").alias("o_r"), F.col("_c").alias("o_c"), *[F.col(c).alias(f"o_{c}") for c in keep])
    mine, theirs = F.struct(*[F.col(c) for c in label]), F.struct(*[F.col(f"o_{c}").alias(c) for c in label])
    on = [*[F.col(b).eqNullSafe(F.col(f"o_by_{b}")) for b in by], F.col("_r") == F.col("o_r"), F.col("_c") == F.col("o_c"), mine < theirs]
    return cells.join(other, on).drop(*[f"o_by_{b}" for b in by], "o_r", "o_c")


def _side(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> Column:
    """Sign of the turn a, b, c."""
    return F.signum((F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax)))


def _sides() -> tuple[Column, Column, Column, Column]:
    mine, other = ("x1", "y1", "x2", "y2"), ("o_x1", "o_y1", "o_x2", "o_y2")
    return _side(*mine, "o_x1", "o_y1"), _side(*mine, "o_x2", "o_y2"), _side(*other, "x1", "y1"), _side(*other, "x2", "y2")


def crossing_parts(e: DataFrame, key: str) -> DataFrame:
    """(key, part): parts two of whose edges cross each other. Edges meet in the boxes of a grid, not pairwise over the ring."""
    a, b, c, d = _sides()
    return edge_pairs(e, [key, "part"], ["ring", "seq"]).where((a * b < 0) & (c * d < 0)).select(key, "part").distinct()


# --- measures ----------------------------------------------------------------------------------


def polygon_metrics(vertices: DataFrame, key: str) -> DataFrame:
    """(key, n_parts, n_vertices, area_ha, centroid_x, centroid_y, simple): summed over parts, holes subtracted.

    The area is that of a cylindrical equal-area plane. simple: no part has edges that cross each other, and none is flat.
    """
    e = edges(vertices, key)
    px = lambda x: F.radians(x) * EARTH_RADIUS_KM
    py = lambda y: F.sin(F.radians(y)) * EARTH_RADIUS_KM
    flat = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    made = e.select(key, *RING, "x1", "y1", "x2", "y2", flat.alias("c"), (px(F.col("x1")) * py(F.col("y2")) - px(F.col("x2")) * py(F.col("y1"))).alias("a"))
    rings = made.groupBy(key, *RING).agg(F.count("*").alias("n"), F.abs(F.sum("a")).alias("a"), F.sum("c").alias("c"), F.sum((F.col("x1") + F.col("x2")) * F.col("c")).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * F.col("c")).alias("sy"))
    sign = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    even = sign * F.when(F.col("c") < 0, -1.0).otherwise(1.0)  # turned so that outer rings count positive and holes negative
    sums = rings.groupBy(key).agg(F.count_distinct("part").alias("n_parts"), F.sum("n").alias("n_vertices"), (F.sum(sign * F.col("a")) / 2 * 100).alias("area_ha"), (F.sum(even * F.col("sx")) / (3 * F.sum(even * F.col("c")))).alias("centroid_x"), (F.sum(even * F.col("sy")) / (3 * F.sum(even * F.col("c")))).alias("centroid_y"), F.min(F.abs("c")).alias("_flattest"))
    bad = crossing_parts(e, key).select(F.col(key).alias("_bad")).distinct()
    j = sums.join(bad, F.col(key).eqNullSafe(F.col("_bad")), "left")
    return j.select(key, "n_parts", "n_vertices", "area_ha", "centroid_x", "centroid_y", (F.col("_bad").isNull() & (F.col("_flattest") > 0)).alias("simple"))


def convex_order(vertices: DataFrame, key: str) -> DataFrame:
    """Vertices of the rings whose different points are all corners of their convex hull, numbered along the hull; other rings do not appear.

    Points in convex position are those that, ordered by direction from their mean, turn left at every one of them. So
    the hull's order needs a sort of each ring and no hull of it.
    """
    v = vertices.withColumns({c: F.lit(0) for c in RING if c not in vertices.columns})
    points = v.select(key, *RING, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    ring = Window.partitionBy(key, *RING)
    turned = points.withColumn("_angle", F.atan2(F.col("y") - F.avg("y").over(ring), F.col("x") - F.avg("x").over(ring)))
    order = ring.orderBy("_angle", "x", "y")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = turned.select(key, *RING, "x", "y", (F.row_number().over(order) - 1).alias("seq"), *[F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"_n{c}") for c in "xy"], *[F.coalesce(F.lag(c).over(order), F.last(c).over(whole)).alias(f"_p{c}") for c in "xy"])
    turn = (F.col("x") - F.col("_px")) * (F.col("_ny") - F.col("y")) - (F.col("y") - F.col("_py")) * (F.col("_nx") - F.col("x"))
    convex = placed.withColumn("_least", F.min(turn).over(ring)).withColumn("_count", F.count("*").over(ring)).where("_least > 0 and _count > 2")
    return convex.select(key, *RING, "seq", "x", "y")


def repaired(vertices: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, status): polygons with valid rings, and (key, valid, reordered) for every key.

    A part of one ring that crosses itself or is flat, and whose points are all corners of their convex hull, takes the hull's order: its points were
    right and their order was not. Keys with a part that stays invalid have no vertices.
    """
    v = vertices.withColumns({c: F.lit(0) for c in RING if c not in vertices.columns}).select(key, *RING, "seq", "x", "y")
    e = edges(v, key)
    parts = e.groupBy(key, "part").agg(F.max("ring").alias("_rings"), F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("_c"))
    crossed = crossing_parts(e, key).withColumn("_crossed", F.lit(True))
    parts = materialised(parts.join(crossed, [key, "part"], "left").withColumn("_bad", F.coalesce("_crossed", F.lit(False)) | (F.col("_c") == 0)).select(key, "part", "_bad", "_rings"))
    wrong = parts.where("_bad and _rings = 0").select(key, "part")
    hull = convex_order(v.join(wrong, [key, "part"], "left_semi"), key)
    mended = hull.select(key, "part").distinct().withColumn("_mended", F.lit(True))
    known = parts.join(mended, [key, "part"], "left")
    status = known.groupBy(key).agg(F.min(~F.col("_bad") | F.coalesce("_mended", F.lit(False))).alias("valid"), F.max(F.coalesce("_mended", F.lit(False))).alias("reordered"))
    right = v.join(parts.where("_bad").select(key, "part"), [key, "part"], "left_anti")
    whole = status.where("valid").select(key)
    return right.unionByName(hull.select(*right.columns)).join(whole, key, "left_semi"), status


def representative_point(vertices: DataFrame, key: str) -> DataFrame:
    """(key, x, y): the middle of the widest inside span at the polygon's middle height, over all parts."""
    e = edges(vertices, key)
    mid = e.groupBy(key).agg(((F.min("y1") + F.max("y1")) / 2).alias("mid"))
    hits = e.join(mid, key).where((F.col("y1") > F.col("mid")) != (F.col("y2") > F.col("mid")))
    at = hits.select(key, "part", "mid", ((F.col("x2") - F.col("x1")) * (F.col("mid") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("cut"))
    order = Window.partitionBy(key, "part").orderBy("cut")
    spans = at.select(key, "mid", "cut", F.lead("cut").over(order).alias("to"), F.row_number().over(order).alias("n")).where("n % 2 = 1 and `to` is not null")
    best = spans.groupBy(key).agg(F.max_by(F.struct("cut", "to", "mid"), F.struct(F.col("to") - F.col("cut"), -F.col("cut"))).alias("b"))
    return best.select(key, ((F.col("b.cut") + F.col("b.to")) / 2).alias("x"), F.col("b.mid").alias("y"))


# --- scan lines ----------------------------------------------------------------------------------


def scan_spans(e: DataFrame, key: str, *, west: float, north: float, size: float) -> DataFrame:
    """(key, part, row, first, last): runs of pixels whose centres lie inside a part.

    Each edge is looked at once for each row of centres it passes; the crossings of a row, sorted, bound the runs in turn. Borders are half
    open, as crosses() has them. Overlapping parts of a key give overlapping runs.
    """
    centre = lambda r: F.lit(north) - (r + 0.5) * size
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = F.sequence(F.floor((F.lit(north) - high) / size) - 1, F.floor((F.lit(north) - low) / size) + 1)
    lines = e.select(key, "part", "x1", "y1", "x2", "y2", F.explode(rows).alias("row")).withColumn("_y", centre(F.col("row"))).where((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y")))
    cut = (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    cuts = lines.groupBy(key, "part", "row").agg(F.sort_array(F.collect_list(cut)).alias("cuts"))
    runs = cuts.select(key, "part", "row", F.explode(F.expr("transform(sequence(0, size(cuts) - 2, 2), i -> struct(cuts[i] AS a, cuts[i + 1] AS b))")).alias("run"))

    def first_at(x: Column) -> Column:
        """The first column whose centre is not left of x, by the comparison of the centres themselves."""
        c = F.ceil((x - west) / size - 0.5)
        middle = lambda k: F.lit(west) + (k + 0.5) * size
        return F.when(middle(c - 1) >= x, c - 1).when(middle(c) < x, c + 1).otherwise(c)

    return runs.select(key, "part", "row", first_at(F.col("run.a")).alias("first"), (first_at(F.col("run.b")) - 1).alias("last")).where("first <= last")


#: Columns of pixels in a block, by which runs and pixels meet.
_BLOCK = 64


def spans_of_pixels(pixels: DataFrame, spans: DataFrame, key: str, *, row: str = "row", col: str = "col") -> DataFrame:
    """Each pixel with the key of each run that holds it: runs and pixels meet in blocks of a row."""
    s = spans.select(key, F.col("row").alias("_run_row"), "first", "last", F.explode(F.sequence(F.floor(F.col("first") / _BLOCK), F.floor(F.col("last") / _BLOCK))).alias("_block"))
    p = pixels.withColumn("_at", F.floor(F.col(col) / _BLOCK))
    j = p.join(s, (F.col(row) == F.col("_run_row")) & (F.col("_at") == F.col("_block")) & F.col(col).between(F.col("first"), F.col("last")))
    return j.select(*pixels.columns, key)


# --- union ---------------------------------------------------------------------------------------


def dissolve(edge_table: DataFrame, key: str, members: DataFrame, group: str) -> DataFrame:
    """Edge table of each group's union: (group, part, ring, seq, x1, y1, x2, y2, unit), the inside to the left of every edge.

    Edges of different members are cut where they cross or touch. A piece stays if the union lies on one of its sides only: borders that two members share go,
    and so do pieces inside another member. Rings of members must be simple. Shared borders must have the same corners, or corners exactly on
    the other's edge. Points, areas and scan lines work on the result as on any polygon's edges; its edges are not chained to rings.
    """
    e = edge_table.join(members.select(key, group), key)
    turn = e.groupBy(key, group, *RING).agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("_turn"))
    e = e.join(turn, [key, group, *RING]).withColumn("_left", (F.col("_turn") > 0) == (F.col("ring") == 0))
    e = materialised(e.select(group, "unit", F.xxhash64(key, *RING, "seq").alias("edge"), "x1", "y1", "x2", "y2", "_left"))

    pairs = edge_pairs(e, [group], ["edge"]).where("unit <> o_unit")
    a, b, c, d = (F.col(x) for x in ("_a", "_b", "_c", "_d"))
    pairs = pairs.withColumns(dict(zip(("_a", "_b", "_c", "_d"), _sides())))
    x1, y1, x2, y2, ox1, oy1, ox2, oy2 = (F.col(c) for c in ("x1", "y1", "x2", "y2", "o_x1", "o_y1", "o_x2", "o_y2"))
    t = ((ox1 - x1) * (oy2 - oy1) - (oy1 - y1) * (ox2 - ox1)) / ((x2 - x1) * (oy2 - oy1) - (y2 - y1) * (ox2 - ox1))
    meet = F.struct((x1 + t * (x2 - x1)).alias("x"), (y1 + t * (y2 - y1)).alias("y"))
    mine, theirs = [F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)], [F.struct(F.col(f"o_x{k}").alias("x"), F.col(f"o_y{k}").alias("y")) for k in (1, 2)]
    within = lambda p, q, r: p.between(F.least(q, r), F.greatest(q, r))
    on_mine = lambda s, p: (s == 0) & within(p["x"], x1, x2) & within(p["y"], y1, y2)
    on_other = lambda s, p: (s == 0) & within(p["x"], ox1, ox2) & within(p["y"], oy1, oy2)
    crossing = (a * b < 0) & (c * d < 0)
    cuts = F.array(
        F.struct(F.col("edge"), F.when(crossing, meet).alias("p")), F.struct(F.col("o_edge").alias("edge"), F.when(crossing, meet).alias("p")),
        *[F.struct(F.col("edge"), F.when(on_mine(s, p), p).alias("p")) for s, p in zip((a, b), theirs)],
        *[F.struct(F.col("o_edge").alias("edge"), F.when(on_other(s, p), p).alias("p")) for s, p in zip((c, d), mine)],
    )
    found = pairs.select(group, F.explode(cuts).alias("k")).where("k.p is not null").groupBy(F.col(group).alias("_g"), F.col("k.edge").alias("_e")).agg(F.collect_set("k.p").alias("cuts"))
    j = e.join(found, F.col(group).eqNullSafe(F.col("_g")) & (F.col("edge") == F.col("_e")), "left")
    ends = F.array(*mine)
    along = F.array_distinct(F.concat(ends, F.coalesce("cuts", ends)))
    far = lambda p: F.abs(p["x"] - x1) + F.abs(p["y"] - y1)
    path = F.transform(F.array_sort(F.transform(along, lambda p: F.struct(far(p).alias("t"), p["x"].alias("x"), p["y"].alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    pieces = j.withColumn("path", path).select(group, "unit", "_left", F.posexplode("path").alias("k", "p"), F.col("path").alias("_path")).withColumn("q", F.get("_path", F.col("k") + 1)).where("q is not null").select(group, "unit", "_left", "p", "q")
    straight = F.col("p") < F.col("q")
    flat = pieces.select(group, "unit", F.when(straight, F.col("p")).otherwise(F.col("q")).alias("p"), F.when(straight, F.col("q")).otherwise(F.col("p")).alias("q"), (F.col("_left") == straight).alias("left"))
    known = flat.groupBy(group, "p", "q").agg(F.max("left").alias("left"), F.max(~F.col("left")).alias("right"), F.collect_set("unit").alias("owners"))
    known = materialised(known.where("not (left and right)").withColumn("piece", F.xxhash64("p", "q")))

    # pieces inside another member: their middle crosses a unit, that does not own them, an odd number of times
    middle = known.select(group, "piece", "owners", ((F.col("p.x") + F.col("q.x")) / 2).alias("_px"), ((F.col("p.y") + F.col("q.y")) / 2).alias("_py"))
    boxes = e.groupBy(group, "unit").agg(F.min("x1").alias("_x0"), F.max("x1").alias("_x9"), F.min("y1").alias("_y0"), F.max("y1").alias("_y9"))
    span = boxes.groupBy(group).agg(F.min("_y0").alias("_low"), (F.greatest(F.max("_y9") - F.min("_y0"), F.lit(1e-9)) / F.ceil(F.sqrt(F.count("*") * 4.0))).alias("_s")).withColumnRenamed(group, "_g")
    row = lambda v: F.floor((v - F.col("_low")) / F.col("_s"))
    near = lambda df: df.join(span, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    m = near(middle).withColumn("_r", row(F.col("_py"))).drop("_low", "_s")
    lines = near(e.join(boxes.drop("_y0", "_y9"), [group, "unit"])).withColumn("_r", F.explode(F.sequence(row(F.least("y1", "y2")), row(F.greatest("y1", "y2"))))).select(F.col(group).alias("_g"), "unit", "x1", "y1", "x2", "y2", "_r", "_x0", "_x9")
    px, py = F.col("_px"), F.col("_py")
    over = m.join(lines.withColumnRenamed("_r", "_er"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_er")) & px.between(F.col("_x0"), F.col("_x9")) & ~F.expr("array_contains(owners, unit)")).where(crosses(px, py))
    covered = over.groupBy(group, "piece").agg(F.bit_xor("unit").alias("_in")).where("_in <> 0").select(F.col(group).alias("_g"), F.col("piece").alias("_p"))
    kept = known.join(covered, F.col(group).eqNullSafe(F.col("_g")) & (F.col("piece") == F.col("_p")), "left_anti")
    a, b = F.when(F.col("left"), F.col("p")).otherwise(F.col("q")), F.when(F.col("left"), F.col("q")).otherwise(F.col("p"))
    return kept.select(group, F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("piece").alias("seq"), a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"), F.xxhash64(group).alias("unit"))


def edge_area(e: DataFrame, key: str) -> DataFrame:
    """(key, area_ha) of directed edges with the inside to their left, such as dissolve() gives."""
    px = lambda x: F.radians(x) * EARTH_RADIUS_KM
    py = lambda y: F.sin(F.radians(y)) * EARTH_RADIUS_KM
    return e.groupBy(key).agg((F.sum(px(F.col("x1")) * py(F.col("y2")) - px(F.col("x2")) * py(F.col("y1"))) / 2 * 100).alias("area_ha"))
