"""Spatial joins as bucket equi-joins.

Points and candidates meet in blocks of three by three buckets, so every join is an equi-join on buckets that Spark shuffles, sorts and
spills. A bucket is a row of equal latitude and a column that widens with 1 / cos(latitude) and wraps at the antimeridian. Rows
at one place share a search. The reference goes to the buckets around it and the searching places stay where they are, so what a place finds lies in one task.
Joins are merged by sorting: file sizes say little about rows, and a table taken for small would be broadcast through the driver. Only by groups are broadcast, once counted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_RADIUS_KM, haversine_km
from .cells import cell_of, degrees
from .polygons import crosses, edges, in_a_unit, on_edge, polygon_metrics, repaired, scan_spans
from .state import materialised, stored

KM_PER_DEGREE = EARTH_RADIUS_KM * 3.141592653589793 / 180
NEIGHBOURS = 16  # reference points expected in a first block
CROWDED = 4096  # reference points of a block beyond which they meet places in pairs instead of a list
LISTED = 4096  # edges of a bucket beyond which they meet points in pairs instead of a list
GROUPS = 10_000  # by groups that may be broadcast


def _row(lat: Column, size: float) -> Column:
    return F.floor((lat + 90) / size).cast("int")


def _columns(row: Column, size: float) -> Column:
    """Columns of a row: any point within size degrees of a point of the row lies in its column or beside it. One column where that reaches a pole."""
    far = F.greatest(F.abs(row * size - 90), F.abs((row + 1) * size - 90)) + size
    return F.when(far >= 89.9, 1).otherwise(F.greatest(F.floor(360 * F.cos(F.radians(far)) / size), F.lit(1))).cast("int")


def _column(lon: Column, columns: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / (360 / columns)).cast("int"), columns)


def home(lat: Column, lon: Column, size: float) -> Column:
    """The bucket of a point: struct(row, column)."""
    row = _row(lat, size)
    return F.struct(row.alias("r"), _column(lon, _columns(row, size)).alias("c"))


def block(lat: Column, lon: Column, size: float) -> Column:
    """Array of the buckets that hold all points nearer than size degrees; it is also the buckets of all points that have this one in their block."""
    rows = F.sequence(_row(lat, size) - 1, _row(lat, size) + 1)
    beside = lambda r, n: F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(_column(lon, n) + d, n)))
    return F.flatten(F.transform(rows, lambda r: F.transform(beside(r, _columns(r, size)), lambda c: F.struct(r.alias("r"), c.alias("c")))))


def _sure_km(size: float) -> float:
    """No point outside the block is nearer than this."""
    return size * KM_PER_DEGREE * (1 - 1e-9)


def _known(lat: str, lon: str) -> Column:
    return F.col(lat).isNotNull() & F.col(lon).isNotNull()


def _reference(ref: DataFrame, lat: str, lon: str, id_col: str, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    named = [F.col(b).alias(f"_by{n}") for n, b in enumerate(by)]
    return ref.where(_known(lat, lon)).select(*named, F.col(lat).alias("_rlat"), F.col(lon).alias("_rlon"), F.col(id_col).alias("_rid"), *[F.col(k).alias(f"_keep_{k}") for k in keep])


def _meets(by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col("_b") == F.col("_lb"), *[F.col(b) == F.col(f"_by{n}") for n, b in enumerate(by)]])


def _of_groups(rows: DataFrame, ref: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows whose by group occurs in ref. The groups are counted first: few ones are broadcast, so that a large group is not one task; many are merged."""
    groups = stored(ref.select(*by).distinct())
    return rows.join(groups.hint("broadcast" if groups.count() <= GROUPS else "merge"), list(by), "left_semi")


def _pairs(left: DataFrame, right: DataFrame, size: float, by: Sequence[str], lat: str, lon: str) -> DataFrame:
    """Left rows with each reference point of the buckets around them, and the distance as _km."""
    spread = left.withColumn("_lb", F.explode(block(F.col(lat), F.col(lon), size)))
    at = right.withColumn("_b", home(F.col("_rlat"), F.col("_rlon"), size))
    return spread.join(at.hint("merge"), _meets(by)).withColumn("_km", haversine_km(F.col(lat), F.col(lon), F.col("_rlat"), F.col("_rlon"))).drop("_lb", "_b", "_rlat", "_rlon", *[f"_by{n}" for n in range(len(by))])


def block_sizes(ref: DataFrame, lat: str, lon: str, by: Sequence[str]) -> tuple[float, ...]:
    """Block sizes in degrees from one small aggregate: nine first blocks hold about NEIGHBOURS points of a by group."""
    groups = F.count_distinct(F.struct(*by)) if by else F.lit(1)
    n, g, a, b, c, d = ref.agg(F.count(lat), groups, F.min(lat), F.max(lat), F.min(lon), F.max(lon)).first()
    if not n:
        return (180.0,)
    area = max(b - a, 0.01) * max(d - c, 0.01)
    first = min(45.0, max(0.01, (area * NEIGHBOURS / 9 / max(1.0, n / max(g, 1))) ** 0.5))
    return tuple(first * 4**k for k in range(8) if first * 4**k < 90) + (180.0,)


def _listed(places: DataFrame, right: DataFrame, size: float, k: int, by: Sequence[str], lat: str, lon: str, entry, name: str, later: bool) -> tuple[DataFrame, DataFrame | None]:
    """places with their k nearest among the lists of reference points that their buckets hold, and the places whose list would be too long (None for none)."""
    spread = right.withColumn("_b", F.explode(block(F.col("_rlat"), F.col("_rlon"), size)))
    bucket = [*[f"_by{n}" for n in range(len(by))], "_b"]
    at = places.withColumn("_lb", home(F.col(lat), F.col(lon), size))
    if later:  # few places are open, and only their blocks are needed
        spread = spread.join(at.select(*[F.col(b).alias(f"_by{n}") for n, b in enumerate(by)], F.col("_lb").alias("_b")).distinct().hint("merge"), bucket, "left_semi")
    crowded = stored(spread.groupBy(*bucket).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED).drop("_n"))
    dense = None
    if not crowded.isEmpty():
        spread = spread.join(crowded.hint("merge"), bucket, "left_anti")
        dense = at.join(crowded.hint("merge"), _meets(by), "left_semi").drop("_lb")
        at = at.join(crowded.hint("merge"), _meets(by), "left_anti")
    lists = spread.groupBy(*bucket).agg(F.collect_list(F.struct("_rlat", "_rlon", "_rid", *[c for c in right.columns if c.startswith("_keep_")])).alias("_list"))
    near = F.transform("_list", lambda p: entry(haversine_km(F.col(lat), F.col(lon), p["_rlat"], p["_rlon"]), lambda c: p[c]))
    best = F.array_compact(F.array(F.array_min(near))) if k == 1 else F.slice(F.array_sort(near), 1, k)
    return at.join(lists.hint("merge"), _meets(by), "left").select(*places.columns, best.alias(name)), dense


def search(places: DataFrame, ref: DataFrame, k: int, *, ref_id: str, by: Sequence[str] = (), lat: str = "lat", lon: str = "lon", ref_lat: str = "lat", ref_lon: str = "lon", keep: Sequence[str] = (), keys: Sequence[str] = (), where: Column | None = None, levels: Sequence[float] = (), name: str = "neighbours") -> DataFrame:
    """places (different ones, by, lat, lon without NULL) with their k nearest reference points; see nearest_k(). keys (by, lat, lon if not given) name a row; those that no level settles are left out."""
    keys = list(keys) or [*by, lat, lon]
    entry = lambda km, field: F.struct(km.alias("km"), field("_rid").alias("id"), *[field(f"_keep_{c}").alias(c) for c in keep])
    right = _reference(ref, ref_lat, ref_lon, ref_id, by, keep)
    if where is None:  # of the points at one place the k smallest ids can count
        first = Window.partitionBy(*[f"_by{n}" for n in range(len(by))], "_rlat", "_rlon").orderBy("_rid")
        right = right.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
    right = stored(right)
    levels = levels or block_sizes(right, "_rlat", "_rlon", [f"_by{n}" for n in range(len(by))])
    order = Window.partitionBy(*keys).orderBy("_km", "_rid")
    open_rows, settled = places, []
    for n, size in enumerate(levels):
        last = n == len(levels) - 1
        listed, paired = (None, open_rows) if where is not None else _listed(open_rows, right, size, k, by, lat, lon, entry, name, n > 0)
        parts = [] if listed is None else [listed]
        if paired is not None:
            found = _pairs(paired, right, size, by, lat, lon)
            found = found.where(where) if where is not None else found
            few = found.select(*keys, "_km", "_rid", *[f"_keep_{c}" for c in keep]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
            best = few.groupBy(*keys).agg(F.array_sort(F.collect_list(entry(F.col("_km"), F.col))).alias(name))
            parts.append(paired.join(best.hint("merge"), keys, "left").select(*places.columns, name))
        joined = stored(reduce(DataFrame.unionByName, parts))  # read twice: settled rows and open ones
        if last:
            settled.append(joined)
            break
        sure = F.coalesce((F.size(name) == k) & (F.element_at(name, -1)["km"] < _sure_km(size)), F.lit(False))
        settled.append(joined.where(sure))
        open_rows = joined.where(~sure).drop(name)
        if open_rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, settled)


def nearest_k(left: DataFrame, ref: DataFrame, keys: Sequence[str], k: int, *, ref_id: str, by: Sequence[str] = (), lat: str = "lat", lon: str = "lon", where: Column | None = None, name: str = "neighbours", ref_lat: str = "lat", ref_lon: str = "lon", **options) -> DataFrame:
    """left with an array of structs (km, id and the kept attributes) of its k nearest reference points, in order of distance and id; fewer where there are fewer.

    Blocks grow only for places whose k-th distance exceeds what their block guarantees. The first block size follows the
    reference's density and grows fourfold until no place is open; the last level spans the globe. Each place reads the list of its bucket; places whose
    list would be longer than CROWDED are joined in pairs. Rows whose by group has no reference at all get an empty array at once. keys name a
    left row; by columns must be equal; where may use the columns of both sides (kept ones as _keep_<name>), and then every row searches for itself.
    """
    rows = left.where(_known(lat, lon))
    if by:
        rows = _of_groups(rows, ref.where(_known(ref_lat, ref_lon)), by)
    on = list(keys) if where is not None else [*by, lat, lon]
    rows = rows.select(*left.columns) if where is not None else rows.select(*on).distinct()
    found = search(rows, ref, k, ref_id=ref_id, by=by, lat=lat, lon=lon, ref_lat=ref_lat, ref_lon=ref_lon, keys=on, where=where, name=name, **options).select(*on, name)
    return left.join(found.hint("merge"), on, "left").select(*left.columns, F.coalesce(name, F.array().cast(found.schema[name].dataType)).alias(name))


def nearest(left: DataFrame, ref: DataFrame, keys: Sequence[str], *, keep: Sequence[str] = (), **options) -> DataFrame:
    """left with nearest_id, nearest_km and the kept attributes of the nearest reference point (smallest id on ties; NULL without any). See nearest_k()."""
    found = nearest_k(left, ref, keys, 1, keep=keep, name="_best", **options)
    best = F.get("_best", F.lit(0))
    return found.select(*left.columns, best["id"].alias("nearest_id"), best["km"].alias("nearest_km"), *[best[c].alias(f"nearest_{c}") for c in keep])


def _unit(lat: Column, lon: Column, prefix: str) -> list[Column]:
    a, o = F.radians(lat), F.radians(lon)
    return [(F.cos(a) * F.cos(o)).alias(f"{prefix}x"), (F.cos(a) * F.sin(o)).alias(f"{prefix}y"), F.sin(a).alias(f"{prefix}z")]


def _around(places: DataFrame, ref: DataFrame, km: float, *, by: Sequence[str], lat: str, lon: str, ref_lat: str, ref_lon: str, strict: bool) -> tuple[DataFrame, DataFrame, Column]:
    """Places with their bucket as _lb, the reference's different places with their number of points as _m in each bucket around them, and the condition of the join.

    The scalar product of unit vectors decides all pairs but those within 1e-12 of the limit, which the distance decides.
    """
    size = km / KM_PER_DEGREE * 1.000001
    named = [F.col(b).alias(f"_by{n}") for n, b in enumerate(by)]
    points = ref.where(_known(ref_lat, ref_lon)).groupBy(*named, F.col(ref_lat).alias("_rlat"), F.col(ref_lon).alias("_rlon")).agg(F.count("*").alias("_m"))
    right = points.select("*", *_unit(F.col("_rlat"), F.col("_rlon"), "_r")).withColumn("_b", F.explode(block(F.col("_rlat"), F.col("_rlon"), size)))
    left = places.select("*", *_unit(F.col(lat), F.col(lon), "_l"), home(F.col(lat), F.col(lon), size).alias("_lb"))
    dot = F.col("_lx") * F.col("_rx") + F.col("_ly") * F.col("_ry") + F.col("_lz") * F.col("_rz")
    limit = math.cos(min(km / EARTH_RADIUS_KM, math.pi))
    d = haversine_km(F.col(lat), F.col(lon), F.col("_rlat"), F.col("_rlon"))
    near = F.when(dot > limit + 1e-12, dot < 2).when(dot > limit - 1e-12, d < km if strict else d <= km).otherwise(False)  # NaN is above all numbers
    return left, right, _meets(by) & near


def count_places(places: DataFrame, ref: DataFrame, km: float, *, by: Sequence[str] = (), lat: str = "lat", lon: str = "lon", ref_lat: str = "lat", ref_lon: str = "lon", name: str = "n_within") -> DataFrame:
    """(by, lat, lon, name) for the different places with a reference point within km."""
    left, right, on = _around(places, ref, km, by=by, lat=lat, lon=lon, ref_lat=ref_lat, ref_lon=ref_lon, strict=False)
    # a place is in one bucket only, which spares a second shuffle
    return left.join(right.hint("merge"), on).groupBy(*by, "_lb", lat, lon).agg(F.sum("_m").alias(name)).drop("_lb")


def count_within(left: DataFrame, ref: DataFrame, keys: Sequence[str], km: float, *, ref_id: str, by: Sequence[str] = (), exclude_same: tuple[str, str] | None = None, name: str = "n_within", lat: str = "lat", lon: str = "lon", ref_lat: str = "lat", ref_lon: str = "lon") -> DataFrame:
    """left with the number of reference points within km (0 when none). exclude_same: a left column that must differ from the reference id."""
    place = [*by, lat, lon]
    counts = count_places(left.where(_known(lat, lon)).select(*place).distinct(), ref, km, by=by, lat=lat, lon=lon, ref_lat=ref_lat, ref_lon=ref_lon, name=name)
    out = left.join(counts.hint("merge"), place, "left").select(*left.columns, F.coalesce(name, F.lit(0)).alias(name))
    if not exclude_same:
        return out
    own = _reference(ref, ref_lat, ref_lon, ref_id, by, ()).where(~F.isnan("_rlat") & ~F.isnan("_rlon"))
    same = reduce(lambda a, b: a & b, [F.col(exclude_same[0]).eqNullSafe(F.col("_rid")), *[F.col(b) == F.col(f"_by{n}") for n, b in enumerate(by)]])
    near = left.select(*dict.fromkeys([*keys, *place, exclude_same[0]])).join(own.hint("merge"), same).where(haversine_km(F.col(lat), F.col(lon), F.col("_rlat"), F.col("_rlon")) <= km)
    own_counts = near.groupBy(*keys).agg(F.count("*").alias("_own"))
    return out.join(own_counts.hint("merge"), list(keys), "left").select(*left.columns, (F.col(name) - F.coalesce("_own", F.lit(0))).alias(name))


def nearest_other(rows: DataFrame, ref: DataFrame, keys: Sequence[str], *, self_id: str, ref_id: str, **options) -> DataFrame:
    """nearest() that never takes the row itself: the first of the two nearest references that has another id."""
    found = nearest_k(rows, ref, keys, 2, ref_id=ref_id, name="_two", **options)
    other = F.get(F.filter("_two", lambda n: ~n["id"].eqNullSafe(F.col(self_id))), F.lit(0))
    return found.select(*rows.columns, other["id"].alias("nearest_id"), other["km"].alias("nearest_km"))


def purge(train: DataFrame, held_out: DataFrame, keys: Sequence[str], km: float, *, held_id: str, by: Sequence[str] = (), lat: str = "lat", lon: str = "lon", ref_lat: str = "lat", ref_lon: str = "lon") -> DataFrame:
    """Training rows without a held-out point nearer than km."""
    place = [*by, lat, lon]
    left, right, on = _around(train.where(_known(lat, lon)).select(*place).distinct(), held_out, km, by=by, lat=lat, lon=lon, ref_lat=ref_lat, ref_lon=ref_lon, strict=True)
    near = left.join(right.hint("merge"), on, "left_semi").select(*place)
    return train.join(near.hint("merge"), place, "left_anti").select(*train.columns)


def _cut(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("int")


def _buckets(polygon_edges: DataFrame, poly: str, size: float) -> DataFrame:
    """Edges in the buckets (_r, _c) of the rows they span, from their polygon's left border to their own right end; _m is a bucket's number of edges."""
    box = polygon_edges.groupBy(poly).agg(F.min("x1").alias("_x0"))
    e = polygon_edges.join(box, poly)
    e = e.withColumn("_r", F.explode(F.sequence(_cut(F.least("y1", "y2"), size), _cut(F.greatest("y1", "y2"), size)))).withColumn("_c", F.explode(F.sequence(_cut(F.col("_x0"), size), _cut(F.greatest("x1", "x2"), size))))
    return e.select(poly, "unit", "x1", "y1", "x2", "y2", "_r", "_c", F.count("*").over(Window.partitionBy("_r", "_c")).alias("_m"))


def _in_pairs(points: DataFrame, e: DataFrame, keys: Sequence[str], poly: str, x: str, y: str, size: float, boundary: str) -> DataFrame:
    """containing() by pairs of points and edges."""
    p = points.select(*keys, F.col(x).alias("_px"), F.col(y).alias("_py"), _cut(F.col(y), size).alias("_r"), _cut(F.col(x), size).alias("_c"))
    px, py = F.col("_px"), F.col("_py")
    sums = p.join(e, ["_r", "_c"]).groupBy(*keys, poly).agg(in_a_unit(crosses(px, py)).alias("_in"), F.max(on_edge(px, py)).alias("_on"))
    kept = {"covers": F.col("_in") | F.col("_on"), "within": F.col("_in") & ~F.col("_on"), "half_open": F.col("_in")}[boundary]
    return sums.where(kept).select(*keys, poly)


def _located(points: DataFrame, e: DataFrame, poly: str, x: str, y: str, size: float, boundary: str) -> DataFrame:
    """points with _polys, the different polygons that contain them, and _full: whether their bucket has too many edges for a list, so that _polys is empty.

    A point reads the list of its bucket's edges, so that no table of points and polygons is grouped.
    """
    edge = F.struct(F.col(poly).alias("k"), *["unit", "x1", "y1", "x2", "y2"])
    lists = e.groupBy("_r", "_c").agg(F.collect_list(F.when(F.col("_m") <= LISTED, edge)).alias("_edges"), (F.max("_m") > LISTED).alias("_full"))
    px, py = F.col(x), F.col(y)
    p = points.withColumns({"_pr": _cut(py, size), "_pc": _cut(px, size)})
    at = p.join(lists, (F.col("_pr") == F.col("_r")) & (F.col("_pc") == F.col("_c")), "left").drop("_pr", "_pc", "_r", "_c")
    at = at.withColumns({"_crossed": F.filter("_edges", lambda s: crosses(px, py, s.getField)), "_on": F.transform(F.filter("_edges", lambda s: on_edge(px, py, s.getField)), lambda s: s["k"])})
    total = lambda k: F.aggregate(F.filter("_crossed", lambda s: s["k"].eqNullSafe(k)), F.lit(0).cast("long"), lambda a, s: a.bitwiseXOR(s["unit"]))
    inside = F.filter(F.array_distinct(F.transform("_crossed", lambda s: s["k"])), lambda k: total(k) != 0)
    found = {"covers": F.array_union(inside, F.col("_on")), "within": F.array_except(inside, F.col("_on")), "half_open": inside}[boundary]
    return at.select(*points.columns, found.alias("_polys"), F.coalesce("_full", F.lit(False)).alias("_full"))


def containing(points: DataFrame, polygon_edges: DataFrame, keys: Sequence[str], poly: str, *, x: str = "lon", y: str = "lat", size: float = 4.0, boundary: str = "within") -> DataFrame:
    """(keys, poly): every polygon that contains each point, by even-odd crossings of a ray to the right, half open in y.

    An edge goes to the buckets of the rows it spans, from its polygon's left border to its own right end: points elsewhere cannot cross it. Points of
    buckets with more than LISTED edges meet them in pairs. boundary "covers" adds points on an edge; "within" removes them; "half_open" leaves them to the crossings.
    """
    e = _buckets(polygon_edges, poly, size)
    found = _located(points.select(*dict.fromkeys([*keys, x, y])), e, poly, x, y, size, boundary).select(*keys, F.explode("_polys").alias(poly))
    return found.unionByName(_in_pairs(points, e.where(F.col("_m") > LISTED), keys, poly, x, y, size, boundary))


def point_in_polygon_join(points: DataFrame, vertices: DataFrame, keys: Sequence[str], poly: str, *, x: str = "lon", y: str = "lat", size: float = 4.0, boundary: str = "within") -> DataFrame:
    """points with the smallest key of the polygons that contain them, NULL for none."""
    e = _buckets(edges(vertices, poly), poly, size)
    at = _located(points, e, poly, x, y, size, boundary)
    full = at.where("_full").select(*points.columns)
    found = _in_pairs(full, e.where(F.col("_m") > LISTED), keys, poly, x, y, size, boundary).groupBy(*keys).agg(F.min(poly).alias(poly))
    return at.where("not _full").select(*points.columns, F.array_min("_polys").alias(poly)).unionByName(full.join(found, list(keys), "left").select(*points.columns, poly))


def bbox_candidates(boxes: DataFrame, points: DataFrame, box_id: str, *, x: str = "lon", y: str = "lat", size: float = 1.0) -> DataFrame:
    """(box_id, point columns): points inside each box (x0, y0, x1, y1), found through buckets."""
    cut = lambda v: F.floor(F.col(v) / size).cast("int")
    b = boxes.select(box_id, "x0", "y0", "x1", "y1", F.explode(F.sequence(cut("x0"), cut("x1"))).alias("_c")).withColumn("_r", F.explode(F.sequence(cut("y0"), cut("y1"))))
    p = points.withColumns({"_pc": cut(x), "_pr": cut(y)})
    joined = p.join(b, (F.col("_pc") == F.col("_c")) & (F.col("_pr") == F.col("_r")) & F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1")))
    return joined.select(box_id, *points.columns)


def polyfill(vertices: DataFrame, poly: str, res: int) -> DataFrame:
    """(poly, cell): cells whose centre lies inside the polygon, filled row by row between the crossings of its edges."""
    d = degrees(res)
    runs = scan_spans(edges(vertices, poly), poly, west=-180.0, north=90.0, size=d)
    filled = runs.select(poly, "row", F.explode(F.sequence("first", "last")).alias("col"))
    return filled.select(poly, cell_of(90 - (F.col("row") + 0.5) * d, (F.col("col") + 0.5) * d - 180, res).alias("cell")).distinct()


# --- checks of located records -----------------------------------------------------------------


def spatial_quality(blocks: DataFrame, regions: DataFrame, key: str, region: str, *, stated: str, lat: str, lon: str, aliases: Mapping[str, str] | None = None, notes: Mapping[str, str] | None = None) -> DataFrame:
    """blocks with quality_flag, in_stated_region and note: whether the centroid lies in (or on the border of) the region that the record states.

    regions is an edge table by region, for groups of polygons the one that dissolve() gives. aliases: stated names whose boundary goes by
    another name; notes: remarks on accepted records of a stated name. Flags: unavailable (no centroid), boundary_lookup_unavailable (no such region),
    accepted, source_location_mismatch. The record's own coordinates stay.
    """
    name = F.col(stated)
    for a, b in (aliases or {}).items():
        name = F.when(F.col(stated) == a, F.lit(b)).otherwise(name)
    found = containing(blocks.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()), regions, [key], region, x=lon, y=lat, boundary="covers")
    found = found.select(F.col(key).alias("_k"), F.col(region).alias("_r"), F.lit(True).alias("_in")).distinct()
    known = regions.select(F.col(region).alias("_region")).distinct()
    j = blocks.withColumn("_name", name).join(known, F.col("_name") == F.col("_region"), "left").join(found, (F.col(key) == F.col("_k")) & (F.col("_name") == F.col("_r")), "left")
    flag = F.when(F.col(lat).isNull() | F.col(lon).isNull(), "unavailable").when(F.col("_region").isNull(), "boundary_lookup_unavailable").when(F.col("_in"), "accepted").otherwise("source_location_mismatch")
    text = F.lit(None).cast("string")
    for a, b in (notes or {}).items():
        text = F.when(F.col(stated) == a, F.lit(b)).otherwise(text)
    shown = F.col(stated).cast("string")
    note = F.when(flag == "unavailable", "no geometry").when(flag == "boundary_lookup_unavailable", F.concat(F.lit("no boundary for "), F.coalesce(shown, F.lit("an unstated region")))).when(flag == "accepted", text).otherwise(F.concat(F.lit("centroid outside "), shown))
    inside = F.when(flag == "accepted", True).when(flag == "source_location_mismatch", False)
    return j.select(*blocks.columns, flag.alias("quality_flag"), inside.alias("in_stated_region"), note.alias("note"))


def admit_geometry(vertices: DataFrame, stated: DataFrame, regions: DataFrame, key: str, region: str, *, areas: Sequence[str], least_vertices: int = 3, tolerance_pct: float = 5.0) -> DataFrame:
    """(key, n_vertices, area_ha, reordered, reason) for each row of stated (key, region and the stated areas).

    The reason is the first check that fails: no_geometry, too_few_vertices, invalid_ring (after repaired()), no_stated_region, outside_region (the
    centroid), area_missing, area_differs (from any stated area by more than the tolerance); admitted if none does.
    """
    mended, status = repaired(vertices, key)
    size = vertices.groupBy(key).agg(F.count("*").alias("_given"))
    m = materialised(polygon_metrics(mended, key))
    found = containing(m, regions, [key], region, x="centroid_x", y="centroid_y", boundary="covers").select(F.col(key).alias("_k"), F.col(region).alias("_r"), F.lit(True).alias("_in")).distinct()
    j = stated.join(size, key, "left").join(status, key, "left").join(m, key, "left").join(found, (F.col(key) == F.col("_k")) & (F.col(region) == F.col("_r")), "left")
    absent = reduce(lambda a, b: a | b, [F.col(a).isNull() | (F.col(a) <= 0) for a in areas])
    apart = reduce(lambda a, b: a | b, [F.abs(F.col("area_ha") - F.col(a)) / F.col(a) * 100 > tolerance_pct for a in areas])
    checks = ((F.col("_given").isNull(), "no_geometry"), (F.col("_given") < least_vertices, "too_few_vertices"), (~F.coalesce("valid", F.lit(False)), "invalid_ring"), (F.col(region).isNull(), "no_stated_region"), (F.col("_in").isNull(), "outside_region"), (absent, "area_missing"), (apart, "area_differs"))
    reason = F.lit("admitted")
    for bad, name in reversed(checks):
        reason = F.when(bad, name).otherwise(reason)
    return j.select(key, "n_vertices", "area_ha", F.coalesce("reordered", F.lit(False)).alias("reordered"), reason.alias("reason"))
