"""Queries G, R, M, Q and D: cells, rasters, scores, governance and documents; and the flagship W2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cells as G
from ..operators import documents as D
from ..operators import governance as Q
from ..operators import polygons as Y
from ..operators import raster as A
from ..operators import relational as R
from ..operators import scoring as M
from ..operators import spatial as P
from .fixtures import GRID
from .registry import haversine, inside, query
from .table_queries import _AFFINITY, _PART_HITS, _WITHIN

r6 = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 6)
RES = 6


def _spread_sql(v: str) -> str:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = f"((({v}) | (({v}) << {shift})) & {mask})"
    return v


def _cell_sql(lat: str, lon: str, res: int) -> str:
    d = 180 / (1 << res)
    row, col = f"CAST(floor(({lat} + 90) / {d!r}) AS BIGINT)", f"CAST(floor(({lon} + 180) / {d!r}) AS BIGINT)"
    return f"({res << 56} + {_spread_sql(col)} + 2 * {_spread_sql(row)})"


_D = 180 / (1 << RES)
_CLAT, _CLON = f"(floor((lat + 90) / {_D!r}) + 5e-1) * {_D!r} - 90", f"(floor((lon + 180) / {_D!r}) + 5e-1) * {_D!r} - 180"


# --- cells --------------------------------------------------------------------------------


@query("g1_cell_of", f"SELECT site_id, {_cell_sql('lat', 'lon', RES)} AS cell FROM sites")
def _(x):
    return x.sites.select("site_id", G.cell_of(F.col("lat"), F.col("lon"), RES).alias("cell"))


@query("g2_parent", f"SELECT site_id, {_cell_sql('lat', 'lon', 3)} AS parent FROM sites")
def _(x):
    return x.sites.select("site_id", G.parent(G.cell_of(F.col("lat"), F.col("lon"), RES), RES, 3).alias("parent"))


@query("g3_children_points", f", c AS (SELECT cell_id, floor((lon + 180) / {_D!r}) * {_D!r} - 180 AS w, floor((lat + 90) / {_D!r}) * {_D!r} - 90 AS s FROM cells) SELECT cell_id, CAST((i % 2) + 2 * (j % 2) + 4 * (i // 2) + 8 * (j // 2) AS INTEGER) AS sample, round(s + (j + 5e-1) * {_D / 4!r}, 6) AS sample_lat, round(w + (i + 5e-1) * {_D / 4!r}, 6) AS sample_lon FROM c CROSS JOIN (SELECT range AS i FROM range(4)) CROSS JOIN (SELECT range AS j FROM range(4))")
def _(x):
    cells = x.cells.select("cell_id", G.cell_of(F.col("lat"), F.col("lon"), RES).alias("cell"))
    return G.sample_points(cells, "cell", RES, RES + 2).select("cell_id", "sample", r6("sample_lat").alias("sample_lat"), r6("sample_lon").alias("sample_lon"))


@query("g4_polyfill", f", b AS (SELECT min(floor((x + 180) / {_D!r})) AS i0, max(floor((x + 180) / {_D!r})) AS i1, min(floor((y + 90) / {_D!r})) AS j0, max(floor((y + 90) / {_D!r})) AS j1 FROM vertices), g AS (SELECT (i.range + 5e-1) * {_D!r} - 180 AS lon, (j.range + 5e-1) * {_D!r} - 90 AS lat FROM b, range(0, 128) i, range(0, 64) j WHERE i.range BETWEEN i0 AND i1 AND j.range BETWEEN j0 AND j1) SELECT region_id, {_cell_sql('c.lat', 'c.lon', RES)} AS cell FROM g c CROSS JOIN edges e GROUP BY region_id, c.lat, c.lon HAVING {inside('c.lon', 'c.lat')} AND (SELECT count(*) FROM part) > 0")
def _(x):
    return P.polyfill(x.vertices, "region_id", RES)


@query("g4_polyfill_parts", f", g AS (SELECT (i.range + 5e-1) * {_D!r} - 180 AS lon, (j.range + 5e-1) * {_D!r} - 90 AS lat FROM range(0, 128) i, range(0, 64) j) SELECT DISTINCT district_id, {_cell_sql('lat', 'lon', RES)} AS cell FROM (SELECT district_id, c.lat, c.lon FROM g c CROSS JOIN dedges e GROUP BY district_id, part, c.lat, c.lon HAVING {inside('c.lon', 'c.lat')})")
def _(x):
    return P.polyfill(x.districts, "district_id", RES)


@query("g5_cell_geometry", f", c AS (SELECT cell_id, {_CLAT} AS lat, {_CLON} AS lon FROM cells) SELECT cell_id, round(lat, 6) AS centre_lat, round(lon, 6) AS centre_lon, printf('POLYGON ((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))', lon - {_D / 2!r}, lat - {_D / 2!r}, lon + {_D / 2!r}, lat - {_D / 2!r}, lon + {_D / 2!r}, lat + {_D / 2!r}, lon - {_D / 2!r}, lat + {_D / 2!r}, lon - {_D / 2!r}, lat - {_D / 2!r}) AS wkt, round(pow(63710088e-4, 2) * radians({_D!r}) * (sin(radians(lat + {_D / 2!r})) - sin(radians(lat - {_D / 2!r}))), 3) AS area_km2 FROM c")
def _(x):
    cell = G.cell_of(F.col("lat"), F.col("lon"), RES)
    lat, lon = G.centre(cell, RES)
    wkt, area = G.geometry(cell, RES)
    return x.cells.select("cell_id", r6(lat).alias("centre_lat"), r6(lon).alias("centre_lon"), wkt.alias("wkt"), F.round(area, 3).alias("area_km2"))


_HEX = "h AS (SELECT cell_id, seq, lon + CASE seq WHEN 0 THEN 0 WHEN 1 THEN 1e-1 WHEN 2 THEN 2e-1 ELSE 5e-2 END AS x, lat + CASE seq WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN (cell_id % 5) / 1e1 ELSE 2e-1 END AS y FROM cells CROSS JOIN (SELECT range AS seq FROM range(4)))"
_HEX_EDGES = "he AS (SELECT cell_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM h WINDOW w AS (PARTITION BY cell_id ORDER BY seq))"


def _quads(x):
    """A quadrangle a cell, some of them folded over."""
    seq = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq")
    q = x.cells.select("cell_id", "lat", "lon", seq)
    dx = F.when(F.col("seq") == 0, 0.0).when(F.col("seq") == 1, 0.1).when(F.col("seq") == 2, 0.2).otherwise(0.05)
    dy = F.when(F.col("seq") < 2, 0.0).when(F.col("seq") == 2, F.col("cell_id") % 5 / 1e1).otherwise(0.2)
    return q.select("cell_id", "seq", (F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))


@query("g6_polygon_metrics", f", {_HEX}, {_HEX_EDGES} SELECT cell_id, count(*) AS n_vertices, round(abs(sum(radians(x1) * 63710088e-4 * sin(radians(y2)) * 63710088e-4 - radians(x2) * 63710088e-4 * sin(radians(y1)) * 63710088e-4)) / 2 * 100, 2) AS area_ha, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 4) AS centroid_x, true AS simple FROM he GROUP BY 1")
def _(x):
    return Y.polygon_metrics(_quads(x), "cell_id").select("cell_id", "n_vertices", F.round("area_ha", 2).alias("area_ha"), F.round("centroid_x", 4).alias("centroid_x"), "simple")


_GROUP_HITS = f", gh AS (SELECT DISTINCT c.cell_id, n_regionkey FROM (SELECT c.cell_id, e.region_id FROM cells c CROSS JOIN edges e GROUP BY c.cell_id, c.lat, c.lon, e.region_id HAVING {inside('c.lon', 'c.lat')}) c JOIN nation ON region_id = n_nationkey)"


def _groups(x):
    """Nations under the names of their regions."""
    return x.nation.select(F.col("n_nationkey").alias("region_id"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("region_group"))


@query("g7_spatial_quality", _GROUP_HITS + ", s AS (SELECT cell_id, CASE WHEN unit_id IS NULL THEN NULL ELSE lat END AS lat, 'g' || (cell_id % 7) AS stated, CASE WHEN cell_id % 7 = 6 THEN 0 ELSE cell_id % 7 END AS g FROM cells), f AS (SELECT s.*, gh.cell_id IS NOT NULL AS hit, CASE WHEN lat IS NULL THEN 'unavailable' WHEN g = 5 THEN 'boundary_lookup_unavailable' WHEN gh.cell_id IS NOT NULL THEN 'accepted' ELSE 'source_location_mismatch' END AS quality_flag FROM s LEFT JOIN gh ON gh.cell_id = s.cell_id AND n_regionkey = g) SELECT cell_id, quality_flag, CASE quality_flag WHEN 'accepted' THEN true WHEN 'source_location_mismatch' THEN false END AS in_stated_region, CASE quality_flag WHEN 'unavailable' THEN 'no geometry' WHEN 'boundary_lookup_unavailable' THEN 'no boundary for ' || stated WHEN 'accepted' THEN CASE WHEN stated = 'g6' THEN 'older boundary' END ELSE 'centroid outside ' || stated END AS note FROM f")
def _(x):
    regions = Y.dissolve(Y.edges(x.vertices, "region_id"), "region_id", _groups(x), "region_group")
    cells = x.cells.withColumns({"lat": F.when(F.col("unit_id").isNotNull(), F.col("lat")), "stated": F.concat(F.lit("g"), (F.col("cell_id") % 7).cast("string"))})
    out = P.spatial_quality(cells, regions, "cell_id", "region_group", stated="stated", lat="lat", lon="lon", aliases={"g6": "g0"}, notes={"g6": "older boundary"})
    return out.select("cell_id", "quality_flag", "in_stated_region", "note")


#: The blocks' repair: rings cross by all pairs of their few edges, and the hull's order is that of directions from the mean.
_REPAIR = """, be AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM blocks WINDOW w AS (PARTITION BY cell_id, part ORDER BY seq)),
cr AS (SELECT DISTINCT a.cell_id, a.part FROM be a JOIN be b ON a.cell_id = b.cell_id AND a.part = b.part AND a.seq < b.seq
  AND sign((a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x)) * sign((a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x)) < 0
  AND sign((b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x)) * sign((b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x)) < 0),
bad AS (SELECT cell_id, part, cr.cell_id IS NOT NULL OR sum(x * y2 - x2 * y) = 0 AS bad FROM be LEFT JOIN cr USING (cell_id, part) GROUP BY cell_id, part, cr.cell_id),
tu AS (SELECT *, atan2(y - avg(y) OVER (PARTITION BY cell_id, part), x - avg(x) OVER (PARTITION BY cell_id, part)) AS t FROM (SELECT DISTINCT cell_id, part, x, y FROM blocks)),
hu AS (SELECT *, row_number() OVER w - 1 AS seq, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny, coalesce(lag(x) OVER w, last(x) OVER v) AS px, coalesce(lag(y) OVER w, last(y) OVER v) AS py FROM tu WINDOW w AS (PARTITION BY cell_id, part ORDER BY t), v AS (PARTITION BY cell_id, part ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cv AS (SELECT cell_id, part FROM hu GROUP BY 1, 2 HAVING min((x - px) * (ny - y) - (y - py) * (nx - x)) > 0 AND count(*) > 2),
st AS (SELECT cell_id, bool_and(NOT bad OR cv.cell_id IS NOT NULL) AS valid, bool_or(bad AND cv.cell_id IS NOT NULL) AS reordered FROM bad LEFT JOIN cv USING (cell_id, part) GROUP BY 1),
mv AS (SELECT cell_id, part, seq, x, y FROM blocks JOIN bad USING (cell_id, part) WHERE NOT bad UNION ALL SELECT cell_id, part, seq, x, y FROM hu JOIN bad USING (cell_id, part) JOIN cv USING (cell_id, part) WHERE bad),
me AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM mv JOIN st USING (cell_id) WHERE valid WINDOW w AS (PARTITION BY cell_id, part ORDER BY seq)),
mr AS (SELECT cell_id, part, count(*) AS n, abs(sum(radians(x) * 63710088e-4 * sin(radians(y2)) * 63710088e-4 - radians(x2) * 63710088e-4 * sin(radians(y)) * 63710088e-4)) AS a, sum(x * y2 - x2 * y) AS c, sum((x + x2) * (x * y2 - x2 * y)) AS sx, sum((y + y2) * (x * y2 - x2 * y)) AS sy FROM me GROUP BY 1, 2),
mm AS (SELECT cell_id, count(*) AS n_parts, sum(n) AS n_vertices, sum(a) / 2 * 100 AS area_ha, sum(sx * sign(c)) / (3 * sum(abs(c))) AS cx, sum(sy * sign(c)) / (3 * sum(abs(c))) AS cy FROM mr GROUP BY 1)"""


@query("g6_ring_repair", _REPAIR + " SELECT cell_id, valid, reordered, n_parts, CAST(n_vertices AS BIGINT) AS n_vertices, round(area_ha, 1) AS area_ha, round(cx, 3) AS centroid_x, round(cy, 3) AS centroid_y FROM st LEFT JOIN mm USING (cell_id)")
def _(x):
    mended, status = Y.repaired(x.blocks, "cell_id")
    m = Y.polygon_metrics(mended, "cell_id")
    return status.join(m, "cell_id", "left").select("cell_id", "valid", "reordered", "n_parts", "n_vertices", F.round("area_ha", 1).alias("area_ha"), F.round("centroid_x", 3).alias("centroid_x"), F.round("centroid_y", 3).alias("centroid_y"))


@query("g6_crossing_rings", _REPAIR + " SELECT cell_id, part, cr.cell_id IS NOT NULL AS crosses FROM (SELECT DISTINCT cell_id, part FROM blocks) LEFT JOIN cr USING (cell_id, part)")
def _(x):
    crossed = Y.crossing_parts(Y.edges(x.blocks, "cell_id"), "cell_id").withColumn("crosses", F.lit(True))
    return x.blocks.select("cell_id", "part").distinct().join(crossed, ["cell_id", "part"], "left").fillna(False, ["crosses"])


@query("g6_part_metrics", ", r AS (SELECT district_id, part, ring, count(*) AS n, abs(sum(radians(x1) * 63710088e-4 * sin(radians(y2)) * 63710088e-4 - radians(x2) * 63710088e-4 * sin(radians(y1)) * 63710088e-4)) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS a, abs(sum(x1 * y2 - x2 * y1)) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS c, sum((x1 + x2) * (x1 * y2 - x2 * y1)) * sign(sum(x1 * y2 - x2 * y1)) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS sx FROM dedges GROUP BY 1, 2, 3) SELECT district_id, count(DISTINCT part) AS n_parts, CAST(sum(n) AS BIGINT) AS n_vertices, round(sum(a) / 2 * 100, 1) AS area_ha, round(sum(sx) / (3 * sum(c)), 5) AS centroid_x, true AS simple FROM r GROUP BY 1")
def _(x):
    return Y.polygon_metrics(x.districts, "district_id").select("district_id", "n_parts", "n_vertices", F.round("area_ha", 1).alias("area_ha"), F.round("centroid_x", 5).alias("centroid_x"), "simple")


@query("g8_admit_geometry", _REPAIR + f", gc AS (SELECT DISTINCT cell_id, n_regionkey FROM (SELECT c.cell_id, e.region_id FROM mm c CROSS JOIN edges e GROUP BY c.cell_id, c.cx, c.cy, e.region_id HAVING {inside('c.cx', 'c.cy')}) JOIN nation ON region_id = n_nationkey), sa AS (SELECT cell_id, CASE WHEN unit_id IS NULL THEN NULL ELSE cell_id % 3 END AS g, CASE WHEN cell_id % 11 = 0 THEN 0 ELSE round(coalesce(area_ha, 12e3), 3) * (1 + (cell_id % 4) / 4e1) END AS report_ha, round(coalesce(area_ha, 12e3), 3) * (1 - (cell_id % 9) / 1e2) AS notice_ha FROM cells LEFT JOIN mm USING (cell_id)), n AS (SELECT cell_id, count(*) AS given FROM blocks GROUP BY 1) SELECT cell_id, CAST(n_vertices AS BIGINT) AS n_vertices, round(area_ha, 1) AS area_ha, reordered, CASE WHEN given < 3 THEN 'too_few_vertices' WHEN NOT valid THEN 'invalid_ring' WHEN g IS NULL THEN 'no_stated_region' WHEN NOT EXISTS (SELECT 1 FROM gc WHERE gc.cell_id = sa.cell_id AND n_regionkey = g) THEN 'outside_region' WHEN report_ha <= 0 THEN 'area_missing' WHEN abs(area_ha - report_ha) / report_ha * 100 > 5 OR abs(area_ha - notice_ha) / notice_ha * 100 > 5 THEN 'area_differs' ELSE 'admitted' END AS reason FROM sa JOIN st USING (cell_id) JOIN n USING (cell_id) LEFT JOIN mm USING (cell_id)")
def _(x):
    regions = Y.dissolve(Y.edges(x.vertices, "region_id"), "region_id", _groups(x), "region_group")
    mended, _ = Y.repaired(x.blocks, "cell_id")
    base = F.round(F.coalesce("area_ha", F.lit(12e3)), 3)
    stated = x.cells.join(Y.polygon_metrics(mended, "cell_id"), "cell_id", "left").select("cell_id", F.when(F.col("unit_id").isNotNull(), F.concat(F.lit("g"), (F.col("cell_id") % 3).cast("string"))).alias("region_group"), F.when(F.col("cell_id") % 11 == 0, 0.0).otherwise(base * (1 + F.col("cell_id") % 4 / 4e1)).alias("report_ha"), (base * (1 - F.col("cell_id") % 9 / 1e2)).alias("notice_ha"))
    return P.admit_geometry(x.blocks, stated, regions, "cell_id", "region_group", areas=["report_ha", "notice_ha"]).withColumn("area_ha", F.round("area_ha", 1))


@query("g9_dissolve", _GROUP_HITS + " SELECT cell_id, 'g' || n_regionkey AS region_group FROM gh")
def _(x):
    """Containment in the union of a group's polygons is containment in any of them; the SQL knows the members only."""
    union = Y.dissolve(Y.edges(x.vertices, "region_id"), "region_id", _groups(x), "region_group")
    return P.containing(x.cells, union, ["cell_id"], "region_group", boundary="half_open")


@query("g9_dissolve_parts", f", h AS (SELECT c.cell_id, e.district_id FROM cells c CROSS JOIN dedges e GROUP BY c.cell_id, c.lat, c.lon, e.district_id, e.part HAVING {inside('c.lon', 'c.lat')}) SELECT DISTINCT cell_id, n_regionkey AS region_group FROM h JOIN nation ON district_id = n_nationkey")
def _(x):
    """The same for districts with holes and second parts, all of a region's districts overlapping one another."""
    members = x.nation.select(F.col("n_nationkey").alias("district_id"), F.col("n_regionkey").alias("region_group"))
    union = Y.dissolve(Y.edges(x.districts, "district_id"), "district_id", members, "region_group")
    return P.containing(x.cells, union, ["cell_id"], "region_group", boundary="half_open")


#: The inverse transverse Mercator series on the WGS84 ellipsoid, step by step.
_UTM_SQL = """, u AS (SELECT p_partkey, 300000e0 + p_partkey % 400000 AS east, 1000000e0 + p_partkey * 37 % 2500000 AS north, 6378137e0 AS a, 1 / 298257223563e-9 AS f FROM part),
u1 AS (SELECT *, f * (2 - f) AS e2 FROM u), u2 AS (SELECT *, e2 / (1 - e2) AS ep, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) AS e1, north / 9996e-4 / (a * (1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256)) AS mu FROM u1),
u3 AS (SELECT *, mu + (3 * e1 / 2 - 27 * pow(e1, 3) / 32) * sin(2 * mu) + (21 * pow(e1, 2) / 16 - 55 * pow(e1, 4) / 32) * sin(4 * mu) + 151 * pow(e1, 3) / 96 * sin(6 * mu) + 1097 * pow(e1, 4) / 512 * sin(8 * mu) AS phi FROM u2),
u4 AS (SELECT *, ep * pow(cos(phi), 2) AS c1, pow(tan(phi), 2) AS t1, a / sqrt(1 - e2 * pow(sin(phi), 2)) AS n1, a * (1 - e2) / pow(1 - e2 * pow(sin(phi), 2), 15e-1) AS r1 FROM u3), u5 AS (SELECT *, (east - 500000) / (n1 * 9996e-4) AS d FROM u4)
SELECT p_partkey, round(degrees(phi - n1 * tan(phi) / r1 * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep) * pow(d, 4) / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep - 3 * c1 * c1) * pow(d, 6) / 720)), 6) AS lat,
round(degrees((d - (1 + 2 * t1 + c1) * pow(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep + 24 * t1 * t1) * pow(d, 5) / 120) / cos(phi)) + 44 * 6 - 183, 6) AS lon FROM u5"""


@query("g10_utm_to_wgs84", _UTM_SQL)
def _(x):
    k = F.col("p_partkey")
    lat, lon = G.utm_to_wgs84(F.lit(44), 300000.0 + k % 400000, 1000000.0 + k * 37 % 2500000)
    return x.part.select("p_partkey", r6(lat).alias("lat"), r6(lon).alias("lon"))


@query("g11_valid_cell", "SELECT site_id, site_id % 3 <> 1 AS valid FROM sites")
def _(x):
    cell = G.cell_of(F.col("lat"), F.col("lon"), RES)
    broken = F.when(F.col("site_id") % 3 == 1, cell + (1 << 40)).otherwise(cell)
    return x.sites.select("site_id", G.valid_cell(broken, RES).alias("valid"))


@query("g12_representative_point", ", m AS (SELECT region_id, (min(y1) + max(y1)) / 2 AS mid FROM edges GROUP BY 1), k AS (SELECT region_id, mid, (x2 - x1) * (mid - y1) / (y2 - y1) + x1 AS cut FROM edges JOIN m USING (region_id) WHERE (y1 > mid) <> (y2 > mid)) SELECT region_id, round((min(cut) + max(cut)) / 2, 6) AS x, round(any_value(mid), 6) AS y FROM k GROUP BY 1")
def _(x):
    return Y.representative_point(x.vertices, "region_id").select("region_id", r6("x").alias("x"), r6("y").alias("y"))


# --- rasters ---------------------------------------------------------------------------------

_PIX = ", pt AS (SELECT cell_id, lat, lon, CAST(floor((38 - lat) / 25e-2) AS BIGINT) AS pr, CAST(floor((lon - 68) / 25e-2) AS BIGINT) AS pc FROM cells), ok AS (SELECT row, col, CASE WHEN value <> -999 THEN value END AS value FROM raster), nine AS (SELECT cell_id, lat, dr.range - 1 AS dr, dc.range - 1 AS dc, value FROM pt CROSS JOIN range(3) dr CROSS JOIN range(3) dc LEFT JOIN ok ON row = pr + dr.range - 1 AND col = pc + dc.range - 1)"


@query("r1_sample", _PIX + f" SELECT cell_id, value, round({haversine('lat', 'lon', '(38 - (pr + 5e-1) * 25e-2)', '(68 + (pc + 5e-1) * 25e-2)')}, 6) AS centre_km FROM pt LEFT JOIN ok ON row = pr AND col = pc")
def _(x):
    return A.sample(x.cells, x.raster, GRID).select("cell_id", "value", r6("centre_km").alias("centre_km"))


@query("r2_focal_stats", _PIX + " SELECT cell_id, round(avg(value), 6) AS focal_mean, round(stddev_pop(value), 6) AS focal_std, max(value) - min(value) AS focal_range, count(value) AS focal_n FROM nine GROUP BY 1")
def _(x):
    out = A.focal_stats(x.cells, x.raster, GRID, ["cell_id"])
    return out.withColumns({"focal_mean": r6("focal_mean"), "focal_std": r6("focal_std")})


@query("r3_terrain", _PIX + ", f AS (SELECT cell_id, any_value(lat) AS lat, max(value) FILTER (dr = 0 AND dc = 0) AS elevation, max(value) FILTER (dr = 0 AND dc = 1) AS e, max(value) FILTER (dr = 0 AND dc = -1) AS w, max(value) FILTER (dr = -1 AND dc = 0) AS n, max(value) FILTER (dr = 1 AND dc = 0) AS s, max(value) - min(value) AS relief FROM nine GROUP BY 1) SELECT cell_id, elevation, round(degrees(atan(sqrt(pow((e - w) / (2 * 2783e1 * greatest(cos(radians(lat)), 1e-2)), 2) + pow((n - s) / (2 * 2783e1), 2)))), 6) AS slope_deg, relief FROM f")
def _(x):
    return A.terrain(x.cells, x.raster, GRID, ["cell_id"]).withColumn("slope_deg", r6("slope_deg"))


@query("r4_assert_aligned", "SELECT o_orderpriority AS raster_id, 68e0 AS west, 38e0 AS north, 25e-2 AS size FROM orders GROUP BY 1")
def _(x):
    rasters = x.orders.groupBy(F.col("o_orderpriority").alias("raster_id")).agg(F.max(F.lit(68.0)).alias("west"), F.max(F.lit(38.0)).alias("north"), F.max(F.lit(0.25)).alias("size"))
    return A.assert_aligned(rasters)


@query("r5_multi_layer_sample", _PIX + " SELECT cell_id, value / 10 AS sand, value * 2 / 5 AS clay FROM pt LEFT JOIN ok ON row = pr AND col = pc")
def _(x):
    layers = x.raster.withColumn("layer", F.lit("sand")).unionByName(x.raster.withColumns({"layer": F.lit("clay"), "value": F.when(F.col("value") != -999, F.col("value") * 2).otherwise(F.col("value"))}))
    return A.multi_layer_sample(x.cells, layers, GRID, ["cell_id"], ["sand", "clay"], {"sand": 10.0, "clay": 5.0})


@query("r6_rasterize_lookup", f", pt AS (SELECT cell_id, CAST(floor((38 - lat) / 25e-2) AS BIGINT) AS pr, CAST(floor((lon - 68) / 25e-2) AS BIGINT) AS pc FROM cells), c AS (SELECT DISTINCT pr, pc, 38 - (pr + 5e-1) * 25e-2 AS lat, 68 + (pc + 5e-1) * 25e-2 AS lon FROM pt), h AS (SELECT pr, pc, region_id FROM c CROSS JOIN edges e GROUP BY pr, pc, c.lat, c.lon, region_id HAVING {inside('c.lon', 'c.lat')}), b AS (SELECT pr, pc, min(region_id) AS r FROM h GROUP BY 1, 2) SELECT cell_id, r AS region_id FROM pt LEFT JOIN b USING (pr, pc)")
def _(x):
    areas = x.nation.select(F.col("n_nationkey").alias("region_id"), F.lit(1.0).alias("area_ha"))  # equal areas: the smaller key wins
    return A.rasterize_lookup(x.cells, x.vertices, "region_id", areas, GRID, ["cell_id"]).select("cell_id", "region_id")


@query("r6_rasterize_parts", f", pt AS (SELECT cell_id, CAST(floor((38 - lat) / 25e-2) AS BIGINT) AS pr, CAST(floor((lon - 68) / 25e-2) AS BIGINT) AS pc FROM cells), c AS (SELECT DISTINCT pr, pc, 38 - (pr + 5e-1) * 25e-2 AS lat, 68 + (pc + 5e-1) * 25e-2 AS lon FROM pt), h AS (SELECT pr, pc, district_id FROM c CROSS JOIN dedges e GROUP BY pr, pc, c.lat, c.lon, district_id, part HAVING {inside('c.lon', 'c.lat')}), b AS (SELECT pr, pc, arg_min(district_id, (district_id * 7 % 25) * 100 + district_id) AS r FROM h GROUP BY 1, 2) SELECT cell_id, r AS district_id FROM pt LEFT JOIN b USING (pr, pc)")
def _(x):
    areas = x.nation.select(F.col("n_nationkey").alias("district_id"), (F.col("n_nationkey") * 7 % 25).cast("double").alias("area_ha"))
    return A.rasterize_lookup(x.cells, x.districts, "district_id", areas, GRID, ["cell_id"]).select("cell_id", "district_id")


@query("r6_rasterize", f", c AS (SELECT r.range AS row, c.range AS col, 38 - (r.range + 5e-1) * 25e-2 AS lat, 68 + (c.range + 5e-1) * 25e-2 AS lon FROM range(-8, 160) r, range(-8, 160) c) SELECT district_id, row, count(DISTINCT col) AS n_pixels FROM (SELECT district_id, row, col FROM c CROSS JOIN dedges e GROUP BY district_id, part, row, col, c.lat, c.lon HAVING {inside('c.lon', 'c.lat')}) GROUP BY 1, 2")
def _(x):
    runs = A.rasterize(x.districts, "district_id", GRID)
    pixels = runs.select("district_id", "row", F.explode(F.sequence("first", "last")).alias("col"))
    return pixels.groupBy("district_id", "row").agg(F.count_distinct("col").alias("n_pixels"))


@query("r7_source_code_label", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'Missing source code' ELSE coalesce(n_name, 'Unknown source code') END AS label, coalesce(CASE WHEN p_size % 10 > 0 THEN p_size END IN (20, 21), false) AS is_native, CASE WHEN p_size % 10 = 0 THEN true ELSE p_size IN (30, 31) END AS is_ambiguous FROM part LEFT JOIN nation ON n_nationkey = p_size")
def _(x):
    parts = x.part.select("p_partkey", F.when(F.col("p_size") % 10 > 0, F.col("p_size")).cast("long").alias("code"))
    labels = x.nation.select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("label"))
    return A.code_label(parts, "code", labels, [20, 21], [30, 31]).drop("code")


@query("r8_scene_coverage", _WITHIN + " SELECT region_id, coalesce(n, 0) AS n_points FROM (SELECT DISTINCT region_id FROM vertices) LEFT JOIN (SELECT region_id, count(*) AS n FROM hit GROUP BY 1) USING (region_id)")
def _(x):
    return A.scene_coverage(x.vertices, "region_id", x.cells, "cell_id")


@query("r8_coverage_parts", _PART_HITS + " SELECT district_id, count(cell_id) AS n_points FROM (SELECT DISTINCT district_id FROM districts) LEFT JOIN ph USING (district_id) GROUP BY 1")
def _(x):
    return A.scene_coverage(x.districts, "district_id", x.cells, "cell_id")


@query("r9_radiometric_scale", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_partkey % 7 > 0 THEN (l_partkey - 1000 + s_nationkey) / 1e4 END, 6) AS reflectance FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def _(x):
    obs = x.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("scene"), F.when(F.col("l_partkey") % 7 > 0, F.col("l_partkey")).otherwise(0).alias("dn"))
    constants = x.supplier.select(F.col("s_suppkey").alias("scene"), (F.col("s_nationkey") - 1000).alias("offset"), F.lit(1e4).alias("quantification"))
    return A.radiometric_scale(obs, constants, ["scene"]).select("l_orderkey", "l_linenumber", r6("reflectance").alias("reflectance"))


@query("r10_scene_manifest", "SELECT o_orderkey AS scene, o_orderpriority AS tile, o_totalprice AS cloud, count(l_linenumber) AS n_points FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 GROUP BY 1, 2, 3")
def _(x):
    selected = x.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("scene"), F.struct(F.col("o_orderpriority").alias("tile"), F.col("o_totalprice").alias("cloud")).alias("properties"))
    stats = x.lineitem.groupBy(F.col("l_orderkey").alias("scene")).agg(F.count("*").alias("n_points"))
    return A.scene_manifest(selected, stats, "scene", "properties").fillna(0, ["n_points"])


@query("r11_scene_ids_by_cell", "SELECT l_suppkey AS cell, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS scene_ids FROM lineitem GROUP BY 1")
def _(x):
    obs = x.lineitem.select(F.col("l_suppkey").alias("cell"), F.col("l_orderkey").alias("scene"))
    return A.scene_ids_by_cell(obs, "cell", "scene").withColumn("scene_ids", F.array_join(F.col("scene_ids").cast("array<string>"), ","))


# --- scores -----------------------------------------------------------------------------------

_KM = haversine("c.lat", "c.lon", "s.lat", "s.lon")
_SCORES = (
    _AFFINITY
    + f", n AS (SELECT material_id, count(*) AS n FROM sites GROUP BY 1), d AS (SELECT c.cell_id, c.unit_id, s.material_id, min({_KM}) AS km, count(*) FILTER ({_KM} <= 100) AS dens FROM cells c CROSS JOIN sites s GROUP BY ALL)"
    ", sc AS (SELECT *, greatest(quantile_cont(dens, 95e-2) OVER (PARTITION BY material_id), 1e0) AS scale FROM d)"
    ", fin AS (SELECT sc.cell_id, sc.material_id, n, km, least(1e0, greatest(0e0, (CASE WHEN n >= 5 THEN 5e-1 * coalesce(affinity, 0) + 35e-2 * exp(-km / 100) + 15e-2 * least(1e0, dens / scale) ELSE 8e-1 * exp(-km / 100) + 2e-1 * least(1e0, dens / scale) END) * (4e-1 + 6e-1 * least(1e0, ln(1 + n) / ln(21))))) AS score FROM sc JOIN n USING (material_id) LEFT JOIN aff ON aff.material_id = sc.material_id AND aff.unit_id = sc.unit_id)"
)
_SCORES = _SCORES.replace("quantile_cont(dens, 95e-2)", "quantile_cont(CAST(dens AS DOUBLE), 95e-2)")


def _scores(x, ranked=True):
    return M.score_cells(x.cells, x.sites, x.materials, ranked=ranked)


_RANKED = ", el AS (SELECT *, CASE WHEN n >= 5 AND km > 10 AND score IS NOT NULL THEN 1 ELSE 0 END AS ok FROM fin), pr AS (SELECT *, CASE WHEN ok = 1 THEN (rank() OVER (PARTITION BY material_id, ok ORDER BY score) + (count(*) OVER (PARTITION BY material_id, ok, score) - 1) / 2e0) / count(*) OVER (PARTITION BY material_id, ok) END AS percentile FROM el)"


@query("m1_score_cells", _SCORES + _RANKED + " SELECT cell_id, material_id, n AS n_evidence, round(km, 6) AS nearest_km, round(score, 6) AS score, round(percentile, 6) AS percentile, CASE WHEN n >= 20 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS support_level FROM pr")
def _(x):
    return _scores(x).select("cell_id", "material_id", "n_evidence", r6("nearest_km").alias("nearest_km"), r6("score").alias("score"), r6("percentile").alias("percentile"), "support_level")


@query("w2_top_k_per_row", _SCORES + ", k AS (SELECT cell_id, material_id, round(score, 6) AS score, row_number() OVER (PARTITION BY cell_id ORDER BY round(score, 6) DESC, material_id) AS n FROM fin) SELECT cell_id, array_to_string(list(material_id ORDER BY n) FILTER (n <= 5), ',') AS top_materials, max(material_id) FILTER (n = 1) AS top_material, max(score) FILTER (n = 1) AS top_score FROM k GROUP BY 1")
def _(x):
    scores = _scores(x, ranked=False).withColumn("score", r6("score"))
    top = R.top_k_per_row(scores, "cell_id", [F.desc("score"), F.col("material_id")], ["material_id", "score", "nearest_km"])
    return top.select("cell_id", F.array_join(F.col("top_material_ids").cast("array<string>"), ",").alias("top_materials"), F.col("top_material_id").alias("top_material"), "top_score")


def _hash_sql(i: str, seed: str) -> str:
    return f"((({i}) % {M.MODULUS} * {M.FACTOR_ID} + ({seed}) % 30000 * {M.FACTOR_SEED} + 12345) % {M.MODULUS} * {M.FACTOR_ID} + 11) % {M.MODULUS}"


@query("m2_sample_background", f"SELECT cell_id FROM cells WHERE unit_id IS NOT NULL ORDER BY {_hash_sql('cell_id', '42')}, cell_id LIMIT 500")
def _(x):
    return M.sample_background(x.cells.where("unit_id is not null"), "cell_id", 42, M.background_size(F.lit(10))).select("cell_id")


def _folded(x):
    return M.group_kfold(x.sites.select("site_id", "material_id", "unit_id", "lat", "lon"), "unit_id", 5, ["material_id"])


def _greedy_sql(rows: str, by: str, group: str, label: str, tie: str) -> str:
    """Folds of whole groups in SQL: one recursion step a group, then each class of like groups hands its places to the folds in turn."""
    return f""", gs AS (SELECT {by} AS b, {group} AS g, count(*) AS n, coalesce(sum({label}), 0) AS p FROM {rows} GROUP BY ALL),
it AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p DESC, n DESC, {tie}, g) AS i, row_number() OVER (PARTITION BY b, p, n ORDER BY {tie}, g) - 1 AS place, least(5, count(*) OVER (PARTITION BY b)) AS k FROM gs),
gr AS (SELECT b, 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS pl, [0, 0, 0, 0, 0]::BIGINT[] AS nl, 0::BIGINT AS fold FROM it GROUP BY b
  UNION ALL SELECT b, i, list_transform(pl, lambda x, j: x + CASE WHEN j = f + 1 THEN p ELSE 0 END)::BIGINT[], list_transform(nl, lambda x, j: x + CASE WHEN j = f + 1 THEN n ELSE 0 END)::BIGINT[], f
  FROM (SELECT it.b, it.i, p, n, pl, nl, list_sort(list_transform(range(k), lambda f: {{'p': CASE WHEN p > 0 THEN pl[f + 1] ELSE 0 END, 'n': nl[f + 1], 'f': f}}))[1].f AS f FROM gr JOIN it ON it.b = gr.b AND it.i = gr.i + 1)),
tk AS (SELECT b, p, n, fold, count(*) AS t FROM gr JOIN it USING (b, i) GROUP BY ALL),
rg AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY b, p, n ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM tk),
fd AS (SELECT it.b, it.g, rg.fold FROM it JOIN rg ON it.b = rg.b AND it.p = rg.p AND it.n = rg.n AND place >= a AND place < a + t)"""


@query("m3_group_kfold", _greedy_sql("sites", "material_id", "unit_id", "0", "0") + " SELECT site_id, material_id, unit_id, CAST(fold AS INTEGER) AS fold FROM sites JOIN fd ON b = material_id AND g = unit_id")
def _(x):
    return M.group_kfold(x.sites.select("site_id", "material_id", "unit_id"), "unit_id", 5, ["material_id"]).select("site_id", "material_id", "unit_id", "fold")


@query("m4_stratified_group_kfold", _greedy_sql("(SELECT *, CASE WHEN site_id % 4 = 0 THEN 1 ELSE 0 END AS y FROM sites)", "material_id % 2", "unit_id", "y", "md5('7|' || g)") + " SELECT site_id, unit_id, CASE WHEN site_id % 4 = 0 THEN 1 ELSE 0 END AS label, CAST(fold AS INTEGER) AS fold FROM sites JOIN fd ON b = material_id % 2 AND g = unit_id")
def _(x):
    rows = x.sites.select("site_id", "unit_id", (F.col("material_id") % 2).alias("half"), (F.col("site_id") % 4 == 0).cast("int").alias("label"))
    return M.group_kfold(rows, "unit_id", 5, ["half"], "label", 7).select("site_id", "unit_id", "label", "fold")


_FOLD = ", sf AS (SELECT *, (site_id // 12) % 3 AS fold FROM sites)"


def _training(x):
    """Evidence of each fold's training side."""
    return M.fold_statistics(x.sites.withColumn("fold", (F.floor(F.col("site_id") / 12) % 3).cast("int")), "fold", 3)


@query("m5_fold_features", _FOLD + f", p AS (SELECT f.range AS train_fold, c.site_id, min({_KM}) FILTER (s.site_id IS NOT NULL) AS km, count(s.site_id) FILTER ({_KM} <= 100) AS n FROM sf c CROSS JOIN range(3) f LEFT JOIN sf s ON s.material_id = c.material_id AND s.fold <> f.range AND s.site_id <> c.site_id GROUP BY 1, 2) SELECT CAST(train_fold AS INTEGER) AS train_fold, site_id, round(ln(1 + km), 6) AS log_distance, round(ln(1 + n), 6) AS log_density FROM p")
def _(x):
    train = _training(x)
    rows = x.sites.withColumn("train_fold", F.explode(F.sequence(F.lit(0), F.lit(2))))
    by = ["train_fold", "material_id"]
    near = P.nearest_other(rows, train, ["train_fold", "site_id"], self_id="site_id", ref_id="site_id", by=by)
    out = P.count_within(near, train, ["train_fold", "site_id"], 100.0, ref_id="site_id", by=by, exclude_same=("site_id", "site_id"))
    return out.select("train_fold", "site_id", r6(F.log1p("nearest_km")).alias("log_distance"), r6(F.log1p("n_within")).alias("log_density"))


_CV = (
    _FOLD
    + f", tr AS (SELECT f.range AS tf, sf.* FROM sf, range(3) f WHERE sf.fold <> f.range), n AS (SELECT tf, material_id, count(*) AS n FROM tr GROUP BY 1, 2), pos AS (SELECT tf, material_id, unit_id, count(*) AS p FROM tr GROUP BY ALL), tot AS (SELECT unit_id, count(*) AS t FROM cells WHERE unit_id IS NOT NULL GROUP BY 1), raw AS (SELECT tf, material_id, unit_id, (p + 5e-1) / (coalesce(t, 0) + 5) AS raw FROM pos LEFT JOIN tot USING (unit_id)), aff AS (SELECT tf, material_id, unit_id, least(1e0, raw / greatest(quantile_cont(raw, 95e-2) OVER (PARTITION BY tf, material_id), 1e-9)) AS affinity FROM raw)"
    f", d AS (SELECT s.tf, c.cell_id, c.unit_id, s.material_id, min({_KM}) AS km, CAST(count(*) FILTER ({_KM} <= 100) AS DOUBLE) AS dens FROM cells c CROSS JOIN tr s GROUP BY ALL), sc AS (SELECT *, greatest(quantile_cont(dens, 95e-2) OVER (PARTITION BY tf, material_id), 1e0) AS scale FROM d)"
    " SELECT CAST(sc.tf AS INTEGER) AS train_fold, sc.cell_id, sc.material_id, round(least(1e0, greatest(0e0, (CASE WHEN n >= 5 THEN 5e-1 * coalesce(affinity, 0) + 35e-2 * exp(-km / 100) + 15e-2 * least(1e0, dens / scale) ELSE 8e-1 * exp(-km / 100) + 2e-1 * least(1e0, dens / scale) END) * (4e-1 + 6e-1 * least(1e0, ln(1 + n) / ln(21))))), 6) AS score FROM sc JOIN n USING (tf, material_id) LEFT JOIN aff ON aff.tf = sc.tf AND aff.material_id = sc.material_id AND aff.unit_id = sc.unit_id"
)


@query("m6_cv_score", _CV)
def _(x):
    cells = x.cells.withColumn("train_fold", F.explode(F.sequence(F.lit(0), F.lit(2))))
    out = M.score_cells(cells, _training(x).select("train_fold", "site_id", "material_id", "unit_id", "lat", "lon"), x.materials, part=["train_fold"], ranked=False)
    return out.select("train_fold", "cell_id", "material_id", r6("score").alias("score"))


def _labelled(x):
    """Rows with a score full of ties and a label, per material."""
    return x.sites.select("site_id", "material_id", "unit_id", (F.col("site_id") * 37 % 101).cast("double").alias("s"), ((F.floor(F.col("site_id") / 12) % 4 == 0) | (F.col("site_id") * 37 % 101 > 90)).cast("int").alias("y"))


_LAB = ", lab AS (SELECT site_id, material_id, unit_id, CAST(site_id * 37 % 101 AS DOUBLE) AS s, CASE WHEN (site_id // 12) % 4 = 0 OR site_id * 37 % 101 > 90 THEN 1 ELSE 0 END AS y FROM sites)"


@query("m7_roc_auc", _LAB + " SELECT a.material_id, round(avg(CASE WHEN a.s > b.s THEN 1e0 WHEN a.s = b.s THEN 5e-1 ELSE 0 END), 6) AS auc FROM lab a JOIN lab b ON a.material_id = b.material_id AND a.y = 1 AND b.y = 0 GROUP BY 1")
def _(x):
    return M.roc_auc(_labelled(x), ["material_id"], "s", "y").where("auc is not null").withColumn("auc", r6("auc"))


@query("m8_average_precision", _LAB + ", t AS (SELECT material_id, s, sum(y) AS p, count(*) AS c FROM lab GROUP BY 1, 2), k AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS m, sum(p) OVER (PARTITION BY material_id) AS allp FROM t WINDOW w AS (PARTITION BY material_id ORDER BY s DESC)) SELECT material_id, round(sum(CAST(p AS DOUBLE) * tp / m) / max(allp), 6) AS average_precision FROM k GROUP BY 1")
def _(x):
    return M.average_precision(_labelled(x), ["material_id"], "s", "y").withColumn("average_precision", r6("average_precision"))


@query("m9_recall_at_background_top", _LAB + ", b AS (SELECT material_id, quantile_cont(s, 95e-2) AS cut FROM lab WHERE y = 0 GROUP BY 1) SELECT material_id, round(avg(CASE WHEN s >= cut THEN 1e0 ELSE 0 END), 6) AS recall FROM lab JOIN b USING (material_id) WHERE y = 1 GROUP BY 1")
def _(x):
    return M.recall_at_background_top(_labelled(x), ["material_id"], "s", "y").withColumn("recall", r6("recall"))


@query("m10_brier", _LAB + " SELECT material_id, round(avg(pow(s / 101 - y, 2)), 6) AS brier FROM lab GROUP BY 1")
def _(x):
    return M.brier(_labelled(x).withColumn("p", F.col("s") / 101), ["material_id"], "p", "y").withColumn("brier", r6("brier"))


def _feature_rows(x):
    rows = _labelled(x).withColumns({"f1": F.when(F.col("site_id") % 11 > 0, F.col("s") + F.col("site_id") % 7), "f2": (F.col("site_id") * 53 % 89).cast("double"), "held": F.floor(F.col("site_id") / 12) % 3 == 0})
    return rows


def _newton_sql(by: str, steps: int) -> str:
    """Weights of each group of zt (by, z of four numbers, y, v) by coordinate Newton steps, as a recursive table; rows with test are left out."""
    return f""", gw AS (SELECT {by}, 0 AS i, [0e0, 0e0, 0e0, 0e0] AS w FROM zt WHERE NOT test GROUP BY ALL
  UNION ALL SELECT {by}, i + 1, list_transform(w, lambda a, j: CASE WHEN j = i % 4 + 1 THEN a - (g + a) / (h + 1) ELSE a END)
  FROM (SELECT {', '.join('gw.' + b.strip() for b in by.split(','))}, gw.i, any_value(w) AS w, sum(v * (1 / (1 + exp(-list_inner_product(w, z))) - y) * z[gw.i % 4 + 1]) AS g, sum(v / (1 + exp(-list_inner_product(w, z))) * (1 - 1 / (1 + exp(-list_inner_product(w, z)))) * pow(z[gw.i % 4 + 1], 2)) AS h FROM gw JOIN zt USING ({by}) WHERE NOT test AND gw.i < {steps} GROUP BY ALL))"""


def _design_sql(by: str, rows: str, first: str) -> str:
    """zt: design rows of two features, f1 (first: whether it takes part) and f2, from the training rows of each group."""
    return f""", st AS (SELECT {by}, avg(y) AS share, quantile_cont(f1, 5e-2) AS l1, quantile_cont(f1, 5e-1) AS m1, quantile_cont(f1, 95e-2) AS h1, quantile_cont(f2, 5e-2) AS l2, quantile_cont(f2, 5e-1) AS m2, quantile_cont(f2, 95e-2) AS h2 FROM {rows} WHERE NOT test GROUP BY ALL HAVING avg(y) > 0 AND avg(y) < 1),
zt AS (SELECT {by}, site_id, unit_id, test, y, CASE WHEN y = 1 THEN 5e-1 / share ELSE 5e-1 / (1 - share) END AS v, [1e0, CASE WHEN {first} AND f1 IS NOT NULL AND m1 IS NOT NULL THEN greatest(-10, least(10, (f1 - m1) / CASE WHEN h1 > l1 THEN h1 - l1 ELSE 1 END)) ELSE 0 END, greatest(-10, least(10, (f2 - m2) / CASE WHEN h2 > l2 THEN h2 - l2 ELSE 1 END)), CASE WHEN {first} AND f1 IS NULL THEN 1 ELSE 0 END]::DOUBLE[] AS z FROM {rows} JOIN st USING ({by}))"""


_FEATURES = _LAB + ", fr AS (SELECT site_id, material_id, unit_id, y, CASE WHEN site_id % 11 > 0 THEN s + site_id % 7 END AS f1, CAST(site_id * 53 % 89 AS DOUBLE) AS f2, (site_id // 12) % 3 AS fold FROM lab)"


@query("m11_fit_logistic", _FEATURES + ", fh AS (SELECT *, fold = 0 AS test FROM fr)" + _design_sql("material_id", "fh", "true") + _newton_sql("material_id", 400) + " SELECT fh.material_id, fh.site_id, round(CASE WHEN w IS NOT NULL THEN 1 / (1 + exp(-list_inner_product(w, z))) END, 4) AS probability FROM fh LEFT JOIN zt USING (material_id, site_id) LEFT JOIN gw ON gw.material_id = fh.material_id AND i = 400 WHERE fh.test")
def _(x):
    return M.fit_logistic(_feature_rows(x), ["material_id"], "site_id", ["f1", "f2"], "y", "held").withColumn("probability", F.round("probability", 4))


@query("m11_gradient", _LAB + ", n AS (SELECT material_id, avg(y) AS share FROM lab WHERE (site_id // 12) % 3 <> 0 GROUP BY 1 HAVING avg(y) > 0 AND avg(y) < 1) SELECT material_id, true AS stationary FROM n")
def _(x):
    """The loss is stationary at the weights of every group that has both classes."""
    from ..operators.logistic import design, fit_weights

    rows = design(_feature_rows(x), ["material_id"], ["f1", "f2"], "held").where("not held")
    return fit_weights(rows, ["material_id"], "y", 5).select("material_id", (F.col("gradient_norm") < 1e-6).alias("stationary"))


@query("m12_fill_from_training", ", r AS (SELECT site_id, material_id, CASE WHEN site_id % 11 > 0 THEN CAST(site_id * 37 % 101 AS DOUBLE) + site_id % 7 END AS f1 FROM sites), m AS (SELECT material_id, quantile_cont(f1, 5e-1) AS m FROM r WHERE (site_id // 12) % 3 <> 0 GROUP BY 1) SELECT site_id, coalesce(f1, m) AS f1 FROM r LEFT JOIN m USING (material_id) WHERE (site_id // 12) % 3 = 0")
def _(x):
    rows = _feature_rows(x)
    return M.fill_from_training(rows.where("not held"), rows.where("held"), ["material_id"], ["f1"]).select("site_id", "f1")


def _paired_sql(rows: str, by: str, reps: int, seed: str) -> str:
    """pd: interval of the gain of AUC from a to b over shared draws of groups; rows hold (by, unit_id, y, a, b)."""
    return f""", kg AS (SELECT {by}, unit_id, max(y) AS kind FROM {rows} GROUP BY ALL),
kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}, kind ORDER BY unit_id) - 1 AS g, count(*) OVER (PARTITION BY {by}, kind) AS m, sum(kind) OVER (PARTITION BY {by}) AS pos, count(*) OVER (PARTITION BY {by}) AS alln FROM kg) WHERE pos >= 3 AND alln > pos),
kd AS (SELECT {by}, kind, r.range AS rep, ({_hash_sql('g * 7919 + r.range * 104729 + kind', seed)}) % m AS g FROM kp CROSS JOIN range({reps}) r),
kw AS (SELECT {by}, unit_id, rep, count(*) AS times FROM kd JOIN kp USING ({by}, kind, g) GROUP BY ALL),
kl AS (SELECT {by}, rep, arm.range AS arm, CASE WHEN arm.range = 0 THEN a ELSE b END AS s, sum(CASE WHEN y = 1 THEN times ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN times ELSE 0 END) AS n FROM {rows} JOIN kw USING ({by}, unit_id) CROSS JOIN range(2) arm GROUP BY ALL),
kb AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by}, rep, arm ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM kl),
ka AS (SELECT {by}, rep, arm, CAST(sum(p * (below + n / 2e0)) AS DOUBLE) / nullif(CAST(sum(p) * sum(n) AS DOUBLE), 0) AS auc FROM kb GROUP BY ALL),
ke AS (SELECT {by}, rep, max(auc) FILTER (arm = 1) - max(auc) FILTER (arm = 0) AS d FROM ka GROUP BY ALL),
pd AS (SELECT {by}, quantile_cont(d, 25e-3) AS delta_low, quantile_cont(d, 975e-3) AS delta_high, count(d) AS valid FROM ke GROUP BY ALL)"""


def _metrics_sql(name: str, score: str, digits: int = 4) -> str:
    """Tables {name}_m: AUC, average precision, recall at the background's top and Brier score of oof's column for each material."""
    return f""", {name}_t AS (SELECT material_id, {score} AS s, sum(y) AS p, count(*) AS c FROM oof GROUP BY 1, 2), {name}_k AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS m, coalesce(sum(c - p) OVER (PARTITION BY material_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}_t WINDOW w AS (PARTITION BY material_id ORDER BY s DESC)),
{name}_a AS (SELECT material_id, CAST(sum(p * (below + (c - p) / 2e0)) AS DOUBLE) / nullif(CAST(sum(p) * sum(c - p) AS DOUBLE), 0) AS auc, sum(CAST(p AS DOUBLE) * tp / m) / nullif(sum(p), 0) AS ap FROM {name}_k GROUP BY 1),
{name}_c AS (SELECT material_id, quantile_cont({score}, 95e-2) AS cut FROM oof WHERE y = 0 GROUP BY 1), {name}_r AS (SELECT material_id, avg(CASE WHEN {score} >= cut THEN 1e0 ELSE 0 END) AS recall FROM oof JOIN {name}_c USING (material_id) WHERE y = 1 GROUP BY 1), {name}_b AS (SELECT material_id, avg(pow({score} - y, 2)) AS brier FROM oof GROUP BY 1),
{name}_m AS (SELECT material_id, auc, ap AS average_precision, recall, brier FROM {name}_a JOIN {name}_r USING (material_id) JOIN {name}_b USING (material_id))"""


_ABLATION = (
    _FEATURES
    + ", fm AS (SELECT fr.*, t.range AS test_fold, a.range AS arm, fold = t.range AS test FROM fr CROSS JOIN range(3) t CROSS JOIN range(2) a)"
    + _design_sql("material_id, test_fold, arm", "fm", "arm = 1")
    + _newton_sql("material_id, test_fold, arm", 600)
    + ", pr AS (SELECT zt.material_id, zt.test_fold, zt.arm, site_id, unit_id, y, 1 / (1 + exp(-list_inner_product(w, z))) AS p FROM zt JOIN gw ON gw.material_id = zt.material_id AND gw.test_fold = zt.test_fold AND gw.arm = zt.arm AND i = 600 WHERE test), oof AS (SELECT material_id, test_fold, site_id, unit_id, y, max(p) FILTER (arm = 0) AS a, max(p) FILTER (arm = 1) AS b FROM pr GROUP BY ALL HAVING count(*) = 2)"
    + _metrics_sql("base", "a")
    + _metrics_sql("extended", "b")
    + ", fa AS (SELECT material_id, test_fold, avg(CASE WHEN x.a > o.a THEN 1e0 WHEN x.a = o.a THEN 5e-1 ELSE 0 END) AS base, avg(CASE WHEN x.b > o.b THEN 1e0 WHEN x.b = o.b THEN 5e-1 ELSE 0 END) AS ext FROM oof x JOIN oof o USING (material_id, test_fold) WHERE x.y = 1 AND o.y = 0 GROUP BY 1, 2), fc AS (SELECT material_id, count(*) FILTER (ext - base > 1e-12) AS folds_gained, count(*) FILTER (ext - base < -1e-12) AS folds_lost FROM (SELECT DISTINCT material_id, test_fold FROM oof) LEFT JOIN fa USING (material_id, test_fold) GROUP BY 1)"
    + _paired_sql("oof", "material_id", 500, "7")
)


@query("m13_paired_ablation", _ABLATION + " SELECT material_id, " + ", ".join(f"round(base_m.{m}, 4) AS base_{m}, round(extended_m.{m}, 4) AS extended_{m}, round(extended_m.{m} - base_m.{m}, 4) AS delta_{m}" for m in ("auc", "average_precision", "recall", "brier")) + ", round(delta_low, 4) AS delta_low, round(delta_high, 4) AS delta_high, coalesce(valid, 0) AS valid, folds_gained, folds_lost FROM base_m JOIN extended_m USING (material_id) JOIN fc USING (material_id) LEFT JOIN pd USING (material_id)")
def _(x):
    rows = _feature_rows(x).withColumn("fold", (F.floor(F.col("site_id") / 12) % 3).cast("int"))
    out = M.paired_ablation(rows, "material_id", "site_id", "fold", 3, "y", {"base": ["f2"], "extended": ["f1", "f2"]}, group="unit_id")
    return out.select("material_id", *[F.round(c, 4).alias(c) for c in out.columns if c.startswith(("base_", "extended_", "delta_"))], "valid", "folds_gained", "folds_lost")


_REPS = 500


def _bootstrap_sql(rows: str, group: str, seed: str, reps: int = _REPS) -> str:
    """bs: intervals of AUC and recall for each material of rows (material_id, group, s, y) when groups of each label are drawn."""
    return f""", g AS (SELECT material_id, y, {group}, row_number() OVER (PARTITION BY material_id, y ORDER BY {group}) - 1 AS g, count(*) OVER (PARTITION BY material_id, y) AS m FROM (SELECT DISTINCT material_id, y, {group} FROM {rows})),
dr AS (SELECT material_id, y, r.range AS rep, ({_hash_sql('g * 7919 + r.range * 104729 + y', seed)}) % m AS g FROM g CROSS JOIN range({reps}) r), w AS (SELECT material_id, y, {group}, rep, count(*) AS times FROM dr JOIN g USING (material_id, y, g) GROUP BY ALL),
lw AS (SELECT lab.material_id, rep, s, lab.y, times FROM {rows} lab JOIN w USING (material_id, y, {group})), t AS (SELECT material_id, rep, s, coalesce(sum(times) FILTER (y = 1), 0) AS p, coalesce(sum(times) FILTER (y = 0), 0) AS n FROM lw GROUP BY 1, 2, 3), k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY material_id, rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t), a AS (SELECT material_id, rep, CAST(sum(p * (b + n / 2e0)) AS DOUBLE) / nullif(CAST(sum(p) * sum(n) AS DOUBLE), 0) AS auc FROM k GROUP BY 1, 2),
cu AS (SELECT material_id, rep, quantile_cont(s, 95e-2) AS cut FROM (SELECT material_id, rep, s, unnest(range(times)) FROM lw WHERE y = 0) GROUP BY 1, 2), re AS (SELECT material_id, rep, CAST(sum(CASE WHEN s >= cut THEN times ELSE 0 END) AS DOUBLE) / sum(times) AS recall FROM lw JOIN cu USING (material_id, rep) WHERE y = 1 GROUP BY 1, 2),
bs AS (SELECT material_id, quantile_cont(auc, 25e-3) AS auc_low, quantile_cont(auc, 975e-3) AS auc_high, quantile_cont(recall, 25e-3) AS recall_low, quantile_cont(recall, 975e-3) AS recall_high FROM a LEFT JOIN re USING (material_id, rep) GROUP BY 1)"""


_INTERVALS = ("auc_low", "auc_high", "recall_low", "recall_high")


@query("m14_group_bootstrap", _LAB + _bootstrap_sql("lab", "unit_id", "5") + f" SELECT material_id, {', '.join(f'round({c}, 6) AS {c}' for c in _INTERVALS)} FROM bs WHERE auc_low IS NOT NULL")
def _(x):
    out = M.group_bootstrap(_labelled(x), ["material_id"], "unit_id", "s", "y", _REPS, 5).where("auc_low is not null")
    return out.select("material_id", *[r6(c).alias(c) for c in _INTERVALS])


@query("m14_paired_delta", _LAB + ", two AS (SELECT material_id, unit_id, y, CAST(site_id * 53 % 89 AS DOUBLE) AS a, s AS b FROM lab)" + _paired_sql("two", "material_id", 500, "9") + " SELECT material_id, round(delta_low, 6) AS delta_low, round(delta_high, 6) AS delta_high, coalesce(valid, 0) AS valid FROM (SELECT DISTINCT material_id FROM two) LEFT JOIN pd USING (material_id)")
def _(x):
    rows = _labelled(x).withColumn("other", (F.col("site_id") * 53 % 89).cast("double"))
    out = M.paired_bootstrap(rows, ["material_id"], "unit_id", "other", "s", "y", _REPS, 9)
    return out.select("material_id", r6("delta_low").alias("delta_low"), r6("delta_high").alias("delta_high"), "valid")


@query("m15_admission_decision", "SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'not_evaluated' WHEN p_size >= 10 AND p_size % 9 >= 5 AND p_partkey % 50 >= 10 AND p_partkey % 7 >= 2 THEN 'passed' WHEN p_partkey % 7 < 1 THEN 'degraded' ELSE 'inconclusive' END AS decision FROM part")
def _(x):
    k, n = F.col("p_partkey"), F.col("p_size")
    delta = F.when(k % 13 != 0, (k % 7 - 1) / 1e1)
    d = M.admission_decision(n, n % 9, F.lit(True), F.lit(50.0) + k % 50 - 10, F.lit(0.9), F.lit(0.7), delta, F.lit(0.01), F.lit(0.5), F.lit(0.4))
    return x.part.select("p_partkey", d["decision"].alias("decision"))


def _blocks(x):
    return x.supplier.select(F.col("s_suppkey").alias("block"), (F.col("s_suppkey") * 7 % 200 + 1).alias("cell_id"), F.array((F.col("s_nationkey") % 12).cast("long"), ((F.col("s_nationkey") + 5) % 12).cast("long")).alias("targets"))


@query("m16_transfer_observations", _SCORES + ", rk AS (SELECT *, rank() OVER (PARTITION BY cell_id ORDER BY round(score, 9) DESC) AS r FROM fin), b AS (SELECT DISTINCT s_suppkey AS block, s_suppkey * 7 % 200 + 1 AS cell_id, unnest([s_nationkey % 12, (s_nationkey + 5) % 12]) AS material_id FROM supplier) SELECT block, material_id, round(score, 6) AS score, CAST(r AS BIGINT) AS rank, km > 25 AS outside_known FROM b LEFT JOIN rk USING (cell_id, material_id)")
def _(x):
    scores = _scores(x, ranked=False).withColumn("score", F.round("score", 9))
    out = M.transfer_observations(_blocks(x), "block", "material_id", "cell_id", scores)
    return out.select("block", "material_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"), "outside_known")


_TRANSFER = (
    _SCORES
    + _RANKED
    + ", rk AS (SELECT cell_id, material_id, km, round(score, 9) AS s, percentile FROM pr)"
    ", b AS (SELECT DISTINCT s_suppkey AS block, s_suppkey * 7 % 200 + 1 AS cell_id, unnest([s_nationkey % 12, (s_nationkey + 5) % 12]) AS material_id FROM supplier), ar AS (SELECT cell_id, floor(lat / 4) * 100 + floor(lon / 4) AS area FROM cells)"
    ", oof AS (SELECT material_id, area, s, percentile, 1 AS y FROM b JOIN rk USING (cell_id, material_id) JOIN ar USING (cell_id) WHERE km > 25 UNION ALL SELECT material_id, area, s, percentile, 0 FROM rk JOIN ar USING (cell_id) WHERE km > 25)"
    + _metrics_sql("tm", "s")
    + _bootstrap_sql("oof", "area", "7")
    + ", sh AS (SELECT material_id, count(*) AS n_blocks, quantile_cont(percentile, 5e-1) AS median, "
    + ", ".join(f"avg(CASE WHEN percentile IS NOT NULL THEN CASE WHEN percentile >= {v} THEN 1e0 ELSE 0 END END) AS {c}" for c, v in (("share_0_95", "95e-2"), ("share_0_99", "99e-2"), ("share_0_995", "995e-3")))
    + " FROM oof WHERE y = 1 GROUP BY 1)"
)
_TRANSFER_COLUMNS = ("auc", "average_precision", "recall", *_INTERVALS, "median", "share_0_95", "share_0_99", "share_0_995")


@query("m17_transfer_metrics", _TRANSFER + f" SELECT material_id, n_blocks, {', '.join(f'round({c}, 5) AS {c}' for c in _TRANSFER_COLUMNS)}, CASE WHEN n_blocks < 5 THEN 'too_few_blocks' WHEN auc >= 6e-1 AND auc_low > 5e-1 THEN 'passed' ELSE 'not_passed' END AS status FROM sh LEFT JOIN tm_m USING (material_id) LEFT JOIN bs USING (material_id)")
def _(x):
    scores = _scores(x).withColumn("score", F.round("score", 9))
    area = x.cells.select("cell_id", (F.floor(F.col("lat") / 4) * 100 + F.floor(F.col("lon") / 4)).alias("area"))
    obs = M.transfer_observations(_blocks(x), "block", "material_id", "cell_id", scores).join(area, "cell_id")
    out = M.transfer_metrics(obs, scores.where("nearest_km > 25").join(area, "cell_id"), "material_id", "area")
    return out.select("material_id", "n_blocks", *[F.round(c, 5).alias(c) for c in _TRANSFER_COLUMNS], "status")


@query("m18_score_parity", "SELECT 'score' AS kind, count(*) * 3 AS compared, count(*) FILTER (site_id % 10 = 0) AS mismatches FROM sites")
def _(x):
    k = F.col("site_id")
    names = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    published = x.sites.select("site_id", names.alias("names"), F.array(k / 7, k / 11 + F.when(k % 10 == 0, 1.0).otherwise(0.0), k / 13).alias("scores"))
    again = x.sites.select("site_id", F.explode(F.array(F.struct(F.lit("a").alias("name"), (k / 7).alias("score")), F.struct(F.lit("b").alias("name"), (k / 11).alias("score")), F.struct(F.lit("c").alias("name"), (k / 13).alias("score")))).alias("r")).select("site_id", "r.*")
    return M.score_parity(published, again, "site_id", {"scores": "score"}, "names", "name")


@query("m19_metric_parity", "SELECT 'lat' AS metric, 1e-1 AS max_difference, CAST(0 AS BIGINT) AS missing_differs, false AS passed UNION ALL SELECT 'lon', 0e0, (SELECT count(*) FROM sites WHERE site_id % 100 = 0), false")
def _(x):
    ref = x.sites.select("site_id", (F.col("lat") + 0.1 * (F.col("site_id") == 5).cast("int")).alias("lat"), F.when(F.col("site_id") % 100 != 0, F.col("lon")).alias("lon"))
    return M.metric_parity(x.sites, ref, ["site_id"], ["lat", "lon"], 1e-6).withColumn("max_difference", r6("max_difference"))


# --- governance -----------------------------------------------------------------------------------


@query("q1_check_suite", "SELECT 'rows' AS name, CAST(count(*) AS VARCHAR) AS observed, CAST(count(*) AS VARCHAR) AS expected, true AS passed, false AS all_passed FROM orders UNION ALL SELECT 'distinct_keys', CAST(count(DISTINCT o_orderkey) AS VARCHAR), CAST(count(*) AS VARCHAR), true, false FROM orders UNION ALL SELECT 'no_open_orders', CAST(count(*) FILTER (o_orderstatus = 'O') AS VARCHAR), '0', false, false FROM orders")
def _(x):
    return Q.check_suite(x.orders, {"rows": (F.count("*"), F.count("o_orderkey")), "distinct_keys": (F.countDistinct("o_orderkey"), F.count("*")), "no_open_orders": (F.count_if(F.col("o_orderstatus") == "O"), F.lit(0))})


@query("q2_check_key", "SELECT CAST(count(*) AS BIGINT) AS n_rows, count(*) FILTER (code IS NULL) AS n_blank, count(*) - (SELECT count(*) FROM (SELECT DISTINCT code, office FROM inspections)) AS n_duplicate FROM inspections")
def _(x):
    return Q.check_key(x.inspections, ["code", "office"])


@query("q3_check_foreign_key", "SELECT l_partkey + 5 AS key, count(*) AS n FROM lineitem WHERE l_partkey + 5 NOT IN (SELECT p_partkey FROM part) GROUP BY 1")
def _(x):
    return Q.check_foreign_key(x.lineitem.withColumn("k", F.col("l_partkey") + 5), x.part, "k", "p_partkey")


@query("q4_coverage", "SELECT 'code' AS column, round(avg(CASE WHEN code IS NOT NULL THEN 1e0 ELSE 0 END), 6) AS rate, CAST(min(code) AS DOUBLE) AS low, CAST(max(code) AS DOUBLE) AS high FROM inspections UNION ALL SELECT 'inspected_on', round(avg(CASE WHEN inspected_on IS NOT NULL THEN 1e0 ELSE 0 END), 6), NULL, NULL FROM inspections")
def _(x):
    return Q.coverage(x.inspections, ["code", "inspected_on"], ["code"]).withColumn("rate", r6("rate"))


@query("q5_assert_schema", "SELECT count(*) AS n_rows FROM customer")
def _(x):
    return Q.assert_schema(x.customer, Q.schema_hash(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])).agg(F.count("*").alias("n_rows"))


@query("q6_subtotal_check", "SELECT l_orderkey, l_linenumber, round(abs(total - (a + b + c)), 4) AS max_error, abs(total - (a + b + c)) <= greatest(2e0, abs(total) * 2e-5) AS passed FROM subtotals")
def _(x):
    out = Q.subtotal_check(x.subtotals, [(["a", "b", "c"], "total")], "total")
    return out.select("l_orderkey", "l_linenumber", F.round("max_error", 4).alias("max_error"), "passed")


@query("q7_contiguous", "SELECT min(c_custkey) AS low, max(c_custkey) AS high, count(*) AS n, count(DISTINCT c_custkey) AS n_distinct, min(c_custkey) = 1 AND max(c_custkey) = count(*) AS contiguous FROM customer")
def _(x):
    return Q.contiguous(x.customer, "c_custkey")


@query("q8_content_fingerprint", """, h AS (SELECT sha256('["' || c_custkey || '","' || c_name || '"]') AS h FROM customer) SELECT count(*) AS n_rows, concat_ws('-', CAST(sum(CAST('0x' || h[1:8] AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || h[9:16] AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || h[17:24] AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || h[25:32] AS BIGINT)) AS VARCHAR)) AS fingerprint FROM h""")
def _(x):
    return Q.content_fingerprint(x.customer, ["c_custkey", "c_name"])


_MANIFEST = """
, t AS (SELECT 'orders' AS "table", 'o_orderkey' AS primary_key, 'order' AS grain, count(*) AS n_rows, count(DISTINCT o_orderkey) = count(*) AND count(o_orderkey) = count(*) AS key_valid FROM orders
UNION ALL SELECT 'lineitem', 'l_orderkey,l_linenumber', 'line', count(*), count(DISTINCT (l_orderkey, l_linenumber)) = count(*) AND count(l_orderkey) = count(*) AND count(l_linenumber) = count(*) FROM lineitem),
c AS (SELECT table_name AS "table", CAST(count(*) AS INTEGER) AS n_columns, sha256('["' || string_agg(column_name, '","' ORDER BY column_index) || '"]') AS schema_sha256 FROM duckdb_columns() WHERE table_name IN ('orders', 'lineitem') GROUP BY 1)
SELECT "table", primary_key, key_valid, n_rows, n_columns, schema_sha256, 'observation' AS role, grain FROM t JOIN c USING ("table")"""


@query("q9_build_manifest", _MANIFEST)
def _(x):
    return Q.build_manifest({"orders": x.orders, "lineitem": x.lineitem}, {"orders": {"key": ["o_orderkey"], "role": "observation", "grain": "order"}, "lineitem": {"key": ["l_orderkey", "l_linenumber"], "role": "observation", "grain": "line"}})


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS tab, '{c}' AS col, count(*) AS n_rows, count(*) - count({c}) AS n_missing, {f'count(*) FILTER (trim({c}) = {chr(39) * 2})' if kind == 'string' else 'CAST(0 AS BIGINT)'} AS n_blank FROM {table}" for c, kind in columns.items())


_ORDER_COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "date", "o_orderpriority": "string"}
_CUSTOMER_COLUMNS = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query("q10_build_dictionary", f", pf AS ({_profile_sql('orders', _ORDER_COLUMNS)} UNION ALL {_profile_sql('customer', _CUSTOMER_COLUMNS)}) SELECT tab AS table, col AS column, CASE WHEN col = 'o_orderkey' THEN 'order number' WHEN col IN ('o_custkey', 'c_custkey') THEN 'customer number' WHEN regexp_matches(col, 'price|bal') THEN 'amount' WHEN regexp_matches(col, 'date') THEN 'day' WHEN regexp_matches(col, 'key$') THEN 'identifier' END AS definition, CASE WHEN col = 'o_orderkey' THEN 'own' WHEN col = 'o_custkey' THEN 'alias' WHEN col = 'c_custkey' THEN 'shared' WHEN regexp_matches(col, 'price|bal|date|key$') THEN 'rule' ELSE 'missing' END AS basis, n_rows, n_missing, n_blank FROM pf")
def _(x):
    """Columns with what their tables hold: every row of both tables is read once."""
    columns = Q.profile_columns({"orders": x.orders.select(*_ORDER_COLUMNS), "customer": x.customer.select(*_CUSTOMER_COLUMNS)})
    own = x.spark.createDataFrame([("orders", "o_orderkey", "order number")], "table string, column string, definition string")
    aliases = x.spark.createDataFrame([("o_custkey", "c_custkey")], "column string, target string")
    shared = x.spark.createDataFrame([("c_custkey", "customer number")], "column string, definition string")
    return Q.build_dictionary(columns, own, aliases, shared, {"price|bal": "amount", "date": "day", "key$": "identifier"}).drop("data_type")


@query("q11_gap_register", "SELECT p_partkey, trim(p_type) AS gap, array_to_string(CASE WHEN NOT regexp_matches(p_type, '(?i)STEEL|TIN|COPPER') THEN ['other'] ELSE list_filter([CASE WHEN regexp_matches(p_type, '(?i)STEEL|TIN') THEN 'metal' END, CASE WHEN regexp_matches(p_type, '(?i)COPPER') THEN 'base' END], lambda v: v IS NOT NULL) END, ',') AS categories, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 'lineitem' END AS tables FROM part")
def _(x):
    lineage = Q.lineage_index({"lineitem": (x.lineitem.select(F.array("l_partkey").alias("ids")), "ids")}, "p_partkey")
    out = Q.gap_register(x.part, "p_partkey", "p_type", {"metal": ["STEEL", "TIN"], "base": ["COPPER"]}, lineage)
    return out.select("p_partkey", "gap", F.array_join("categories", ",").alias("categories"), F.array_join("tables", ",").alias("tables"))


@query("q12_lineage_index", ", t AS (SELECT s_nationkey AS k, 'supplier' AS t FROM supplier UNION SELECT c_nationkey, 'customer' FROM customer UNION SELECT (c_nationkey + 1) % 30, 'customer' FROM customer) SELECT k AS key, array_to_string(list_sort(list(t)), ',') AS tables FROM t GROUP BY 1")
def _(x):
    a = x.supplier.select(F.array(F.col("s_nationkey").cast("long")).alias("ids"))
    b = x.customer.select(F.array(F.col("c_nationkey").cast("long"), ((F.col("c_nationkey") + 1) % 30).cast("long")).alias("ids"))
    return Q.lineage_index({"supplier": (a, "ids"), "customer": (b, "ids")}, "key").select("key", F.array_join("tables", ",").alias("tables"))


@query("q13_guardrail_check", "SELECT 'name_filled' AS rule, CAST(0 AS BIGINT) AS violations, true AS passed UNION ALL SELECT 'segment_allowed', count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')), count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) = 0 FROM customer UNION ALL SELECT 'balance_not_negative', count(*) FILTER (c_acctbal < 0), count(*) FILTER (c_acctbal < 0) = 0 FROM customer")
def _(x):
    return Q.guardrail_check(x.customer, {"name_filled": F.length("c_name") > 0, "segment_allowed": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "balance_not_negative": F.col("c_acctbal") >= 0})


@query("q14_feature_collection_parity", "SELECT 'only_table' AS kind, count(*) FILTER (cell_id % 10 = 0) AS n FROM cells UNION ALL SELECT 'only_features', CAST(0 AS BIGINT) UNION ALL SELECT 'differs_unit_id', count(*) FILTER (cell_id % 10 <> 0 AND cell_id % 7 = 0) FROM cells")
def _(x):
    features = x.cells.where("cell_id % 10 <> 0").withColumn("unit_id", F.when(F.col("cell_id") % 7 == 0, 99).otherwise(F.col("unit_id")))
    return Q.feature_collection_parity(x.cells, features, "cell_id", ["unit_id"])


@query("q15_completion_audit", "SELECT 'orders_present' AS requirement, CAST(count(*) AS VARCHAR) AS evidence, count(*) > 0 AS passed FROM orders UNION ALL SELECT 'lines_of_known_parts', CAST(count(*) AS VARCHAR), count(*) = 0 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'five_regions', CAST(count(DISTINCT r_regionkey) AS VARCHAR), count(DISTINCT r_regionkey) = 5 FROM region")
def _(x):
    v = F.col("value")
    return Q.completion_audit({"orders_present": (x.orders, F.count("*"), v > 0), "lines_of_known_parts": (x.lineitem.join(x.part, F.col("l_partkey") == F.col("p_partkey"), "left_anti"), F.count("*"), v == 0), "five_regions": (x.region, F.countDistinct("r_regionkey"), v == 5)})


@query("q16_required_text_check", "SELECT doc_id, s AS missing FROM documents CROSS JOIN (VALUES ('the'), ('License'), ('zzz')) t(s) WHERE NOT contains(coalesce(text, ''), s)")
def _(x):
    return Q.required_text_check(x.documents, "doc_id", "text", ["the", "License", "zzz"])


# --- documents --------------------------------------------------------------------------------------


_D1 = r"""
, z AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s([^>]*)>(.*?)</a\s*>', 1) AS h, regexp_extract_all(html, '(?is)<a\s([^>]*)>(.*?)</a\s*>', 2) AS t FROM pages),
e AS (SELECT page_id, url, h[i] AS h, t[i] AS t, i FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM z)),
l AS (SELECT page_id, url, i, t, regexp_extract(h, '(?is)(?:^|\s)href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS q FROM e WHERE regexp_matches(h, '(?is)(?:^|\s)href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))')),
k AS (SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS position, q.a || q.b || q.c AS href, regexp_replace(t, '<[^>]*>', '', 'g') AS text FROM l)
SELECT page_id, position, href, text, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href ELSE href END AS resolved FROM k"""


@query("d1_extract_links", _D1)
def _(x):
    return D.extract_links(x.pages, "page_id", "html", "url")


def _table_pages(x):
    """Pages with a table of an order's lines, its header in the second row and in two languages."""
    o = x.orders
    rows = F.concat(F.lit("<table><tr><td>Lines</td></tr><tr><th>खान Mine Name</th><th>Order Date</th><th>Price</th></tr><tr><td>mine "), F.col("o_custkey").cast("string"), F.lit("</td><td>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</td><td>"), F.col("o_orderpriority"), F.lit("</td></tr></table>"))
    return o.select(F.col("o_orderkey").alias("page_id"), rows.alias("html"))


@query("d2_extract_tables")
def _(x):
    return D.extract_tables(x.pages.select("page_id", F.concat("html", F.lit("<table><tr><td>"), "url", F.lit("</td></tr></table>")).alias("html")), "page_id", "html")


@query("d2_extract_order_tables", ", c AS (SELECT o_orderkey AS page_id, [['Lines'], ['खान Mine Name', 'Order Date', 'Price'], ['mine ' || o_custkey, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority]] AS r FROM orders), r AS (SELECT page_id, i, r[i] AS c FROM c, range(1, 4) t(i)) SELECT page_id, CAST(0 AS INTEGER) AS table, CAST(i - 1 AS INTEGER) AS row, CAST(j - 1 AS INTEGER) AS col, c[j] AS text FROM (SELECT *, unnest(range(1, len(c) + 1)) AS j FROM r)")
def _(x):
    return D.extract_tables(_table_pages(x), "page_id", "html").toDF("page_id", "table", "row", "col", "text")


@query("d2_nested_tables", ", c AS (SELECT o_orderkey AS page_id, 0 AS tab, 0 AS row, 0 AS col, 'order ' || o_orderkey || ' of ' || o_custkey AS text FROM orders UNION ALL SELECT o_orderkey, 0, 0, 1, 'a & b' FROM orders UNION ALL SELECT o_orderkey, 1, 0, 0, o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 1, 0, 1, '' FROM orders UNION ALL SELECT o_orderkey, 0, 1, 0, strftime(o_orderdate, '%Y %m') FROM orders) SELECT page_id, CAST(tab AS INTEGER) AS table, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, text FROM c")
def _(x):
    """A table inside a cell that goes on after it, breaks, character references and end tags left out."""
    o = x.orders
    page = F.concat(F.lit("<TABLE><tr><td>order "), F.col("o_orderkey").cast("string"), F.lit("<table><tr><td>"), F.col("o_orderpriority"), F.lit("<td></td></tr></table>of<br>"), F.col("o_custkey").cast("string"), F.lit("<th>a &amp; <b>b</b><script>if (a < b) x()</script><tr><td>"), F.date_format("o_orderdate", "yyyy"), F.lit("<br/>"), F.date_format("o_orderdate", "MM"))
    return D.extract_tables(o.select(F.col("o_orderkey").alias("page_id"), page.alias("html")), "page_id", "html")


@query("d3_canonical_headers", "SELECT o_orderkey AS page_id, CAST(0 AS INTEGER) AS table, CAST(2 AS INTEGER) AS row, 'mine ' || o_custkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS price FROM orders")
def _(x):
    cells = D.extract_tables(_table_pages(x), "page_id", "html")
    return D.canonical_headers(cells, ["page_id", "table"], {"name": "mine name|खान", "day": "date", "price": "price"})


@query("d4_extract_fields", r""", z AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z0-9_.]+@[a-z0-9.]+)', 1) AS a, regexp_extract_all(text, '([0-9]{3}-[0-9]{4})', 1) AS b, regexp_extract_all(text, '(?:^|[ \n])(an[a-z]+)', 1) AS c FROM documents) SELECT doc_id, coalesce(a[1], b[1]) AS contact, c[1] AS word, len(a) + len(b) AS n_contacts FROM z""")
def _(x):
    out = D.extract_fields(x.documents, "doc_id", "text", {"contact": [r"([A-Za-z0-9_.]+@[a-z0-9.]+)", r"([0-9]{3}-[0-9]{4})"], "word": [r"(?:^|[ \n])(an[a-z]+)"]})
    return out.select("doc_id", "contact", "word", F.size("all_contact").cast("long").alias("n_contacts"))


@query("d5_melt_measurements", "SELECT l_orderkey, l_linenumber, 'a' AS parameter, CAST(a AS DOUBLE) AS value, 'XRF' AS method, 'ppm' AS unit, false AS conflict FROM subtotals UNION ALL SELECT l_orderkey, l_linenumber, 'b', CAST(b AS DOUBLE), 'ICP', 'pct', true FROM subtotals")
def _(x):
    wide = x.subtotals.select("l_orderkey", "l_linenumber", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    one = x.region.agg(F.count("*").alias("n"))
    metadata = one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.lit(m).alias("method"), F.lit(u).alias("unit")) for p, m, u in (("a", "XRF", "ppm"), ("b", "ICP", "ppm"), ("b", "ICP", "pct"))])).alias("r")).select("r.*")
    return D.melt_measurements(wide, ["l_orderkey", "l_linenumber"], ["a", "b"], metadata)


@query("d6_build_entities", ", s AS (SELECT p_partkey AS o, trim(w) AS name, p_brand AS source FROM part, unnest(string_split(p_name, ' ')) t(w)), e AS (SELECT lower(name) AS key, arg_min(name, o) AS name, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM s GROUP BY 1) SELECT key, name, n AS n_mentions, sources, row_number() OVER (ORDER BY n DESC, key) AS rank FROM e")
def _(x):
    seeds = x.part.select(F.col("p_partkey").alias("seed_order"), F.explode(F.split("p_name", " ")).alias("name"), F.lit("word").alias("kind"), F.lit(None).cast("string").alias("parent"), F.col("p_brand").alias("source"))
    return D.build_entities(seeds).select("key", "name", "n_mentions", F.array_join("sources", ",").alias("sources"), "rank")


@query("d7_map_terms", "SELECT p_partkey, CASE WHEN contains(p_type, 'COPPER') THEN 'element:copper' WHEN contains(p_type, 'TIN') THEN 'element:tin' ELSE '' END AS targets, CASE WHEN contains(p_type, 'COPPER') OR contains(p_type, 'TIN') THEN 'mapped' ELSE 'unresolved' END AS status FROM part")
def _(x):
    words = x.part.select(F.explode(F.split(F.lower("p_type"), " ")).alias("key")).distinct()
    elements = words.where("key in ('copper', 'tin')").select("key", F.concat(F.lit("element:"), "key").alias("target"))
    out = D.map_terms(x.part.select("p_partkey", "p_type"), "p_type", {"element": elements}, r"[ ,;/&+]+", r"(?i)\b(ore|metal)\b")
    return out.select("p_partkey", F.array_join("targets", ",").alias("targets"), "status")


@query("d8_expand_occurrences", ", t AS (SELECT n_name, n_nationkey, string_agg(s_name, ' and ' ORDER BY s_suppkey) AS text, list(s_name ORDER BY s_suppkey) AS names FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) SELECT n_name, 'present' AS term, unnest(names) AS place, true AS place_found FROM t UNION ALL SELECT n_name, 'absent', 'nowhere at all', false FROM t")
def _(x):
    s = x.supplier.groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_name")).alias("names"))
    chapters = x.nation.join(s, F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", F.create_map(F.lit("present"), F.col("names"), F.lit("absent"), F.array(F.lit("nowhere at all"))).alias("places"), F.array_join("names", " and ").alias("text"))
    return D.expand_occurrences(chapters, "n_name", "places", "text")
