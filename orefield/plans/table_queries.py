"""Queries S, J, A, W and U: sources, joins, aggregations, ranking and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import relational as R
from ..operators import spatial as P

from ..operators.state import shared_path
from ..sources import tables as S
from .registry import haversine, inside, query

r6 = lambda c: F.round(c, 6)
_KM = haversine("c.lat", "c.lon", "s.lat", "s.lon")


# --- sources ---------------------------------------------------------------------------


@query("s1_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_discount > 5e-2")
def _(x):
    return S.scan(x.spark, f"{x.folder}/lineitem.parquet", ["l_orderkey", "l_quantity"], "l_discount > 5e-2")


@query("s2_scan_tiles", "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def _(x):
    """Orders as tiles of 4,000 keys each, a preamble before the table."""
    line = F.concat_ws(",", "o_orderkey", "o_custkey", F.col("o_totalprice").cast("double"))
    tiles = x.orders.groupBy(F.floor(F.col("o_orderkey") / 4000).cast("string").alias("tile")).agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    path = shared_path(x.spark, "tiles")
    tiles.select(F.concat(F.lit("tile "), "tile", F.lit("\n-END-\no_orderkey,o_custkey,o_totalprice\n"), "lines").alias("value")).repartition(16, F.xxhash64("value")).write.option("maxRecordsPerFile", 1).text(path)
    return S.scan_tiles(x.spark, f"{path}/part-*", "-END-", "o_orderkey bigint, o_custkey bigint, o_totalprice double", tiles.count()).drop("tile")


@query("s3_scan_dimension_json", "SELECT n_nationkey AS rank, n_name AS name, n_name AS first_alias, CAST(n_regionkey AS VARCHAR) AS second_alias FROM nation")
def _(x):
    record = F.to_json(F.struct(F.col("n_nationkey").alias("rank"), F.col("n_name").alias("name"), F.array("n_name", F.col("n_regionkey").cast("string")).alias("aliases")))
    path = shared_path(x.spark, "dimension")
    x.nation.agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value")).write.text(path)  # one row a nation
    found = S.scan_dimension_json(x.spark, path, "rank bigint, name string, aliases array<string>", "rank")
    return found.select("rank", "name", F.col("aliases")[0].alias("first_alias"), F.col("aliases")[1].alias("second_alias"))


@query("s4_scan_features", "SELECT 'cell-' || cell_id AS feature, unit_id, CAST(part AS INTEGER) AS part, CAST(ring AS INTEGER) AS ring, CAST(seq AS INTEGER) AS seq, floor(lon) + dx AS x, floor(lat) + dy AS y FROM cells CROSS JOIN (VALUES (0, 0, 0, 0, 0), (0, 0, 1, 8, 0), (0, 0, 2, 8, 8), (0, 1, 0, 4, 1), (0, 1, 1, 6, 1), (0, 1, 2, 6, 3), (1, 0, 0, 9, 9), (1, 0, 1, 12, 9), (1, 0, 2, 12, 12)) v(part, ring, seq, dx, dy) WHERE (part = 0 AND ring = 0) OR cell_id % 3 = 0")
def _(x):
    """Each cell a triangle; every third one with a hole and a second part."""
    a, b = F.floor("lon"), F.floor("lat")
    ring = lambda *at: F.concat(F.lit("["), F.concat_ws(",", *[F.format_string("[%d,%d]", a + dx, b + dy) for dx, dy in (*at, at[0])]), F.lit("]"))
    outer, hole, other = ring((0, 0), (8, 0), (8, 8)), ring((4, 1), (6, 1), (6, 3)), ring((9, 9), (12, 9), (12, 12))
    simple = F.concat(F.lit('"Polygon","coordinates":['), outer, F.lit("]"))
    multi = F.concat(F.lit('"MultiPolygon","coordinates":[['), outer, F.lit(","), hole, F.lit("],["), other, F.lit("]]"))
    geometry = F.when(F.col("cell_id") % 3 == 0, multi).otherwise(simple)
    feature = F.concat(F.lit('{"type":"Feature","id":"cell-'), F.col("cell_id").cast("string"), F.lit('","properties":{"unit_id":'), F.coalesce(F.col("unit_id").cast("string"), F.lit("null")), F.lit('},"geometry":{"type":'), geometry, F.lit("}}"))
    texts = x.cells.select(F.concat(F.lit('{"features":['), feature, F.lit("]}")).alias("text"))
    features, vertices = S.scan_features(texts, "text", "unit_id:bigint")
    return vertices.join(features, "feature").select("feature", "unit_id", "part", "ring", "seq", "x", "y")


@query("s5_scan_raster", "SELECT row, col, value FROM raster WHERE row BETWEEN 9 AND 41 AND col BETWEEN 19 AND 61")
def _(x):
    return S.scan_raster(x.raster, (10, 40), (20, 60))


@query("s6_typed_by_dictionary", "SELECT o_orderkey, o_totalprice > 1e5 AS large, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS price, nullif(trim(o_orderpriority), '') AS priority FROM orders")
def _(x):
    text = x.orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), (F.col("o_totalprice") > 1e5).cast("string").alias("large"), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.col("o_orderpriority").alias("priority"))
    return S.typed_by_dictionary(text, {"o_orderkey": "integer", "large": "boolean", "price": "number", "priority": "text"})


@query("s7_write_table", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS p_size, printf('%.2f', CAST(p_retailprice AS DOUBLE)) AS p_retailprice FROM part")
def _(x):
    rows = x.part.select("p_partkey", "p_name", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))
    return S.as_text(rows, ["p_partkey", "p_name", "p_size", "p_retailprice"], 2)


_RING = "'[' || array_to_string(list('[' || x || ',' || y || ']' ORDER BY k), ',') || ']'"


@query("s8_write_geojson", f""", c AS (SELECT cell_id, unit_id, floor((lon + 180) / 28125e-4) * 28125e-4 - 180 AS w, floor((lat + 90) / 28125e-4) * 28125e-4 - 90 AS s FROM cells),
v AS (SELECT cell_id, unit_id, k, round(w + CASE WHEN k IN (1, 2) THEN 28125e-4 ELSE 0 END, 6) AS x, round(s + CASE WHEN k IN (2, 3) THEN 28125e-4 ELSE 0 END, 6) AS y FROM c CROSS JOIN (SELECT range AS k FROM range(5)))
SELECT '{{"type":"Feature","id":"' || cell_id || '","properties":{{"cell_id":' || cell_id || ',"unit_id":' || coalesce(CAST(unit_id AS VARCHAR), 'null') || ',"row_sha256":"' || sha256('["' || cell_id || '","' || coalesce(CAST(unit_id AS VARCHAR), '') || '"]') || '"}},"geometry":{{"type":"Polygon","coordinates":[' || {_RING} || ']}}}}' AS feature FROM v GROUP BY cell_id, unit_id""")
def _(x):
    from ..operators.cells import cell_of, geometry

    wkt, _ = geometry(cell_of(F.col("lat"), F.col("lon"), 6), 6)
    return S.geojson_features(x.cells.select("cell_id", "unit_id", wkt.alias("wkt")), "cell_id", "wkt", ["cell_id", "unit_id"])


@query("s8_geojson_parts", f""", cl AS (SELECT * FROM districts UNION ALL SELECT district_id, part, ring, 99, x, y FROM districts WHERE seq = 0),
r AS (SELECT district_id, part, ring, '[' || array_to_string(list('[' || printf('%.2f', x)::DOUBLE || ',' || printf('%.2f', y)::DOUBLE || ']' ORDER BY seq), ',') || ']' AS t FROM cl GROUP BY ALL),
p AS (SELECT district_id, part, '[' || array_to_string(list(t ORDER BY ring), ',') || ']' AS t FROM r GROUP BY ALL),
g AS (SELECT district_id, count(*) AS n, array_to_string(list(t ORDER BY part), ',') AS t FROM p GROUP BY ALL)
SELECT '{{"type":"Feature","id":"' || district_id || '","properties":{{"district_id":' || district_id || ',"row_sha256":"' || sha256('["' || district_id || '"]') || '"}},"geometry":{{"type":' || CASE WHEN n > 1 THEN '"MultiPolygon","coordinates":[' || t || ']' ELSE '"Polygon","coordinates":' || t END || '}}}}' AS feature FROM g""")
def _(x):
    """Districts written as WKT with holes and second parts."""
    v = x.districts
    ring = v.groupBy("district_id", "part", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    points = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda q: F.format_string("%.2f %.2f", q["x"], q["y"]))
    ring = ring.withColumn("t", F.concat(F.lit("("), F.array_join(points, ", "), F.lit(")")))
    part = ring.groupBy("district_id", "part").agg(F.sort_array(F.collect_list(F.struct("ring", "t"))).alias("r")).withColumn("t", F.concat(F.lit("("), F.array_join("r.t", ", "), F.lit(")")))
    whole = part.groupBy("district_id").agg(F.sort_array(F.collect_list(F.struct("part", "t"))).alias("r"))
    wkt = F.when(F.size("r") > 1, F.concat(F.lit("MULTIPOLYGON ("), F.array_join("r.t", ", "), F.lit(")"))).otherwise(F.concat(F.lit("POLYGON "), F.col("r.t")[0]))
    return S.geojson_features(whole.select("district_id", wkt.alias("wkt")), "district_id", "wkt", ["district_id"])


@query("s9_upsert", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new', 0e0 FROM customer WHERE c_custkey % 3 = 0")
def _(x):
    base = x.customer.select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return S.upsert(base, base.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal")), ["c_custkey"])


@query("s10_augment", "SELECT o_orderkey, o_custkey, o_custkey % 7 AS feature FROM orders")
def _(x):
    base = x.orders.select("o_orderkey", "o_custkey", F.lit(-1).alias("feature"))
    return S.augment(base, x.orders.select("o_orderkey", (F.col("o_custkey") % 7).alias("feature")), "o_orderkey", ["feature"])


# --- joins ---------------------------------------------------------------------------------


@query("j1_lookup_join", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(x):
    return R.lookup_join(x.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), x.nation, ["n_nationkey"]).select("s_suppkey", "s_name", "n_name")


_ON_EDGE = "bool_or((e.x2 - e.x1) * (c.lat - e.y1) = (e.y2 - e.y1) * (c.lon - e.x1) AND c.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND c.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))"
_WITHIN = f", hit AS (SELECT c.cell_id, e.region_id FROM cells c CROSS JOIN edges e GROUP BY c.cell_id, c.lat, c.lon, e.region_id HAVING ({inside('c.lon', 'c.lat')}) AND NOT {_ON_EDGE})"


@query("j2_point_in_polygon_join", _WITHIN + " SELECT c.cell_id, min(region_id) AS region_id FROM cells c LEFT JOIN hit USING (cell_id) GROUP BY 1")
def _(x):
    return P.point_in_polygon_join(x.cells, x.vertices, ["cell_id"], "region_id").select("cell_id", "region_id")


_PART_HITS = f", ph AS (SELECT cell_id, district_id FROM (SELECT c.cell_id, e.district_id, {inside('c.lon', 'c.lat')} AS inside, {_ON_EDGE} AS at_edge FROM cells c CROSS JOIN dedges e GROUP BY c.cell_id, c.lat, c.lon, e.district_id, e.part) GROUP BY 1, 2 HAVING bool_or(inside) AND NOT bool_or(at_edge))"


@query("j2_join_of_parts", _PART_HITS + " SELECT c.cell_id, min(district_id) AS district_id FROM cells c LEFT JOIN ph USING (cell_id) GROUP BY 1")
def _(x):
    """Districts of two parts with holes, as scan_features() reads them."""
    return P.point_in_polygon_join(x.cells, x.districts, ["cell_id"], "district_id").select("cell_id", "district_id")


@query("j3_nearest", f", d AS (SELECT c.cell_id, s.material_id, s.site_id, {_KM} AS km FROM cells c CROSS JOIN sites s) SELECT cell_id, material_id, arg_min(site_id, km) AS nearest_id, round(min(km), 6) AS nearest_km FROM d GROUP BY 1, 2")
def _(x):
    left = x.cells.join(x.materials)
    return P.nearest(left, x.sites, ["cell_id", "material_id"], ref_id="site_id", by=["material_id"]).select("cell_id", "material_id", "nearest_id", r6(F.col("nearest_km")).alias("nearest_km"))


@query("j4_nearest_where", f", d AS (SELECT c.cell_id, s.site_id, s.status, c.unit_id = s.unit_id AS same, {_KM} AS km FROM cells c CROSS JOIN sites s WHERE s.status LIKE '%U%' AND s.site_id % 2 = c.cell_id % 2) SELECT cell_id, arg_min(site_id, km) AS nearest_id, round(min(km), 6) AS nearest_km, min(km) <= 25 AS within_25_km, coalesce(arg_min(coalesce(same, false), km), false) AS same_unit FROM d GROUP BY 1")
def _(x):
    """The reference's own condition goes to the reference and the equality to the buckets, so that no row looks for what is not there."""
    ref = x.sites.where("status like '%U%'").withColumnRenamed("unit_id", "site_unit").withColumn("side", F.col("site_id") % 2)
    out = P.nearest(x.cells.withColumn("side", F.col("cell_id") % 2), ref, ["cell_id"], ref_id="site_id", by=["side"], keep=["site_unit"])
    return out.select("cell_id", "nearest_id", r6(F.col("nearest_km")).alias("nearest_km"), (F.col("nearest_km") <= 25).alias("within_25_km"), F.coalesce(F.col("nearest_site_unit") == F.col("unit_id"), F.lit(False)).alias("same_unit"))


@query("j3_nearest_k", f", d AS (SELECT c.cell_id, s.site_id, {_KM} AS km FROM cells c CROSS JOIN sites s), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY km, site_id) AS rank FROM d) SELECT cell_id, CAST(rank AS INTEGER) AS rank, site_id, round(km, 6) AS km FROM r WHERE rank <= 3")
def _(x):
    found = P.nearest_k(x.cells, x.sites, ["cell_id"], 3, ref_id="site_id")
    each = found.select("cell_id", F.posexplode("neighbours").alias("rank", "n"))
    return each.select("cell_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("site_id"), r6(F.col("n.km")).alias("km"))


@query("j3_nearest_k_ties", ", p AS (SELECT site_id, unit_id % 5 AS u FROM sites), r AS (SELECT a.site_id, b.site_id AS other, abs(a.u - b.u) AS steps, row_number() OVER (PARTITION BY a.site_id ORDER BY abs(a.u - b.u), b.site_id) AS rank FROM p a CROSS JOIN p b) SELECT site_id, string_agg(other, ',' ORDER BY rank) AS nearest FROM r WHERE rank <= 2 GROUP BY 1")
def _(x):
    """Five places on the equator that all sites share: distances tie by the hundred, and ids decide."""
    at = x.sites.select("site_id", F.lit(0.0).alias("lat"), (F.col("unit_id") % 5).cast("double").alias("lon"))
    found = P.nearest_k(at, at, ["site_id"], 2, ref_id="site_id")
    return found.select("site_id", F.array_join(F.transform("neighbours", lambda n: n["id"].cast("string")), ",").alias("nearest"))


@query("j5_count_within", f"SELECT c.cell_id, count(s.site_id) AS n_within FROM cells c LEFT JOIN sites s ON {_KM} <= 100 GROUP BY 1")
def _(x):
    return P.count_within(x.cells, x.sites, ["cell_id"], 100.0, ref_id="site_id").select("cell_id", "n_within")


_KM2 = haversine("c.lat", "c.lon", "s.lat", "s.lon")


@query("j6_nearest_leave_one_out", f", d AS (SELECT c.site_id, s.site_id AS other, {_KM2} AS km FROM sites c JOIN sites s ON c.material_id = s.material_id AND c.site_id <> s.site_id) SELECT c.site_id, min(d.km) IS NULL AS alone, round(min(d.km), 6) AS nearest_km, count(*) FILTER (d.km <= 100) AS n_within FROM sites c LEFT JOIN d USING (site_id) GROUP BY 1")
def _(x):
    near = P.nearest_other(x.sites, x.sites, ["site_id"], self_id="site_id", ref_id="site_id", by=["material_id"])
    counted = P.count_within(near, x.sites, ["site_id"], 100.0, ref_id="site_id", by=["material_id"], exclude_same=("site_id", "site_id"))
    return counted.select("site_id", F.col("nearest_km").isNull().alias("alone"), r6(F.col("nearest_km")).alias("nearest_km"), "n_within")


@query("j7_purge", f"SELECT cell_id FROM cells c WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.site_id % 5 = 0 AND {_KM} < 50)")
def _(x):
    return P.purge(x.cells, x.sites.where("site_id % 5 = 0"), ["cell_id"], 50.0, held_id="site_id").select("cell_id")


@query("j8_raster_lookup_join", "SELECT cell_id, CAST(floor((38 - lat) / 25e-2) AS BIGINT) AS row, CAST(floor((lon - 68) / 25e-2) AS BIGINT) AS col, r.value FROM cells LEFT JOIN raster r ON r.row = CAST(floor((38 - lat) / 25e-2) AS BIGINT) AND r.col = CAST(floor((lon - 68) / 25e-2) AS BIGINT)")
def _(x):
    from ..operators import raster as A
    from .fixtures import GRID

    return A.lookup(x.cells, x.raster, GRID).select("cell_id", "row", "col", "value")


@query("j9_bbox_candidates", "SELECT region_id, cell_id FROM (SELECT region_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vertices GROUP BY 1) JOIN cells ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1")
def _(x):
    boxes = x.vertices.groupBy("region_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return P.bbox_candidates(boxes, x.cells, "region_id").select("region_id", "cell_id")


@query("j10_tag_join", ", n AS (SELECT s_suppkey, unnest([s_nationkey, (s_nationkey + 7) % 25, s_nationkey, 99]) AS k, unnest([0, 1, 2, 3]) AS p FROM supplier), f AS (SELECT s_suppkey, n_name, min(p) AS p FROM n JOIN nation ON k = n_nationkey GROUP BY 1, 2) SELECT s_suppkey, array_to_string(list(n_name ORDER BY p), ',') AS names FROM f GROUP BY 1")
def _(x):
    k = F.col("s_nationkey").cast("int")
    tagged = x.supplier.select("s_suppkey", F.array(k, (k + 7) % 25, k, F.lit(99)).alias("tags"))
    return R.tag_join(tagged, ["s_suppkey"], "tags", x.nation.withColumn("n_nationkey", F.col("n_nationkey").cast("int")), "n_nationkey", "n_name", "names").select("s_suppkey", F.array_join("names", ",").alias("names"))


@query("j11_alias_join", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'construction' WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN lower(c_mktsegment) END AS target, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'override' WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'exact_name' ELSE 'unmatched' END AS method, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 2 WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 1 ELSE 0 END AS n_targets FROM customer")
def _(x):
    names = x.customer.select(F.lower("c_mktsegment").alias("key")).distinct()
    exact = names.where("key in ('machinery', 'furniture')").withColumn("target", F.col("key"))
    overrides = names.where("key = 'building'").withColumn("target", F.lit("construction")).union(names.where("key = 'household'").select("key", F.explode(F.array(F.lit("home"), F.lit("house"))).alias("target")))
    return R.alias_join(x.customer.select("c_custkey", "c_mktsegment"), F.lower("c_mktsegment"), overrides, exact).drop("c_mktsegment")


@query("j12_semi_anti", "SELECT cell_id, unit_id IN (SELECT unit_id FROM sites WHERE material_id = 3) AS wanted FROM cells WHERE unit_id IS NOT NULL AND unit_id NOT IN (SELECT unit_id FROM sites WHERE material_id = 5 AND site_id % 7 = 0)")
def _(x):
    cells = x.cells.where("unit_id is not null")
    kept = R.anti(cells, x.sites.where("material_id = 5 and site_id % 7 = 0"), ["unit_id"])
    wanted = R.semi(kept, x.sites.where("material_id = 3"), ["unit_id"]).select("cell_id", F.lit(True).alias("w"))
    return kept.join(wanted, "cell_id", "left").select("cell_id", F.coalesce("w", F.lit(False)).alias("wanted"))


@query("j13_context_inherit", "SELECT cell_id, unit_id, n, latest < 1400 AS profile_outdated FROM cells JOIN (SELECT unit_id, count(*) AS n, max(site_id) AS latest FROM sites GROUP BY 1) USING (unit_id)")
def _(x):
    profile = x.sites.groupBy("unit_id").agg(F.count("*").alias("n"), F.max("site_id").alias("latest"))
    return R.context_inherit(x.cells, profile, "unit_id", "latest", 1400).select("cell_id", "unit_id", "n", "profile_outdated")


@query("j14_reconcile", ", a AS (SELECT record_id, code AS v FROM inspections WHERE record_id % 5 <> 0), b AS (SELECT record_id, CASE WHEN record_id % 4 = 0 THEN code + 10 ELSE code END AS v FROM inspections WHERE record_id % 7 <> 0) SELECT record_id, a.v AS code_a, b.v AS code_b, CASE WHEN a.record_id IS NULL THEN 'only_b' WHEN b.record_id IS NULL THEN 'only_a' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'agree' ELSE 'differ' END AS status, round(abs(a.v - b.v) / b.v * 100, 6) AS difference_pct FROM a FULL JOIN b USING (record_id)")
def _(x):
    a = x.inspections.where("record_id % 5 <> 0")
    b = x.inspections.where("record_id % 7 <> 0").withColumn("code", F.when(F.col("record_id") % 4 == 0, F.col("code") + 10).otherwise(F.col("code")))
    return R.reconcile(a, b, ["record_id"], "code").withColumn("difference_pct", r6(F.col("difference_pct")))


@query("j15_lineage_link", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 0)")
def _(x):
    return R.unlinked(x.lineitem.withColumnRenamed("l_orderkey", "key"), x.orders.where("o_custkey % 10 <> 0").select(F.col("o_orderkey").alias("key")), "key").select(F.col("key").alias("l_orderkey"), "l_linenumber")


@query("j16_catalog_reconcile", "SELECT o_orderkey AS key, o_orderkey % 3 <> 0 AS in_a, o_orderkey % 5 <> 0 AS in_b, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN false WHEN o_orderkey % 3 <> 0 THEN o_custkey % 2 = 0 ELSE true END AS valid_box, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS passed FROM orders")
def _(x):
    box = lambda ok: [F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(ok, 1.0).otherwise(-1.0).alias("x1"), F.lit(1.0).alias("y1")]
    o = x.orders.withColumnRenamed("o_orderkey", "key")
    return R.catalog_reconcile(o.select("key"), o.where("key % 3 <> 0").select("key", *box(F.col("o_custkey") % 2 == 0)), o.where("key % 5 <> 0").select("key", *box(F.lit(True))), "key")


@query("j17_select_document", "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 7 ELSE (SELECT max(c_custkey) FROM customer WHERE c_nationkey = s_nationkey AND regexp_matches(c_name, '[02468]$')) END AS document FROM supplier")
def _(x):
    rows = x.supplier.select("s_suppkey", "s_nationkey", F.lit("[02468]$").alias("pattern"), F.when(F.col("s_suppkey") % 9 == 0, F.lit(7).cast("long")).alias("pinned"))
    docs = x.customer.select(F.col("c_nationkey").alias("s_nationkey"), "c_name", "c_custkey")
    return R.select_document(rows, ["s_suppkey"], docs, "s_nationkey", "pattern", "c_name", "c_custkey", "pinned").select("s_suppkey", "document")


# --- aggregations -----------------------------------------------------------------------------

_DAYS = ", days AS (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY point_id, parameter, obs_date ORDER BY event_id) = 1), clean AS (SELECT point_id, parameter, obs_date, CASE WHEN value > -900 THEN value END AS value FROM days)"
_WINDOW_DAYS = ", days AS (SELECT * FROM series WHERE obs_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-27' QUALIFY row_number() OVER (PARTITION BY point_id, parameter, obs_date ORDER BY event_id) = 1), clean AS (SELECT point_id, parameter, obs_date, CASE WHEN value > -900 THEN value END AS value FROM days)"


def _summary(x):
    s = x.series.withColumn("value", C.null_sentinels(F.col("value"), -900))
    lo, hi = "2024-01-03", "2024-01-27"
    return R.rolling_summary(s, ["point_id", "parameter"], "obs_date", "value", lo, hi, [F.col("event_id")])


@query("a1_rolling_summary", _WINDOW_DAYS + " SELECT point_id, parameter, round(avg(value), 6) AS mean_value, round(sum(value), 6) AS sum_value, count(value) AS valid_days FROM clean GROUP BY 1, 2")
def _(x):
    return _summary(x).select("point_id", "parameter", r6("mean_value").alias("mean_value"), r6("sum_value").alias("sum_value"), "valid_days")


@query("a2_completeness", _WINDOW_DAYS + ", n AS (SELECT point_id, parameter, count(value) AS v FROM clean GROUP BY 1, 2), p AS (SELECT DISTINCT point_id FROM n), w AS (SELECT point_id, coalesce(max(v) FILTER (parameter = 'click'), 0) AS c, coalesce(max(v) FILTER (parameter = 'view'), 0) AS d FROM n GROUP BY 1) SELECT point_id, least(c, d) AS min_valid_days, round(100 * least(c, d) / 30e0, 6) AS complete_pct FROM w")
def _(x):
    return R.completeness(_summary(x), "point_id", "parameter", ["click", "view"], 30).withColumn("complete_pct", r6(F.col("complete_pct")))


@query("a3_monthly_profile", ", m AS (SELECT point_id, strftime(obs_date, '%Y-%m') AS month, avg(value) AS mean FROM series WHERE value > -900 GROUP BY 1, 2), p AS (SELECT DISTINCT point_id FROM series WHERE value > -900), k AS (SELECT unnest(['2024-01', '2024-02', '2024-03']) AS month) SELECT point_id, array_to_string(list(k.month || '=' || coalesce(CAST(CAST(round(mean) AS BIGINT) AS VARCHAR), 'null') ORDER BY k.month), ',') AS profile FROM p CROSS JOIN k LEFT JOIN m USING (point_id, month) GROUP BY 1")
def _(x):
    out = R.monthly_profile(x.series.where("value > -900"), "point_id", "obs_date", "value", ["2024-01", "2024-02", "2024-03"])
    text = F.transform("months", lambda m: F.concat_ws("=", m["month"], F.coalesce(F.round(m["mean"]).cast("long").cast("string"), F.lit("null"))))
    return out.select("point_id", F.array_join(text, ",").alias("profile"))


@query("a4_group_counts", "SELECT unit_id, count(*) AS count FROM cells WHERE unit_id IS NOT NULL GROUP BY 1")
def _(x):
    return R.group_counts(x.cells, "unit_id")


_AFFINITY = ", pos AS (SELECT material_id, unit_id, count(*) AS p FROM sites WHERE unit_id IS NOT NULL GROUP BY 1, 2), tot AS (SELECT unit_id, count(*) AS t FROM cells WHERE unit_id IS NOT NULL GROUP BY 1), raw AS (SELECT material_id, unit_id, (p + 5e-1) / (coalesce(t, 0) + 5) AS raw FROM pos LEFT JOIN tot USING (unit_id)), aff AS (SELECT material_id, unit_id, least(1e0, raw / greatest(quantile_cont(raw, 95e-2) OVER (PARTITION BY material_id), 1e-9)) AS affinity FROM raw)"


@query("a5_smoothed_affinity", _AFFINITY + " SELECT material_id, unit_id, round(affinity, 6) AS affinity FROM aff")
def _(x):
    return R.smoothed_affinity(x.sites, x.cells, "unit_id", ["material_id"]).withColumn("affinity", r6(F.col("affinity")))


@query("a6_ordered_distinct", ", f AS (SELECT user_id, lower(event_type) AS low, min(event_id) AS o, arg_min(event_type, event_id) AS v FROM events GROUP BY 1, 2) SELECT user_id, array_to_string(list(v ORDER BY o), ',') AS first_seen, array_to_string(list(low ORDER BY low), ',') AS sorted_set FROM f GROUP BY 1")
def _(x):
    out = R.ordered_distinct(x.events, ["user_id"], "event_type", "event_id")
    return out.select("user_id", F.array_join("first_seen", ",").alias("first_seen"), F.array_join("sorted_set", ",").alias("sorted_set"))


@query("a7_event_rollup", "SELECT mine, count(*) AS n_events, min(inspected_on) AS first_date, max(inspected_on) AS last_date, coalesce(array_to_string(list_sort(list(DISTINCT year(inspected_on)) FILTER (inspected_on IS NOT NULL)), ','), '') AS years, array_to_string(list(record_id ORDER BY record_id), ',') AS event_ids FROM inspections GROUP BY 1")
def _(x):
    out = R.event_rollup(x.inspections, ["mine"], "inspected_on", "record_id")
    return out.withColumns({"years": F.array_join(F.col("years").cast("array<string>"), ","), "event_ids": F.array_join(F.col("event_ids").cast("array<string>"), ",")})


@query("a8_sample_rollup", ", s AS (SELECT point_id, parameter, event_id, CASE WHEN value > -900 THEN value END AS value FROM series), f AS (SELECT point_id, parameter, min(event_id) AS o, count(value) AS n, count(*) AS c, avg(value) AS v FROM s GROUP BY 1, 2) SELECT point_id, CAST(sum(n) AS BIGINT) AS n_measured, CAST(sum(c) - sum(n) AS BIGINT) AS n_missing, count(*) AS n_parameters, array_to_string(list(parameter ORDER BY o), ',') AS parameters, round(max(v) FILTER (parameter = 'click'), 6) AS mean_click FROM f GROUP BY 1")
def _(x):
    s = x.series.withColumn("value", C.null_sentinels(F.col("value"), -900))
    out = R.sample_rollup(s, "point_id", "parameter", "value", "event_id", ["click"])
    return out.withColumns({"parameters": F.array_join("parameters", ","), "mean_click": r6(F.col("mean_click"))})


@query("a9_taxonomy_rollup", ", t AS (SELECT DISTINCT p_partkey, p_brand, p_type, unnest(string_split(p_name, ' ')) AS tag FROM part), d AS (SELECT DISTINCT tag FROM t UNION SELECT 'absent') SELECT d.tag, count(p_partkey) AS n_rows, count(DISTINCT p_brand) AS n_offices, coalesce(array_to_string(list_sort(list(DISTINCT p_type) FILTER (p_type IS NOT NULL)), ','), '') AS sources FROM d LEFT JOIN t USING (tag) GROUP BY 1")
def _(x):
    rows = x.part.select(F.split("p_name", " ").alias("tags"), "p_brand", "p_type")
    dim = rows.select(F.explode("tags").alias("tag")).union(x.spark.createDataFrame([("absent",)], "tag string"))
    return R.taxonomy_rollup(rows, "tags", dim, "tag", "p_brand", "p_type").withColumn("sources", F.array_join("sources", ","))


@query("a10_dimension_totals", ", t AS (SELECT l_returnflag AS flag, l_linestatus AS status, CAST(l_quantity AS BIGINT) AS q FROM lineitem) SELECT 'flag' AS dimension, flag AS category, false AS is_total, count(*) AS n_lines, CAST(sum(q) AS BIGINT) AS quantity FROM t GROUP BY 2 UNION ALL SELECT 'flag', 'TOTAL', true, count(*), CAST(sum(q) AS BIGINT) FROM t UNION ALL SELECT 'status', status, false, count(*), CAST(sum(q) AS BIGINT) FROM t GROUP BY 2 UNION ALL SELECT 'status', 'TOTAL', true, count(*), CAST(sum(q) AS BIGINT) FROM t")
def _(x):
    t = x.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("long").alias("q"))
    return R.dimension_totals(t, ["flag", "status"], {"n_lines": F.lit(1).cast("long"), "quantity": F.col("q")})


@query("a11_conditional_counts", "SELECT label, count(*) AS n_samples, count(*) FILTER (b02 > b03) AS n_bright, count(*) FILTER (b12 > 0) AS n_clear, round(avg(CASE WHEN b02 > b03 THEN 1e0 ELSE 0 END), 6) AS share_bright, round(avg(CASE WHEN b12 > 0 THEN 1e0 ELSE 0 END), 6) AS share_clear FROM bands GROUP BY 1")
def _(x):
    out = R.conditional_counts(x.bands, ["label"], {"bright": F.col("b02") > F.col("b03"), "clear": F.col("b12") > 0})
    return out.withColumns({c: r6(F.col(c)) for c in ("share_bright", "share_clear")})


@query("a12_masked_median", "SELECT label, round(quantile_cont(b02, 5e-1) FILTER (b12 > 0), 6) AS median FROM bands GROUP BY 1")
def _(x):
    return R.masked_median(x.bands, ["label"], F.col("b02"), F.col("b12") > 0).withColumn("median", r6(F.col("median")))


@query("a13_multi_season_pool", "SELECT label, count(*) AS n_samples, count(*) FILTER (b02 > b03) AS n_bright, round(avg(CASE WHEN b02 > b03 THEN 1e0 ELSE 0 END), 6) AS share_bright, round(quantile_cont(b08, 5e-1) FILTER (b12 > 0), 6) AS median FROM bands GROUP BY 1")
def _(x):
    dry = F.coalesce(F.col("b08") >= F.col("b12"), F.lit(False))
    seasons = {"dry": x.bands.where(dry), "post": x.bands.where(~dry)}
    out = R.multi_season_pool(seasons, ["label"], {"bright": F.col("b02") > F.col("b03")}, F.col("b08"), F.col("b12") > 0)
    return out.withColumns({c: r6(F.col(c)) for c in ("share_bright", "median")})


@query("a14_robust_z", ", v AS (SELECT row, col, value FROM raster WHERE value <> -999), m AS (SELECT quantile_cont(value, 5e-1) AS m FROM v), d AS (SELECT quantile_cont(abs(value - m), 5e-1) AS mad FROM v, m) SELECT row, col, round((value - m) / (14826e-4 * mad), 6) AS robust_z FROM v, m, d")
def _(x):
    return R.robust_z(x.raster.where("value <> -999"), "value").select("row", "col", r6("robust_z").alias("robust_z"))


@query("a15_zonal_sum", f", p AS (SELECT row, col, CASE WHEN value <> -999 THEN value END AS value, 38 - (row + 5e-1) * 25e-2 AS lat, 68 + (col + 5e-1) * 25e-2 AS lon FROM raster), h AS (SELECT c.row, c.col, e.region_id FROM p c CROSS JOIN edges e GROUP BY c.row, c.col, c.lat, c.lon, e.region_id HAVING {inside('c.lon', 'c.lat')}), z AS (SELECT row, col, min(region_id) AS region_id FROM h GROUP BY 1, 2), s AS (SELECT region_id, CAST(round(sum(value)) AS BIGINT) AS total FROM z JOIN p USING (row, col) GROUP BY 1) SELECT region_id, coalesce(total, 0) AS total FROM (SELECT DISTINCT region_id FROM vertices) LEFT JOIN s USING (region_id)")
def _(x):
    from ..operators import raster as A
    from .fixtures import GRID

    return A.zonal_sum(x.raster, GRID, x.vertices, "region_id")


@query("a15_zonal_parts", f", p AS (SELECT row, col, CASE WHEN value <> -999 THEN value END AS value, 38 - (row + 5e-1) * 25e-2 AS lat, 68 + (col + 5e-1) * 25e-2 AS lon FROM raster), h AS (SELECT c.row, c.col, e.district_id FROM p c CROSS JOIN dedges e GROUP BY c.row, c.col, c.lat, c.lon, e.district_id, e.part HAVING {inside('c.lon', 'c.lat')}), z AS (SELECT row, col, min(district_id) AS district_id FROM h GROUP BY 1, 2), s AS (SELECT district_id, CAST(round(sum(value)) AS BIGINT) AS total FROM z JOIN p USING (row, col) GROUP BY 1) SELECT district_id, coalesce(total, 0) AS total FROM (SELECT DISTINCT district_id FROM districts) LEFT JOIN s USING (district_id)")
def _(x):
    from ..operators import raster as A
    from .fixtures import GRID

    return A.zonal_sum(x.raster, GRID, x.districts, "district_id")


@query("a16_term_frequency", ", t AS (SELECT DISTINCT p_partkey, lower(trim(unnest(string_split(p_name || ' ' || p_type, ' ')))) AS term FROM part) SELECT term, count(*) AS n_rows FROM t WHERE term <> '' GROUP BY 1")
def _(x):
    return R.term_frequency(x.part, ["p_partkey"], ["p_name", "p_type"], " ")


@query("a17_group_invariance", "SELECT l_orderkey, count(DISTINCT l_linestatus) AS n_values, count(DISTINCT l_linestatus) <= 1 AS invariant FROM lineitem GROUP BY 1")
def _(x):
    return R.group_invariance(x.lineitem, "l_orderkey", "l_linestatus")


@query("a18_weighted_average", "SELECT material_id, round(sum(lat * site_id) / sum(site_id), 6) AS weighted FROM sites GROUP BY 1")
def _(x):
    return R.weighted_average(x.sites, ["material_id"], "lat", "site_id").withColumn("weighted", r6(F.col("weighted")))


@query("a19_threshold_shares", ", t AS (SELECT material_id, (site_id % 100) / 1e2 AS v FROM sites) SELECT material_id, round(quantile_cont(v, 5e-1), 6) AS median, round(avg(CASE WHEN v >= 95e-2 THEN 1e0 ELSE 0 END), 6) AS share_0_95, round(avg(CASE WHEN v >= 99e-2 THEN 1e0 ELSE 0 END), 6) AS share_0_99, round(avg(CASE WHEN v >= 995e-3 THEN 1e0 ELSE 0 END), 6) AS share_0_995 FROM t GROUP BY 1")
def _(x):
    t = x.sites.select("material_id", (F.col("site_id") % 100 / 1e2).alias("v"))
    out = R.threshold_shares(t, ["material_id"], "v")
    return out.withColumns({c: r6(F.col(c)) for c in out.columns[1:]})


@query("a20_site_summary", "SELECT unit_id, count(lat) AS n, round(quantile_cont(lat, 5e-1), 6) AS median, min(lat) AS low, max(lat) AS high FROM sites GROUP BY 1")
def _(x):
    return R.site_summary(x.sites, "unit_id", "lat").withColumn("median", r6(F.col("median")))


@query("a21_dedupe", _DAYS + " SELECT point_id, parameter, obs_date, event_id FROM days")
def _(x):
    return R.dedupe(x.series, ["point_id", "parameter", "obs_date"], [F.col("event_id")]).select("point_id", "parameter", "obs_date", "event_id")


@query("a22_display_range", "SELECT 'lat' AS column, round(quantile_cont(lat, 2e-2), 6) AS p02, round(quantile_cont(lat, 98e-2), 6) AS p98, round(quantile_cont(abs(lat), 98e-2), 6) AS abs_p98 FROM sites UNION ALL SELECT 'lon', round(quantile_cont(lon, 2e-2), 6), round(quantile_cont(lon, 98e-2), 6), round(quantile_cont(abs(lon), 98e-2), 6) FROM sites")
def _(x):
    out = R.display_range(x.sites, ["lat", "lon"])
    return out.withColumns({c: r6(F.col(c)) for c in ("p02", "p98", "abs_p98")})


# --- ranking -------------------------------------------------------------------------------------


@query("w1_pct_rank_avg", ", t AS (SELECT site_id, material_id, site_id % 17 AS s, unit_id > 4 AS ok FROM sites), k AS (SELECT site_id, (rank() OVER (PARTITION BY material_id ORDER BY s) + (count(*) OVER (PARTITION BY material_id, s) - 1) / 2e0) / count(*) OVER (PARTITION BY material_id) AS p FROM t WHERE ok) SELECT site_id, round(p, 6) AS percentile FROM t LEFT JOIN k USING (site_id)")
def _(x):
    t = x.sites.select("site_id", "material_id", (F.col("site_id") % 17).alias("s"), (F.col("unit_id") > 4).alias("ok"))
    return R.pct_rank_avg(t, ["material_id"], "s", F.col("ok")).select("site_id", r6("percentile").alias("percentile"))


@query("w3_national_rank", "SELECT p_partkey, n AS national_rank FROM part LEFT JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS n FROM part WHERE p_size > 25) USING (p_partkey)")
def _(x):
    order = [F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")]
    return R.national_rank(x.part, ["p_partkey"], F.col("p_size") > 25, order).select("p_partkey", "national_rank")


@query("w4_latest_per_key", "SELECT mine, record_id, inspected_on FROM inspections QUALIFY row_number() OVER (PARTITION BY mine ORDER BY inspected_on DESC NULLS LAST, record_id DESC) = 1")
def _(x):
    return R.latest_per_key(x.inspections, ["mine"], "inspected_on", [F.desc("record_id")]).select("mine", "record_id", "inspected_on")


@query("w5_canonical_per_lineage", ", t AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT o_custkey, o_orderkey FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT o_custkey, n.o_orderkey, array_to_string(list(t.o_orderkey ORDER BY t.o_orderkey), ',') AS offer_ids, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS names, count(*) AS n_events FROM n JOIN t USING (o_custkey) GROUP BY 1, 2")
def _(x):
    out = R.canonical_per_lineage(x.orders, "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", F.col("o_orderstatus") != "P")
    return out.select("o_custkey", "o_orderkey", F.array_join(F.col("offer_ids").cast("array<string>"), ",").alias("offer_ids"), F.array_join("names", ",").alias("names"), "n_events")


@query("w6_best_scene_per_tile", "SELECT o_custkey AS tile, o_orderkey AS item FROM orders WHERE o_orderkey % 5 > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, o_totalprice, o_orderdate, o_orderkey) = 1")
def _(x):
    items = x.orders.select(F.col("o_custkey").alias("tile"), F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 5).alias("coverage"), "o_totalprice", "o_orderdate")
    return R.best_scene_per_tile(items, "tile", "coverage", "o_totalprice", "o_orderdate", "item").select("tile", "item")


@query("w7_best_pixel_composite", ", t AS (SELECT l_suppkey AS point, l_orderkey AS scene, l_partkey % 4 * 1000000 + l_linenumber * 10000 + least(CAST(l_quantity AS BIGINT) * 300, 9999) AS p, l_partkey FROM lineitem) SELECT point, scene, priority FROM (SELECT point, scene, p AS priority FROM t QUALIFY row_number() OVER (PARTITION BY point ORDER BY p DESC, scene) = 1)")
def _(x):
    obs = x.lineitem.select(F.col("l_suppkey").alias("point"), F.col("l_orderkey").alias("scene"), (F.col("l_partkey") % 4).alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("long") * 300).alias("e"))
    return R.best_pixel_composite(obs, ["point"], "scene", F.col("k"), F.col("n"), F.col("e"), []).select("point", "scene", "priority")


@query("w8_rank_among", "SELECT site_id, CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY material_id ORDER BY s DESC NULLS LAST) END AS rank, CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY material_id ORDER BY s DESC NULLS LAST) = 1 END AS is_top, CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY material_id ORDER BY s DESC NULLS LAST) <= 5 END AS in_top FROM (SELECT site_id, material_id, CASE WHEN site_id % 9 > 0 THEN site_id % 23 END AS s FROM sites)")
def _(x):
    t = x.sites.select("site_id", "material_id", F.when(F.col("site_id") % 9 > 0, F.col("site_id") % 23).alias("s"))
    return R.rank_among(t, "material_id", "s").select("site_id", F.col("rank").cast("long").alias("rank"), "is_top", "in_top")


@query("w9_sequence_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq, 'REC-' || lpad(CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 6, '0') AS record_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS repeat FROM orders")
def _(x):
    out = R.sequence_ids(x.orders.select("o_orderkey", "o_orderdate", "o_custkey"), [F.col("o_orderdate"), F.col("o_orderkey")], "REC-", base="o_custkey")
    return out.select("o_orderkey", "seq", "record_id", F.col("repeat").cast("long").alias("repeat"))


@query("w10_top_n", "SELECT unit_id, count(*) AS n FROM sites GROUP BY 1 ORDER BY n DESC, unit_id LIMIT 15")
def _(x):
    return R.top_n(x.sites.groupBy("unit_id").agg(F.count("*").alias("n")), 15, [F.desc("n"), F.col("unit_id")])


@query("w11_order_output", "SELECT record_id, code, inspected_on FROM inspections ORDER BY code DESC NULLS LAST, inspected_on ASC NULLS FIRST, record_id")
def _(x):
    return R.order_output(x.inspections.select("record_id", "code", "inspected_on"), [("code", "desc", "last"), ("inspected_on", "asc", "first"), ("record_id", "asc", "last")])


# --- sets -------------------------------------------------------------------------------------------


@query("u1_union_by_name", "SELECT s_suppkey AS key, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(x):
    return R.union_by_name(x.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), x.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))


@query("u2_union_distinct", "SELECT unit_id FROM cells UNION SELECT unit_id + 20 FROM sites")
def _(x):
    return R.union_distinct(x.cells.select("unit_id"), x.sites.select((F.col("unit_id") + 20).alias("unit_id")))


@query("u3_symmetric_difference", "(SELECT unit_id, 'a' AS side FROM (SELECT unit_id FROM cells EXCEPT ALL SELECT unit_id FROM sites)) UNION ALL (SELECT unit_id, 'b' FROM (SELECT unit_id FROM sites EXCEPT ALL SELECT unit_id FROM cells))")
def _(x):
    return R.symmetric_difference(x.cells.select("unit_id"), x.sites.select("unit_id"))


@query("u4_missing_and_extra", "SELECT o_orderkey AS key, 'missing' AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3) UNION ALL SELECT DISTINCT l_orderkey + 1000000, 'extra' FROM lineitem WHERE l_linenumber > 6")
def _(x):
    """Shifted keys are extra even where an order has the same number."""
    key = lambda c, shifted: (F.lit(shifted).alias("shifted"), F.col(c).alias("key"))
    actual = x.lineitem.where("l_linenumber > 3").select(*key("l_orderkey", False)).union(x.lineitem.where("l_linenumber > 6").withColumn("l_orderkey", F.col("l_orderkey") + 1000000).select(*key("l_orderkey", True)))
    return R.missing_and_extra(x.orders.select(*key("o_orderkey", False)), actual, ["shifted", "key"]).select("key", "status")


@query("u5_exact_subset", "SELECT c_custkey, c_name, 'b' AS side FROM customer WHERE c_acctbal > 0 AND c_custkey % 50 = 0")
def _(x):
    base = x.customer.select("c_custkey", "c_name", "c_acctbal")
    candidate = base.where("c_acctbal > 0 and c_custkey % 50 <> 0").select("c_custkey", "c_name")
    return R.exact_subset(candidate, base, F.col("c_acctbal") > 0)


@query("u6_disjoint_groups", "SELECT unit_id FROM (SELECT DISTINCT unit_id FROM sites WHERE site_id % 40 = 0 INTERSECT SELECT DISTINCT unit_id FROM sites WHERE site_id % 41 = 0)")
def _(x):
    return R.shared_groups(x.sites.where("site_id % 40 = 0"), x.sites.where("site_id % 41 = 0"), "unit_id")


