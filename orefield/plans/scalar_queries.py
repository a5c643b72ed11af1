"""Queries F1-F28 and P1-P16."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import relational as R
from ..sources import tables as S
from .registry import haversine, query

r6 = lambda c: F.round(c, 6)


@query("f1_clean_text", "SELECT p_partkey, nullif(trim(regexp_replace('  ' || replace(p_name, ' ', '  ' || chr(9)) || ' ', '\\s+', ' ', 'g')), '') AS cleaned, nullif(trim(regexp_replace(CASE WHEN p_partkey % 7 = 0 THEN '   ' END, '\\s+', ' ', 'g')), '') AS blank FROM part")
def _(x):
    dirty = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.concat(F.lit("  "), F.lit("\t"))), F.lit(" "))
    return x.part.select("p_partkey", C.clean_text(dirty).alias("cleaned"), C.clean_text(F.when(F.col("p_partkey") % 7 == 0, "   ")).alias("blank"))


@query("f2_fold_key", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || 'eau' AS folded, regexp_replace(lower(p_name || ' Été'), '[^a-z0-9]+', '-', 'g') IS NOT NULL AS has_slug, trim(regexp_replace(replace(lower(p_name || ' Été'), 'é', 'e'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def _(x):
    return x.part.select("p_partkey", C.fold_key(F.concat("p_name", F.lit("-éàü"))).alias("folded"), C.fold_key(F.concat("p_name", F.lit(" Été")), "-").isNotNull().alias("has_slug"), C.fold_key(F.concat("p_name", F.lit(" Été")), "-").alias("slug"))


@query("f3_is_blank_token", "SELECT o_orderkey, o_orderkey % 8 <> 7 AS is_blank FROM orders")
def _(x):
    tokens = ["nil", " NA ", "None", "Not  Issued", "--", "-", "nan", "value"]
    pick = F.element_at(F.array(*map(F.lit, tokens)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return x.orders.select("o_orderkey", C.is_blank_token(pick).alias("is_blank"))


@query("f4_normalise_alias", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'HOUSEHOLD' THEN 'Home' ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS segment FROM customer")
def _(x):
    return x.customer.select("c_custkey", C.normalise_alias("c_mktsegment", {"building": "Construction", "household": "Home"}).alias("segment"))


_TAGS = {"the_word": [r" the "], "digits": [r"[0-9]{4,}"], "license": ["license", "licence"], "german": [r" und ", r" die "]}


@query("f5_multi_pattern_tags", "SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)(?: the )') THEN 'the_word' END, CASE WHEN regexp_matches(text, '(?i)(?:[0-9]{4,})') THEN 'digits' END, CASE WHEN regexp_matches(text, '(?i)(?:license)|(?:licence)') THEN 'license' END, CASE WHEN regexp_matches(text, '(?i)(?: und )|(?: die )') THEN 'german' END], lambda v: v IS NOT NULL), ',') AS tags FROM documents")
def _(x):
    return x.documents.select("doc_id", F.array_join(C.multi_pattern_tags("text", _TAGS), ",").alias("tags"))


@query("f6_substring_tags", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(lower(p_type), 'steel') THEN 'Fe' END, CASE WHEN contains(lower(p_type), 'copper') THEN 'Cu' END, CASE WHEN contains(lower(p_type), 'tin') THEN 'Sn' END], lambda v: v IS NOT NULL), ',') AS formulae FROM part")
def _(x):
    return x.part.select("p_partkey", F.array_join(C.substring_tags("p_type", {"steel": "Fe", "copper": "Cu", "tin": "Sn"}), ",").alias("formulae"))


@query("f7_extract_code", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X1' WHEN o_orderkey % 3 = 1 THEN '12ABC' || lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') END AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'explicit' WHEN o_orderkey % 3 = 1 THEN 'parsed_from_text' END AS basis FROM orders")
def _(x):
    explicit = F.when(F.col("o_orderkey") % 3 == 0, "X1").otherwise("nil")
    text = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("mine 12abc"), F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0"), F.lit(" north"))).otherwise("mine")
    code, basis = C.extract_code(explicit, text, r"\b\d{2}[A-Z]{3}\d{5}\b")
    return x.orders.select("o_orderkey", code.alias("code"), basis.alias("basis"))


@query("f8_extract_area", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size * 1000e0 WHEN p_partkey % 4 = 1 THEN p_size + 5e-1 END AS area, CASE WHEN p_partkey % 4 = 0 THEN 'explicit' WHEN p_partkey % 4 = 1 THEN 'parsed_from_text' END AS basis FROM part")
def _(x):
    explicit = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(",000 ha"))).otherwise("na")
    text = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("lease of "), F.col("p_size").cast("string"), F.lit(".5 hectares"))).otherwise("lease")
    area, basis = C.extract_area(explicit, text)
    return x.part.select("p_partkey", area.alias("area"), basis.alias("basis"))


@query("f9_parse_dirty_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders")
def _(x):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "dd-MM-yyyy"))
        .when(k == 1, F.concat(F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMMM yyyy")))
        .when(k == 2, F.concat(F.date_format(d, "dd.MM.yyyy"), F.lit(" (AN)")))
        .when(k == 3, F.date_format(d, "d/M/yyyy"))
        .when(k == 4, F.concat(F.date_format(d, "d"), F.lit("rd & 4th "), F.date_format(d, "MMMM yyyy")))
        .otherwise("nil")
    )
    return x.orders.select("o_orderkey", C.parse_dirty_date(text).alias("parsed"))


@query("f10_in_fiscal_year", "SELECT record_id, inspected_on >= make_date(fiscal_year, 4, 1) AND inspected_on <= make_date(fiscal_year + 1, 3, 31) AS inside FROM inspections")
def _(x):
    label = F.concat(F.col("fiscal_year").cast("string"), F.lit("-"), F.lpad(((F.col("fiscal_year") + 1) % 100).cast("string"), 2, "0"))
    return x.inspections.select("record_id", C.in_fiscal_year("inspected_on", label).alias("inside"))


@query("f11_date_from_year_doy", "SELECT event_id, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m') AS month FROM events")
def _(x):
    day = C.date_from_year_doy(F.year("ts"), F.dayofyear("ts"))
    return x.events.select("event_id", day.alias("day"), F.date_format(day, "yyyy-MM").alias("month"))


@query("f12_dms_to_decimal", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE round((CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END) * (p_partkey % 90 + (p_partkey % 60) / 60e0 + (p_size % 60) / 3600e0), 6) END AS decimal_degrees FROM part")
def _(x):
    k = F.col("p_partkey")
    text = F.when(k % 9 == 0, "no coordinate").otherwise(F.format_string("%d° %d' %d\" %s", k % 90, k % 60, F.col("p_size") % 60, F.when(k % 2 == 0, "S").otherwise("N")))
    return x.part.select("p_partkey", r6(C.dms_to_decimal(text)).alias("decimal_degrees"))


@query("f13_parse_coordinate_range", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN round(p_partkey % 80 + 16e0 / 60, 6) WHEN 1 THEN p_partkey % 80 + 5e-1 WHEN 2 THEN round(p_partkey % 80 + 10e0 / 60, 6) END AS lower,
CASE p_partkey % 5 WHEN 0 THEN round(p_partkey % 80 + 25e0 / 60 + 30e0 / 3600, 6) WHEN 1 THEN p_partkey % 80 + 5e-1 WHEN 2 THEN round(p_partkey % 80 + 20e0 / 60, 6) END AS upper, CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 5 = 2 END AS odd FROM part""")
def _(x):
    d = (F.col("p_partkey") % 80).cast("string")
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(d, F.lit(" 16-"), d, F.lit(" 25 30 N"))).when(k == 1, F.concat(d, F.lit("° 30 N"))).when(k == 2, F.concat(d, F.lit(" 10 "), d, F.lit(" 20 N"))).when(k == 3, F.concat(d, F.lit(" 10 E"))).otherwise(F.concat(d, F.lit(" 10")))
    c = C.parse_coordinate_range(text, "latitude")
    return x.part.select("p_partkey", r6(c["lower"]).alias("lower"), r6(c["upper"]).alias("upper"), c["odd"].alias("odd"))


@query("f14_text_between", "SELECT doc_id, CASE WHEN strpos(text, '. ') > 0 THEN left(split_part(split_part(text[strpos(text, '. ') + 2:], '.', 1), ',', 1), 80) END AS section FROM documents")
def _(x):
    return x.documents.select("doc_id", C.text_between("text", ". ", [".", ","], 80).alias("section"))


@query("f15_term_found", "SELECT p_partkey, p_partkey % 4 < 3 AS found FROM part")
def _(x):
    name = F.regexp_replace("p_name", "[^a-z]", "")
    long = F.concat(F.lit("abcdef"), name)
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("near "), F.upper(long), F.lit(" hill"))).when(k == 1, F.concat(F.lit("near abc def"), name)).when(k == 2, F.concat(F.lit("near "), long, F.lit(" mine"))).otherwise("nothing here")
    term = F.when(k == 2, F.concat(long, F.lit(" coalfield"))).otherwise(long)
    return x.part.select("p_partkey", C.term_found(term, text, suffixes=["coalfield"]).alias("found"))


@query("f16_haversine_km", f"SELECT site_id, round({haversine('lat', 'lon', '20e0', '80e0')}, 6) AS km FROM sites")
def _(x):
    return x.sites.select("site_id", r6(C.haversine_km(F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(80.0))).alias("km"))


@query("f17_decay_clip_support", "SELECT c_custkey, round(exp(-(c_custkey % 500) / 100e0), 6) AS decay, round(least(greatest(c_acctbal / 1e4, 0), 1), 6) AS clipped, round(4e-1 + 6e-1 * least(1e0, ln(1 + c_custkey % 40) / ln(21)), 6) AS support FROM customer")
def _(x):
    k = F.col("c_custkey")
    return x.customer.select("c_custkey", r6(C.distance_decay((k % 500).cast("double"))).alias("decay"), r6(C.clip(F.col("c_acctbal").cast("double") / 1e4)).alias("clipped"), r6(C.support_weight(k % 40)).alias("support"))


@query("f18_spectral_indices", "SELECT vec_id, round(CASE WHEN b08 > 0 AND b04 > 0 AND b08 + b04 > 1e-6 THEN (b08 - b04) / (b08 + b04) END, 6) AS ndvi, round(CASE WHEN b11 > 0 AND b12 > 0 AND b11 + b12 > 1e-6 THEN (b11 - b12) / (b11 + b12) END, 6) AS ndti, round(CASE WHEN b02 > 0 AND b04 > 0 AND b08 > 0 AND b11 > 0 AND (b11 + b04) + (b08 + b02) > 1e-6 THEN ((b11 + b04) - (b08 + b02)) / ((b11 + b04) + (b08 + b02)) END, 6) AS bsi, round(CASE WHEN b04 > 0 AND b02 > 1e-6 THEN b04 / b02 END, 3) AS red_blue FROM bands")
def _(x):
    b = {n: F.col(n) for n in ("b02", "b03", "b04", "b08", "b11", "b12")}
    return x.bands.select("vec_id", r6(C.normalized_difference(b["b08"], b["b04"])).alias("ndvi"), r6(C.normalized_difference(b["b11"], b["b12"])).alias("ndti"), r6(C.bare_soil_index(b["b02"], b["b04"], b["b08"], b["b11"])).alias("bsi"), F.round(C.positive_ratio(b["b04"], b["b02"]), 3).alias("red_blue"))


@query("f19_json_profile", """SELECT p_partkey, '{"name":"' || p_name || '","unit":' || coalesce(CAST(unit_id AS VARCHAR), 'null') || ',"note":"é"}' AS profile FROM part JOIN cells ON p_partkey = cell_id""")
def _(x):
    unit = F.when(F.col("p_partkey") % 50 == 0, None).otherwise(F.col("p_partkey") * 13 % 37)
    return x.part.select("p_partkey", C.json_profile(F.col("p_name").alias("name"), unit.alias("unit"), F.lit("é").alias("note")).alias("profile"))


@query("f20_json_array_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) || '|x' ELSE '' END AS parts FROM orders")
def _(x):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit('["'), F.col("o_custkey").cast("string"), F.lit('","x"]'))).when(k == 1, "[broken")
    return x.orders.select("o_orderkey", F.array_join(C.json_array_parse(text), "|").alias("parts"))


@query("f21_stable_id", "SELECT record_id, 'REC-' || left(sha256(office || '|' || coalesce(CAST(code AS VARCHAR), '')), 16) AS stable_id FROM inspections")
def _(x):
    return x.inspections.select("record_id", C.stable_id("REC-", F.col("office"), F.col("code")).alias("stable_id"))


@query("f22_row_hash", """SELECT c_custkey, sha256('["' || c_custkey || '","' || c_name || '","' || c_nationkey || '"]') AS row_sha256 FROM customer""")
def _(x):
    return x.customer.select("c_custkey", C.row_hash(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey")).alias("row_sha256"))


@query("f23_identity_key", "SELECT record_id, CASE WHEN code IS NOT NULL THEN 'code:' || code ELSE 'name:' || regexp_replace(lower(office), '[^a-z0-9]+', '', 'g') || '|' || mine END AS identity, CASE WHEN code IS NOT NULL THEN 'code' ELSE 'normalised_composite' END AS method FROM inspections")
def _(x):
    key, method = C.identity_key(F.col("code").cast("string"), "office", F.col("mine").cast("string"))
    return x.inspections.select("record_id", key.alias("identity"), method.alias("method"))


@query("f24_lineage_key", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '\\b(block|cluster)\\b', ' ', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS lineage FROM part")
def _(x):
    text = F.concat("p_name", F.lit(" Block Iron tranche"))
    return x.part.select("p_partkey", C.lineage_key(text, {"colour": "color"}, ["iron", "gold"], ["block", "cluster"]).alias("lineage"))


@query("f25_parameter_semantics", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'major_oxide' WHEN 1 THEN 'isotope_ratio' WHEN 2 THEN 'trace_element' WHEN 3 THEN 'element' ELSE 'chemical_parameter' END AS kind, CASE l_linenumber % 5 WHEN 0 THEN 'Al,O' WHEN 1 THEN 'Sr' WHEN 2 THEN 'Cu' WHEN 3 THEN 'F' ELSE 'L,O,I' END AS symbols FROM lineitem")
def _(x):
    names = F.array(*map(F.lit, ["Al2O3", "87Sr/86Sr", "Cu", "F", "LOI"]))
    kind, symbols = C.parameter_semantics(F.element_at(names, F.col("l_linenumber") % 5 + 1), ["Al2O3", "SiO2"], ["87Sr/86Sr", "eNd"])
    return x.lineitem.select("l_orderkey", "l_linenumber", kind.alias("kind"), F.array_join(symbols, ",").alias("symbols"))


@query("f26_to_number_pad_code", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey * 1000e0 END AS number, lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS code FROM supplier")
def _(x):
    text = F.when(F.col("s_suppkey") % 5 == 0, "n/a").otherwise(F.concat(F.col("s_suppkey").cast("string"), F.lit(",000")))
    return x.supplier.select("s_suppkey", C.to_number(text).alias("number"), C.pad_code(F.col("s_nationkey").cast("string"), 3).alias("code"))


@query("f27_concat_fields", "SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END, p_type) AS search_text FROM part")
def _(x):
    return x.part.select("p_partkey", C.concat_fields("p_name", F.when(F.col("p_partkey") % 2 == 1, F.col("p_brand")), "p_type").alias("search_text"))


@query("f28_event_list", "SELECT mine, coalesce(array_to_string(list(e ORDER BY inspected_on IS NULL, inspected_on, kind, detail) FILTER (e IS NOT NULL), ','), '') AS events FROM (SELECT DISTINCT mine, inspected_on, kind, detail, CASE WHEN detail IS NOT NULL THEN kind || ':' || detail || ':' || coalesce(CAST(inspected_on AS VARCHAR), 'undated') END AS e FROM (SELECT mine, inspected_on, 'inspected' AS kind, CAST(record_id AS VARCHAR) AS detail FROM inspections UNION ALL SELECT mine, NULL, 'coded', CAST(code AS VARCHAR) FROM inspections)) GROUP BY mine")
def _(x):
    rows = x.inspections.withColumn("no_date", F.lit(None).cast("date"))
    out = R.event_list(rows, ["mine"], {"inspected": ("inspected_on", "record_id"), "coded": ("no_date", "code")})
    text = F.transform("events", lambda e: F.concat_ws(":", e["event_type"], e["detail"], F.coalesce(e["event_date"].cast("string"), F.lit("undated"))))
    return out.select("mine", F.array_join(text, ",").alias("events"))


# --- projections and predicates ------------------------------------------------------------


@query("p1_project", "SELECT c_custkey AS id, c_name AS name FROM customer")
def _(x):
    return S.project(x.customer, {"c_custkey": "id", "c_name": "name", "absent": "other"}, ["id", "name", "missing"])


@query("p2_null_sentinels", "SELECT event_id, CASE WHEN value <= -900 OR value >= 90000 OR abs(value - 5) <= 1e-6 THEN NULL ELSE value END AS value FROM series")
def _(x):
    return x.series.select("event_id", C.null_sentinels(F.col("value"), -900, 90000, 5).alias("value"))


@query("p3_within_bounds", "SELECT site_id, lat BETWEEN 10 AND 30 AND lon BETWEEN 70 AND 90 AS in_bounds FROM sites")
def _(x):
    return S.within_bounds(x.sites, "lat", "lon", (10, 30, 70, 90)).select("site_id", "in_bounds")


@query("p4_safe_share", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice / (l_linenumber % 3) END, 6) AS share, round(CASE WHEN l_tax > 0 THEN abs(l_discount) / l_tax END, 6) AS ratio FROM lineitem")
def _(x):
    return x.lineitem.select("l_orderkey", "l_linenumber", r6(C.safe_share(F.col("l_extendedprice").cast("double"), F.col("l_linenumber") % 3)).alias("share"), r6(C.signal_to_error(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"))).alias("ratio"))


@query("p5_pct_difference", "SELECT l_orderkey, l_linenumber, round(abs(total - (a + b)) / (a + b) * 100, 6) AS difference_pct FROM subtotals")
def _(x):
    return x.subtotals.select("l_orderkey", "l_linenumber", r6(C.pct_difference(F.col("total").cast("double"), (F.col("a") + F.col("b")).cast("double"))).alias("difference_pct"))


@query("p6_classify_terrain", "SELECT row, col, CASE WHEN value = -999 THEN 'unavailable' WHEN value >= 3000 THEN 'high_mountain_or_alpine' WHEN col % 30 >= 15 THEN 'steep_mountainous' WHEN col % 30 >= 5 THEN 'hilly' WHEN value < 50 THEN 'coastal_or_lowland' ELSE 'plateau_or_plain' END AS terrain FROM raster")
def _(x):
    return x.raster.select("row", "col", C.classify_terrain(F.when(F.col("value") != -999, F.col("value")), F.col("col") % 30).alias("terrain"))


@query("p7_classify_weather", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'unavailable' WHEN p_size < 10 THEN 'cold_or_highland' WHEN p_size >= 24 AND p_retailprice < 500 THEN 'hot_arid_or_semiarid' WHEN p_size >= 24 AND p_retailprice >= 1500 THEN 'hot_humid' WHEN p_size >= 20 AND p_retailprice >= 800 THEN 'warm_monsoonal' WHEN p_retailprice < 500 THEN 'temperate_semiarid' ELSE 'temperate_monsoonal' END AS weather FROM part")
def _(x):
    return x.part.select("p_partkey", C.classify_weather(F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")), "p_retailprice").alias("weather"))


_TEXTURE = """, t AS (SELECT p_partkey, 100 * s / (s + i + c) AS a, 100 * i / (s + i + c) AS i, 100 * c / (s + i + c) AS c FROM (SELECT p_partkey, p_size * 1e0 AS s, (p_partkey % 47) * 1e0 AS i, (p_partkey % 31 + 1) * 1e0 AS c FROM part))
SELECT p_partkey, CASE WHEN a >= 85 AND i + 15e-1 * c < 15 THEN 'sand' WHEN a >= 70 AND i + 15e-1 * c >= 15 AND i + 2 * c < 30 THEN 'loamy sand' WHEN c >= 40 AND a <= 45 AND i <= 40 THEN 'clay' WHEN c >= 40 AND i > 40 THEN 'silty clay' WHEN c >= 35 AND a > 45 THEN 'sandy clay' WHEN c >= 27 AND c < 40 AND a > 20 AND a <= 45 THEN 'clay loam' WHEN c >= 27 AND c < 40 AND a <= 20 THEN 'silty clay loam' WHEN c >= 20 AND c < 35 AND a > 45 AND i < 28 THEN 'sandy clay loam' WHEN i >= 80 AND c < 12 THEN 'silt' WHEN i >= 50 AND c < 27 THEN 'silt loam' WHEN c >= 7 AND c < 27 AND i >= 28 AND i < 50 AND a <= 52 THEN 'loam' WHEN c < 20 AND a >= 43 AND i < 50 THEN 'sandy loam' ELSE 'loam' END AS texture FROM t"""


@query("p8_classify_texture", _TEXTURE)
def _(x):
    k = F.col("p_partkey")
    return x.part.select("p_partkey", C.classify_texture(F.col("p_size").cast("double"), (k % 47).cast("double"), (k % 31 + 1).cast("double")).alias("texture"))


@query("p9_classify_record", "SELECT site_id, CASE WHEN status IN ('BUILDING', 'MACHINERY') THEN 'known_mine' WHEN status = 'FURNITURE' THEN 'known_plant' ELSE 'status_unknown' END AS record_class FROM sites")
def _(x):
    return x.sites.select("site_id", C.classify_record("status", {"known_mine": ["BUILDING", "MACHINERY"], "known_plant": ["FURNITURE"]}, "status_unknown").alias("record_class"))


@query("p10_classify_support", "SELECT vec_id, CASE WHEN label >= 5 AND vec_id % 10 >= 5 THEN 'two_season_support' WHEN label + vec_id % 10 >= 10 THEN 'one_season_dominant_support' ELSE 'insufficient_support' END AS support FROM bands")
def _(x):
    return x.bands.select("vec_id", C.classify_support("label", F.col("vec_id") % 10, F.col("label") + F.col("vec_id") % 10).alias("support"))


@query("p11_quality_flags", "SELECT cell_id, array_to_string(list_filter([CASE WHEN unit_id IS NULL THEN 'no_unit' END, CASE WHEN lat > 30 THEN 'north' END, CASE WHEN unit_id < 5 THEN 'low_unit' END], lambda v: v IS NOT NULL), ',') AS flags FROM cells")
def _(x):
    return x.cells.select("cell_id", F.array_join(C.quality_flags({"no_unit": F.col("unit_id").isNull(), "north": F.col("lat") > 30, "low_unit": F.col("unit_id") < 5}), ",").alias("flags"))


@query("p12_promote", """, t AS (SELECT p_partkey, p_partkey % 40 AS k, p_partkey % 300 AS d, p_size AS n, 99e-2 + (p_partkey % 11) / 1e3 AS pc, (p_partkey % 100) / 1e2 AS s, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 5e-1 + (p_partkey % 5) / 1e1 END AS auc, (p_partkey % 3) / 1e1 AS rec FROM part)
SELECT p_partkey, CASE WHEN k <= 5 THEN 'known_evidence_area' WHEN d > 25 AND d <= 250 AND n >= 10 AND auc >= 75e-2 AND rec >= 2e-1 AND pc >= 999e-3 AND s >= 55e-2 THEN 'high_priority_candidate' WHEN d > 25 AND d <= 250 AND n >= 10 AND auc >= 6e-1 AND pc >= 995e-3 AND s >= 5e-1 THEN 'priority_candidate' ELSE 'regional_background' END AS record_class,
CASE WHEN auc >= 75e-2 AND rec >= 2e-1 THEN 'strong_holdout' WHEN auc >= 6e-1 THEN 'passes_minimum_holdout' WHEN auc IS NOT NULL THEN 'fails_minimum_holdout' ELSE 'not_spatially_validated' END AS tier FROM t""")
def _(x):
    k = F.col("p_partkey")
    record, tier = C.promote(k % 40, k % 300, F.col("p_size"), 0.99 + k % 11 / 1e3, k % 100 / 1e2, F.when(k % 6 != 0, 0.5 + k % 5 / 1e1), k % 3 / 1e1)
    return x.part.select("p_partkey", record.alias("record_class"), tier.alias("tier"))


@query("p13_numeric_or_token", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN CAST(l_orderkey AS DOUBLE) END AS number, CASE l_linenumber WHEN 1 THEN 'measured_numeric' WHEN 2 THEN 'below_detection' WHEN 3 THEN 'na_token_unresolved' WHEN 4 THEN 'dash' WHEN 5 THEN 'missing' ELSE 'unparsed_text' END AS status FROM lineitem")
def _(x):
    n = F.col("l_linenumber")
    text = F.when(n == 1, F.col("l_orderkey").cast("string")).when(n == 2, "b. d. l.").when(n == 3, "NA").when(n == 4, "–").when(n == 5, " ").otherwise("trace")
    number, status = C.numeric_or_token(text)
    return x.lineitem.select("l_orderkey", "l_linenumber", number.alias("number"), status.alias("status"))


@query("p14_unit_scale", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 WHEN 2 THEN 1e0 WHEN 3 THEN 1e0 END * p_size AS quantity, CASE p_partkey % 5 WHEN 3 THEN 'carats' WHEN 4 THEN NULL ELSE 'tonnes' END AS base_unit FROM part")
def _(x):
    unit = F.element_at(F.array(*map(F.lit, ["Million Tonnes", "'000 tonnes", "tonne", "carats", "barrels"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    factor, base = C.unit_scale(unit)
    return x.part.select("p_partkey", (factor * F.col("p_size")).alias("quantity"), base.alias("base_unit"))


@query("p15_complete_rows", "SELECT parameter, round(avg(CASE WHEN value <> -999 AND point_id IS NOT NULL THEN 1e0 ELSE 0 END), 6) AS complete_rate FROM series GROUP BY parameter")
def _(x):
    s = x.series.withColumn("value", C.null_sentinels(F.col("value"), -900))
    return s.groupBy("parameter").agg(r6(F.avg(C.complete("value", "point_id").cast("double"))).alias("complete_rate"))


@query("p16_level_filter", "SELECT l_orderkey, l_linenumber FROM subtotals WHERE a > 25 AND l_linenumber <> 1")
def _(x):
    return S.level_filter(x.subtotals, F.col("a") > 25, F.col("l_linenumber") == 1, keep_totals=False).select("l_orderkey", "l_linenumber")
