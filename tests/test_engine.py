"""Every query with a counterpart equals DuckDB on the small tables; hand-made rows for what those tables do not hold."""

import datetime
import decimal
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from orefield.functions import columns as C
from orefield.operators import cells as G
from orefield.operators import documents as D
from orefield.operators import governance as Q
from orefield.operators import relational as R
from orefield.operators import scoring as M
from orefield.operators import spatial as P
from orefield.plans import catalogue
from orefield.sources import tables as S

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 5) + 0.0)
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


# --- traps ---------------------------------------------------------------------------


def test_dirty_dates(spark):
    texts = ["12-03-2024", "3rd & 4th May 2024", "01.02.2023 (AN)", "01-02-2023, 05-02-2023", "nil", "31-02-2024", "5th June 2021", "", None]
    got = [r.d for r in rows(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(C.parse_dirty_date("t").alias("d")).collect()]
    assert got == [datetime.date(2024, 3, 12), None, datetime.date(2023, 2, 1), None, None, None, datetime.date(2021, 6, 5), None, None]


def test_coordinates(spark):
    texts = ["24 16-25 30 N", "85 12 30 N", "24 10 24 20 N", "24 10 E", "95 N", "24 10", None]
    got = [r.c for r in rows(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(C.parse_coordinate_range("t", "latitude").alias("c")).collect()]
    assert (round(got[0].lower, 6), round(got[0].upper, 6)) == (round(24 + 16 / 60, 6), round(25 + 30 / 60, 6))
    assert round(got[1].lower, 6) == round(85 + 12 / 60 + 30 / 3600, 6) and got[2].odd and got[3:] == [None] * 4


def test_tied_scores(spark):
    df = rows(spark, [(1, 5.0), (2, 5.0), (3, 5.0), (4, 9.0), (5, None)], "i int, s double").withColumn("g", F.lit(1))
    got = {r.i: r.percentile for r in R.pct_rank_avg(df, ["g"], "s").collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.5, 4: 1.0, 5: None}
    ties = rows(spark, [(1.0, 1), (1.0, 0), (1.0, 0)], "s double, y int").withColumn("g", F.lit(1))
    assert M.roc_auc(ties, ["g"], "s", "y").first().auc == 0.5
    assert M.roc_auc(ties.where("y = 0"), ["g"], "s", "y").first().auc is None


def test_group_of_sentinels_has_null_sum(spark):
    s = rows(spark, [("p", datetime.date(2024, 1, 1), -999.0, 1)], "k string, d date, v double, o int").withColumn("v", C.null_sentinels(F.col("v"), -900))
    r = R.rolling_summary(s, ["k"], "d", "v", "2023-01-01", "2025-01-01", [F.col("o")]).first()
    assert (r.mean_value, r.sum_value, r.valid_days) == (None, None, 0)


def test_polygon_border(spark):
    square = [(1, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])]
    inner = [(2, i, x, y) for i, (x, y) in enumerate([(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])]
    v = rows(spark, square + inner, "poly int, seq int, x double, y double")
    p = rows(spark, [(1, 0.0, 2.0), (2, 4.0, 4.0), (3, 2.0, 2.0), (4, 9.0, 9.0)], "k int, lon double, lat double")
    assert {r.k: r.poly for r in P.point_in_polygon_join(p, v, ["k"], "poly").collect()} == {1: None, 2: None, 3: 1, 4: None}
    assert {r.k: r.poly for r in P.point_in_polygon_join(p, v, ["k"], "poly", boundary="covers").collect()} == {1: 1, 2: 1, 3: 1, 4: None}


def test_nearest_across_the_antimeridian_and_at_the_pole(spark):
    ref = rows(spark, [(1, 0.0, -179.9), (2, 0.0, 170.0), (3, 89.9, 0.0)], "rid int, lat double, lon double")
    left = rows(spark, [(1, 0.0, 179.9), (2, 89.9, 180.0), (3, -60.0, 0.0)], "k int, lat double, lon double")
    for levels in ((), (1.0, 4.0, 180.0)):
        got = {r.k: (r.nearest_id, round(r.nearest_km, 1)) for r in P.nearest(left, ref, ["k"], ref_id="rid", levels=levels).collect()}
        assert got[1] == (1, 22.2) and got[2] == (3, 22.2) and got[3][0] in (1, 2, 3)
    assert {r.k: r.n_within for r in P.count_within(left, ref, ["k"], 30.0, ref_id="rid").collect()} == {1: 1, 2: 1, 3: 0}
    assert P.nearest(left, ref.where("false"), ["k"], ref_id="rid").where("nearest_id is null").count() == 3


def test_purge_distance_is_strict(spark):
    train = rows(spark, [(1, 0.0, 0.0), (2, 0.0, 0.5), (3, 0.0, 3.0)], "k int, lat double, lon double")
    held = rows(spark, [(9, 0.0, 1.0)], "rid int, lat double, lon double")
    km = train.where("k = 2").select(C.haversine_km(F.lit(0.0), F.lit(0.5), F.lit(0.0), F.lit(1.0)).alias("d")).first().d
    assert {r.k for r in P.purge(train, held, ["k"], km, held_id="rid").collect()} == {1, 2, 3}
    assert {r.k for r in P.purge(train, held, ["k"], km + 0.1, held_id="rid").collect()} == {1, 3}


def test_declared_properties_fail_loudly(spark, tmp_path):
    dim = rows(spark, [(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(R.ContractError, match="not unique"):
        R.lookup_join(dim.select("k"), dim, ["k"])
    with pytest.raises(R.ContractError, match="contract"):
        Q.assert_schema(dim.select("v", "k"), Q.schema_hash(["k", "v"]))
    with pytest.raises(R.ContractError, match="no features"):
        S.augment(dim, dim.where("k = 5"), "k", ["v"])
    with pytest.raises(R.ContractError, match="differ"):
        S.typed_by_dictionary(dim, {"k": "integer"})
    (tmp_path / "a.csv").write_text("preamble\n-END-\nLAT,V\n1.0,2\n")
    (tmp_path / "b.csv").write_text("preamble\n-END-\nLAT,V\n3.0,4\n")
    assert sorted((r.LAT, r.V) for r in S.scan_tiles(spark, f"{tmp_path}/*.csv", "-END-", "LAT double, V int", 2).collect()) == [(1.0, 2), (3.0, 4)]
    with pytest.raises(R.ContractError, match="tiles"):
        S.scan_tiles(spark, f"{tmp_path}/*.csv", "-END-", "LAT double, V int", 3)


def test_files_round_trip(spark, tmp_path):
    df = rows(spark, [(1, None, 1.5), (2, "é", None)], "k int, t string, v double")
    S.write_table(df, f"{tmp_path}/t", ["v", "k", "t"], digits=2)
    got = [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/t").collect()]
    assert {r[1] for r in got} == {"1", "2"} and "1.50" in {r[0] for r in got}
    cell = G.cell_of(F.lit(10.0), F.lit(20.0), 6)
    wkt, _ = G.geometry(cell, 6)
    S.write_geojson(df.withColumn("w", wkt), f"{tmp_path}/g", "k", "w", ["t"])
    texts = spark.read.text(f"{tmp_path}/g").select(F.concat(F.lit('{"features":['), "value", F.lit("]}")).alias("c"))
    features, vertices = S.scan_features(texts, "c", "t string")
    assert features.count() == 2 and vertices.count() == 8
    (tmp_path / "d.json").write_text('[{"r": 2, "n": ["b"]}, {"r": 1, "n": ["a"]}]')
    assert [r.r for r in S.scan_dimension_json(spark, f"{tmp_path}/d.json", "r int, n array<string>", "r").collect()] == [1, 2]


def test_rings_of_all_parts(spark):
    geometry = '{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]],[[[9,9],[10,9],[10,10],[9,9]]]]}'
    text = '{"features":[{"id":"a","properties":{"t":"x"},"geometry":%s},{"id":"b","properties":{"t":"y"},"geometry":{"type":"Point","coordinates":[1,2]}},{"id":"c","properties":{},"geometry":null}]}' % geometry
    features, vertices = S.scan_features(rows(spark, [(text,)], "c string"), "c", "t string")
    assert [tuple(r) for r in features.collect()] == [("a", "x")]
    got = sorted(tuple(r) for r in vertices.collect())
    assert [r[1:4] for r in got] == [(p, r, i) for p, r in ((0, 0), (0, 1), (1, 0)) for i in range(3)]
    assert got[3][4:] == (1.0, 1.0) and got[-1][4:] == (10.0, 10.0)


def test_anchors_in_any_form(spark):
    page = """<a class="b" href='/one?x=1'>First <b>bold</b></a> <A HREF=two.html title=x>Two</A> <a name="here">no link</a> <a href="">empty</a>
    <abbr href="no">n</abbr> <a data-href="no" href="https://e.org/3">
    third</a>"""
    got = [tuple(r) for r in D.extract_links(rows(spark, [(1, "http://h.org/p/q", page), (2, "http://h.org", None)], "k int, u string, h string"), "k", "h", "u").orderBy("position").collect()]
    assert [(r[2], r[3].strip(), r[4]) for r in got] == [("/one?x=1", "First bold", "http://h.org/one?x=1"), ("two.html", "Two", "two.html"), ("", "empty", ""), ("https://e.org/3", "third", "https://e.org/3")]


def test_html_tables(spark):
    html = "<table><tr><td>Report</td></tr><tr><th>खान / Mine Name</th><th>Date</th></tr><tr><td><a href='x'>One</a></td></tr><tr><td>Two</td><td>2024</td></tr></table>"
    cells = D.extract_tables(rows(spark, [(1, html), (2, None), (3, "<p>none</p>")], "p int, h string"), "p", "h")
    got = {r.row: (r.name, r.day) for r in D.canonical_headers(cells, ["p", "table"], {"name": "mine name|खान", "day": "date"}).collect()}
    assert got == {2: ("One", None), 3: ("Two", "2024")}


def test_json_keeps_nulls_and_letters(spark):
    df = rows(spark, [("é", None)], "a string, b string")
    assert df.select(C.json_profile(F.col("a"), F.col("b")).alias("j")).first().j == '{"a":"é","b":null}'


def test_equal_priority_keeps_the_first_scene(spark):
    obs = rows(spark, [(1, 7, 1, 6, 100), (1, 3, 1, 6, 100), (1, 9, 0, 6, 100)], "p int, scene int, k int, b int, e int")
    assert R.best_pixel_composite(obs, ["p"], "scene", F.col("k"), F.col("b"), F.col("e"), []).first().scene == 3


def test_folds_hold_whole_groups_evenly(spark):
    df = rows(spark, [(i, i % 23, i % 2) for i in range(400)], "i int, g int, y int")
    for label in (None, "y"):
        folds = M.group_kfold(df, "g", 5, label=label)
        assert folds.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
        sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 20
    assert M.group_kfold(df.where("g < 3"), "g", 5).select("fold").distinct().count() == 3


def test_seeded_defects_are_caught(spark):
    df = rows(spark, [(1, "a"), (2, ""), (2, "c"), (4, None)], "k int, v string")
    assert Q.check_key(df, ["k"]).first().n_duplicate == 1 and Q.check_key(df, ["v"]).first().n_blank == 2
    assert not Q.contiguous(df, "k").first().contiguous
    a, b = (Q.content_fingerprint(d, ["k", "v"]).first().fingerprint for d in (df, df.orderBy(F.desc("k"))))
    assert a == b != Q.content_fingerprint(df.withColumn("v", F.lit("x")), ["k", "v"]).first().fingerprint


def test_utm_round_trip_point(spark):
    lat, lon = G.utm_to_wgs84(F.lit(44), F.lit(500000.0), F.lit(2000000.0))
    r = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert abs(r.lon - 81) < 1e-9 and abs(r.lat - 18.0889) < 1e-3


def test_running_number_over_many_ranges(spark):
    df = spark.range(5000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(100000)))
    got = [r.n for r in R.running_number(df, [F.col("x"), F.col("id")], "n").orderBy("x", "id").collect()]
    assert got == list(range(1, 5001))


def test_plans_stay_equi_joins(spark):
    left = spark.range(10).select(F.col("id").alias("k"), F.lit(10.0).alias("lat"), F.col("id").cast("double").alias("lon"))
    plan = P.count_within(left, left.withColumnRenamed("k", "rid"), ["k"], 50.0, ref_id="rid")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bootstrap_has_a_recall_interval_of_weighted_draws(spark):
    import inspect

    from orefield.operators import scoring

    assert inspect.signature(scoring.transfer_metrics).parameters["reps"].default == 500
    rows = [("m", f"p{i}", float(s), 1) for i, s in enumerate((1, 5, 50, 60))] + [("m", f"b{i}", float(i), 0) for i in range(20)]
    rows += [("one", "p", 3.0, 1), ("one", "b", 3.0, 0), ("high", "p", 4.0, 1), ("high", "b", 9.0, 0)]
    df = spark.createDataFrame(rows, "t string, unit string, s double, y int")
    got = {r.t: r for r in scoring.group_bootstrap(df, ["t"], "unit", "s", "y", 100, 5).collect()}
    assert (got["one"].recall_low, got["one"].recall_high, got["high"].recall_low, got["high"].recall_high) == (1, 1, 0, 0)
    assert 0 <= got["m"].recall_low < 0.5 < got["m"].recall_high <= 1


def test_places_are_found_in_passages_of_their_length(spark, monkeypatch):
    """As term_found() has it, over borders of pieces, in equal texts, and without a search of the text for each place."""
    monkeypatch.setattr(D, "PIECE", 7)
    texts = [("a", "North Coal-field and  Tin; Rookery"), ("a", "north"), ("b", None), ("c", "North Coal-field and  Tin; Rookery"), ("d", "xx ab ab abc " * 9)]
    places = ["north coal", "Northcoal", "Coalfield", "in r", "tinroo", "tin rookery", "yy", "rookery and", "", "-", None, "North Coal-field and Tin; Rookery", "ab abc x", "ook", "खान"]
    data = [(r, t, {"p": places, "none": []}) for r, t in texts] + [("e", "no map", None)]
    chapters = rows(spark, data, "r string, t string, m map<string,array<string>>")
    each = chapters.select("r", "t", F.explode("m").alias("term", "p")).select("r", "t", "term", F.explode("p").alias("place"))
    want = sorted(map(repr, each.select("r", "term", "place", C.term_found("place", "t")).collect()))
    out = D.expand_occurrences(chapters, "r", "m", "t")
    assert sorted(map(repr, out.toDF("r", "term", "place", each.select(C.term_found("place", "t")).columns[0]).collect())) == want
    assert len(want) == 75 and any("True" in w for w in want) and any("False" in w for w in want)
    assert "contains(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pages_are_parsed_once_and_plain_tags_as_the_parser_has_them(spark):
    draw = random.Random(5)
    bits = ["<table>", "</table>", "<TR>", "</tr>", '<td class="a b">', "<th id='x'>", "</td>", "a &amp; b", " &lt", "x<y", "<br>", "<br/>", "<script>", "</script>", "<!-- c -->", ">", "<td a>", "<title>", "</title>", "<td x=\"1\"y='2'>", "</", "é"]
    for _ in range(3000):
        page = "<table><td>" + "".join(draw.choice(bits) for _ in range(draw.randint(1, 14)))
        parser = D._Tables()
        parser.feed(page)
        assert D._cells(page) == parser.finish(), page
    cells = D.extract_tables(rows(spark, [(1, "<table><tr><th>Date</th></tr><tr><td>x</td></tr></table>")], "p int, h string"), "p", "h")
    out = D.canonical_headers(cells, ["p", "table"], {"day": "date"})
    assert [tuple(r) for r in out.collect()] == [(1, 0, 1, "x")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1


def test_headers_of_random_tables(spark):
    """Ties of header rows, columns named twice, rows before the header, missing keys."""
    draw = random.Random(9)
    words = ["Mine", "Date", "Price", "mine date", "", "7", "x", None]
    cells = [(t, r, c, draw.choice(words)) for t in range(60) for r in range(8) for c in range(4) if draw.random() < 0.8] + [(None, 0, 0, "Date"), (None, 1, 0, "x"), (3, 1, 1, "Date"), (3, 6, None, "x")]
    rules = {"name": "mine", "day": "date", "price": "price"}
    field = lambda t: next((f for f, p in rules.items() if t is not None and p in t.lower()), None)
    want = {}
    for t in range(60):
        own = [c for c in cells if c[0] == t and c[2] is not None]
        found = {r: {field(c[3]) for c in own if c[1] == r and field(c[3])} for r in range(5)}
        best = min((-len(f), r) for r, f in found.items())[1]
        if not found[best]:
            continue
        of = [(c[2], field(c[3])) for c in own if c[1] == best and field(c[3])]
        for r in {c[1] for c in own if c[1] > best and any(c[2] == k for k, _ in of)}:
            hits = {f: [c[3] for c in own if c[1] == r and c[3] and (c[2], f) in of] for f in rules}
            want[t, r] = tuple(min(h, default=None) for h in hits.values())
    got = D.canonical_headers(rows(spark, cells, "p int, row int, col int, text string"), ["p"], rules).collect()
    assert {(r.p, r.row): (r.name, r.day, r.price) for r in got} == want and len(want) > 100


def test_missing_and_extra_keys_in_partitions_of_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr("orefield.operators.state.ROWS", 10)
    e, a = rows(spark, [(i % 150,) for i in range(300)] + [(None,)], "k bigint"), rows(spark, [(i % 170 + 3,) for i in range(340)] + [(None,)], "k bigint")
    out = R.missing_and_extra(e, a, "k")
    assert out.rdd.getNumPartitions() == 65
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(0, "missing"), (1, "missing"), (2, "missing"), (None, "missing"), (None, "extra"), *[(i, "extra") for i in range(150, 173)]]))
