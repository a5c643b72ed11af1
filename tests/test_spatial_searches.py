"""Searches by place against plain computations: poles, antimeridian, copies at one place, crowded blocks, odd positions; and that no search broadcasts its reference."""

import math
import random
import re

import pytest
from orefield.operators import spatial as P


def _km(a, b):
    p, q = map(math.radians, (a[0], b[0]))
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(x, 1.0)))


def _points(seed, n):
    draw = random.Random(seed)
    spots = [(90.0, 10.0), (-90.0, 0.0), (89.97, -120.0), (10.0, 180.0), (10.0, -180.0), (0.0, 0.0)]
    ring = lambda: draw.choice([(draw.uniform(-90, 90), draw.uniform(-180, 180)), (draw.uniform(88, 90), draw.uniform(-180, 180)), (draw.uniform(-2, 2), draw.choice([-1, 1]) * draw.uniform(179, 180)), (draw.uniform(40, 41), draw.uniform(70, 71)), draw.choice(spots)])
    return [(i, i % 3, *ring()) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    left, ref = _points(1, 240), _points(2, 300)
    schema = "k bigint, g int, lat double, lon double"
    odd = [(900, 0, None, 1.0), (901, 0, float("nan"), 1.0), (902, None, 1.0, 1.0), (903, 7, 1.0, 1.0)]
    return left, ref, spark.createDataFrame(left + odd, schema), spark.createDataFrame(ref, schema).withColumnRenamed("k", "rid")


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("crowded", [4096, 5])
@pytest.mark.parametrize("k", [1, 3])
def test_neighbours_are_those_of_all_pairs(tables, monkeypatch, by, crowded, k):
    monkeypatch.setattr(P, "CROWDED", crowded)
    left, ref, l, r = tables
    got = {x.k: [(n.id, round(n.km, 6)) for n in x.neighbours] for x in P.nearest_k(l, r, ["k"], k, ref_id="rid", by=by).collect()}
    for key, g, *at in left:
        best = sorted((_km(at, p[2:]), p[0]) for p in ref if not by or p[1] == g)[:k]
        assert [d for _, d in got[key]] == pytest.approx([d for d, _ in best], abs=2e-6)
    assert got[900] == []
    assert len(got) == 244
    if by:
        assert got[902] == got[903] == []


@pytest.mark.parametrize("km", [0.5, 60.0, 400.0, 9000.0, 20100.0])
def test_counts_and_purges_are_those_of_all_pairs(tables, km):
    left, ref, l, r = tables
    for by in ([], ["g"]):
        got = {x.k: x.n_within for x in P.count_within(l, r, ["k"], km, ref_id="rid", by=by).collect()}
        other = {x.k: x.n_within for x in P.count_within(l, r, ["k"], km, ref_id="rid", by=by, exclude_same=("k", "rid")).collect()}
        kept = {x.k for x in P.purge(l, r, ["k"], km, held_id="rid", by=by).collect()}
        for key, g, *at in left:
            near = [p[0] for p in ref if (not by or p[1] == g) and _km(at, p[2:]) <= km]
            assert got[key] == len(near)
            assert other[key] == len([i for i in near if i != key])
            assert (key in kept) == (not near)
        assert got[900] == got[901] == 0 and {900, 901} <= kept


def test_many_copies_at_one_place_share_a_search(spark):
    """20,000 rows at five places have 80 million pairs in each block; the smallest ids win."""
    at = spark.range(20_000).selectExpr("id", "0D AS lat", "CAST(id % 5 AS DOUBLE) AS lon")
    found = P.nearest_k(at, at, ["id"], 2, ref_id="id")
    assert found.selectExpr("transform(neighbours, n -> n.id) AS n", "id % 5 AS g").where("n <> array(g, g + 5)").count() == 0
    assert P.count_within(at, at, ["id"], 10.0, ref_id="id").where("n_within <> 4000").count() == 0


def test_no_search_broadcasts_its_reference(spark):
    """File sizes say little about rows: a reference of a few MB on disk may be a million rows in the driver."""
    at = spark.range(2_000).selectExpr("id", "CAST(id % 60 AS DOUBLE) AS lat", "CAST(id % 70 AS DOUBLE) AS lon")
    for df in (P.count_within(at, at, ["id"], 100.0, ref_id="id"), P.purge(at, at, ["id"], 100.0, held_id="id"), P.nearest(at, at, ["id"], ref_id="id")):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def _broadcasts(spark, build):
    """Rows of each broadcast in all that a query runs, the stored steps of its searches included."""
    store = spark._jsparkSession.sharedState().statusStore()

    def plans(after):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        runs = store.executionsList()
        each = [runs.apply(i) for i in range(runs.size())]
        return {x.executionId(): x.physicalPlanDescription() for x in each if x.executionId() > after}

    last = max(plans(-1), default=-1)
    build().collect()
    final = [p.split("+- == Initial Plan ==")[0] for p in plans(last).values()]
    assert final
    assert "BroadcastExchange" not in "".join(p for p in final if "BroadcastQueryStage" not in p)
    return [int(float(n)) for p in final for n in re.findall(r"BroadcastQueryStage \(\d+\), Statistics\(.*rowCount=([\d.E+]+)", p)]


def test_fold_features_broadcast_only_their_groups(spark):
    """m5_fold_features: twelve materials in three folds, never the training rows or the buckets they are spread to."""
    from __spark_entry__ import queries

    assert _broadcasts(spark, lambda: queries()["m5_fold_features"](spark, "/root/testdata/sf0.01")) == [36]


def test_many_groups_are_not_broadcast(spark, monkeypatch):
    at = spark.range(400).selectExpr("id", "id % 200 AS g", "CAST(id % 60 AS DOUBLE) AS lat", "CAST(id % 70 AS DOUBLE) AS lon")
    search = lambda: P.nearest_other(at, at.where("g < 150"), ["id"], self_id="id", ref_id="id", by=["g"])
    assert _broadcasts(spark, search) == [150]
    few = {r.id: r.nearest_id for r in search().collect()}
    monkeypatch.setattr(P, "GROUPS", 100)
    assert _broadcasts(spark, search) == []
    assert few == {r.id: r.nearest_id for r in search().collect()} == {i: (i + 200) % 400 if i % 200 < 150 else None for i in range(400)}


def test_scores_of_cells_that_share_a_place(spark):
    """Cells at one place read one list; a cell without coordinates keeps its rows; the percentile is left out on request."""
    from orefield.operators import scoring as M

    cells = spark.createDataFrame([(i, 10.0 + i % 2, 20.0, i % 3) for i in range(12)] + [(50, None, 20.0, 1)], "cell_id int, lat double, lon double, unit_id int")
    evidence = spark.createDataFrame([(j, j % 2, 10.0 + j / 10, 20.0, j % 3) for j in range(14)], "site_id int, material_id int, lat double, lon double, unit_id int")
    targets = evidence.select("material_id").distinct()
    whole, plain = M.score_cells(cells, evidence, targets), M.score_cells(cells, evidence, targets, ranked=False)
    assert "percentile" not in plain.columns
    assert sorted(map(str, whole.drop("percentile").collect())) == sorted(map(str, plain.collect()))
    rows = plain.collect()
    assert len(rows) == 26 and {(r.nearest_km, r.density) for r in rows if r.cell_id == 50} == {(None, 0)}
    for r in rows:
        if r.cell_id != 50:
            at = (10.0 + r.cell_id % 2, 20.0)
            km = [_km(at, (10.0 + j / 10, 20.0)) for j in range(14) if j % 2 == r.material_id]
            assert r.nearest_km == pytest.approx(min(km), abs=1e-6) and r.density == sum(d <= 100 for d in km)
