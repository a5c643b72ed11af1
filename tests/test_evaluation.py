"""Ranks, quantiles, neighbours, folds, models and bootstraps against plain computations on hand-made rows."""

import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield.operators import documents as D
from orefield.operators import folds, logistic
from orefield.operators import governance as Q
from orefield.operators import ranks
from orefield.operators import relational as R
from orefield.operators import scoring as M
from orefield.operators import spatial as P
from orefield.operators.state import stored
from orefield.sources import tables as S


def plan_of(df):
    return df._jdf.queryExecution().toString()


# --- ranks -----------------------------------------------------------------------


def test_quantiles_of_groups_with_ties_nulls_and_a_null_group(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, float(rng.randrange(8)), rng.gauss(0, 1)])) for g in ("a", "b", None) for _ in range(101)] + [("c", None), ("d", 4.0)]
    got = {r.g: (r.lo, r.mid, r.hi) for r in ranks.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.05, 0.5, 0.98], ["lo", "mid", "hi"]).collect()}
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert np.allclose(got[g], np.percentile(values, [5, 50, 98]))


def test_quantiles_without_groups_and_weighted(spark):
    df = spark.createDataFrame([(float(i % 7), i % 3) for i in range(50)], "v double, w int")
    assert ranks.quantiles(df, [], "v", [0.3], ["q"]).first().q == pytest.approx(np.percentile([i % 7 for i in range(50)], 30))
    expanded = [i % 7 for i in range(50) for _ in range(i % 3)]
    assert ranks.quantiles(df.where("w > 0"), [], "v", [0.3], ["q"], "w").first().q == pytest.approx(np.percentile(expanded, 30))


def test_average_rank_without_a_window_over_the_group(spark):
    rows = [("a", 5.0, True), ("a", 5.0, True), ("a", 1.0, True), ("a", 9.0, False), ("a", None, True), (None, 2.0, True)]
    df = spark.createDataFrame(rows, "g string, v double, ok boolean")
    out = ranks.average_rank(df, ["g"], "v", F.col("ok"))
    assert sorted(((r.g, r.v, r.percentile) for r in out.collect()), key=str) == sorted([("a", 5.0, 2.5 / 3), ("a", 5.0, 2.5 / 3), ("a", 1.0, 1 / 3), ("a", 9.0, None), ("a", None, None), (None, 2.0, 1.0)], key=str)
    assert "SinglePartition" not in plan_of(out)


# --- neighbours --------------------------------------------------------------------


def kilometres(a, b):
    (lat1, lon1), (lat2, lon2) = ([math.radians(v) for v in p] for p in (a, b))
    return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2))


@pytest.mark.parametrize("k", [1, 3])
def test_k_nearest_with_ties_poles_and_groups(spark, k):
    rng = random.Random(2)
    place = lambda: (rng.choice([rng.uniform(-90, 90), 89.9, -90.0, 10.0]), rng.choice([rng.uniform(-180, 180), 179.9, -179.9, 20.0]))
    ref = [(i, rng.choice("abb"), *place()) for i in range(60)] + [(100 + i, "a", 10.0, 20.0) for i in range(5)]
    left = [(i, rng.choice("abz"), *place()) for i in range(50)]
    r, q = spark.createDataFrame(ref, "id int, g string, lat double, lon double"), spark.createDataFrame(left, "q int, g string, lat double, lon double")
    got = {x.q: [(n.id, round(n.km, 6)) for n in x.neighbours] for x in P.nearest_k(q, r, ["q"], k, ref_id="id", by=["g"]).collect()}
    for i, g, lat, lon in left:
        best = sorted((round(kilometres((lat, lon), (b, c)), 6), j) for j, h, b, c in ref if h == g)[:k]
        assert [d for _, d in got[i]] == pytest.approx([d for d, _ in best], abs=1e-5)
    assert len(got) == 50 and got[next(i for i, g, *_ in left if g == "z")] == []


def test_ties_go_to_the_smaller_id(spark):
    ref = spark.createDataFrame([(i, 1.0, 1.0) for i in (5, 3, 9)], "id int, lat double, lon double")
    q = spark.createDataFrame([(1, 1.0, 1.5)], "q int, lat double, lon double")
    assert [n.id for n in P.nearest_k(q, ref, ["q"], 2, ref_id="id").first().neighbours] == [3, 5]
    assert P.nearest_other(ref, ref, ["id"], self_id="id", ref_id="id").where("id = 3").first().nearest_id == 5


# --- folds -----------------------------------------------------------------------


def greedy(items, k):
    loads = [[0, 0] for _ in range(k)]
    taken = defaultdict(int)
    for p, n in items:
        f = min(range(k), key=lambda f: (loads[f][0] if p else 0, loads[f][1], f))
        loads[f][0] += p
        loads[f][1] += n
        taken[p, n, f] += 1
    return taken


@pytest.mark.parametrize("seed", range(30))
def test_dealing_classes_equals_one_group_at_a_time(seed):
    rng = random.Random(seed)
    classes = sorted({(rng.choice([0, 0, rng.randrange(5)]), rng.randrange(1, 9)): rng.choice([1, 3, 40, 500]) for _ in range(rng.randrange(1, 12))}.items(), reverse=True)
    classes = [(min(p, n), n, m) for (p, n), m in classes]
    merged = defaultdict(int)
    for p, n, m in classes:
        merged[p, n] += m
    classes = sorted(((p, n, m) for (p, n), m in merged.items()), reverse=True)
    k = min(rng.choice([2, 3, 5]), sum(m for *_, m in classes))
    got = {(p, n, f): b - a + 1 for p, n, f, a, b in folds.deal(classes, k)}
    assert got == dict(greedy([(p, n) for p, n, m in classes for _ in range(m)], k))


def test_folds_keep_groups_whole_and_even(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(400)}" if i % 50 else None, int(rng.random() < 0.2)) for i in range(3000)]
    out = M.group_kfold(spark.createDataFrame(rows, "g string, y int"), "g", 5, [], "y", 1).collect()
    assert len(out) == 3000 and all(r.fold is not None for r in out)
    where = defaultdict(set)
    for r in out:
        where[r.g].add(r.fold)
    assert all(len(v) == 1 for v in where.values())
    loads = [(sum(r.y for r in out if r.fold == f), sum(1 for r in out if r.fold == f)) for f in range(5)]
    assert max(p for p, _ in loads) - min(p for p, _ in loads) <= 3 and max(n for _, n in loads) - min(n for _, n in loads) <= 60


# --- models ----------------------------------------------------------------------


def test_logistic_of_two_groups_is_stationary_and_orders_its_rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a = rng.gauss(0, 1)
        y = int(rng.random() < 1 / (1 + math.exp(-2 * a if i % 2 else 2 * a)))
        rows.append((i, i % 2, a if i % 13 else None, float("nan") if i % 17 == 0 else rng.gauss(0, 1), y, i % 3 == 0))
    rows += [(1000 + i, 7, 1.0, 1.0, 1, i % 2 == 0) for i in range(6)]  # one class only
    df = spark.createDataFrame(rows, "id int, g int, a double, b double, y int, held boolean")
    z = logistic.design(df, ["g"], ["a", "b"], "held").where("not held")
    w = logistic.fit_weights(z, ["g"], "y", 5).collect()
    assert {r.g for r in w} == {0, 1} and all(r.gradient_norm < 1e-6 and r.steps < 30 for r in w)
    train = [r for r in z.collect() if r.g == 1]
    x, y = np.array([r.z for r in train]), np.array([r.y for r in train])
    v = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = np.array(next(r.w for r in w if r.g == 1))
    assert np.abs(x.T @ (v * (1 / (1 + np.exp(-x @ beta)) - y)) + beta).max() < 1e-6
    out = logistic.fit_logistic(df, ["g"], "id", ["a", "b"], "y", "held").collect()
    assert {r.id for r in out} == {r[0] for r in rows if r[5]}
    assert all((r.probability is None) == (r.g == 7) for r in out)


def test_paired_interval_of_equal_and_better_scores(spark):
    rng = random.Random(5)
    rows = [(f"g{i % 20}", int(i % 20 < 8 and i % 3 == 0), rng.random()) for i in range(800)]
    rows = [(g, y, s, s + y * 0.4, s) for g, y, s in rows]
    df = spark.createDataFrame(rows, "g string, y int, base double, better double, same double").withColumn("m", F.lit(1))
    same = M.paired_bootstrap(df, ["m"], "g", "base", "same", "y", 200, 3).first()
    assert (same.delta_low, same.delta_high, same.valid) == (0.0, 0.0, 200)
    better = M.paired_bootstrap(df, ["m"], "g", "base", "better", "y", 200, 3).first()
    assert 0.1 < better.delta_low < better.delta_high < 0.6
    few = M.paired_bootstrap(df.where("g in ('g0', 'g9')"), ["m"], "g", "base", "better", "y", 20, 3).first()
    assert (few.delta_low, few.delta_high, few.valid) == (None, None, 0)


# --- lists, tables, features --------------------------------------------------------


def test_event_list_keeps_undated_events_last_and_equal_ones_once(spark):
    rows = [(1, "2024-05-01", "b", None), (1, "2023-01-01", "a", "x"), (1, "2023-01-01", "a", "x"), (1, None, "c", None), (2, "2024-01-01", None, None)]
    df = spark.createDataFrame(rows, "k int, d string, detail string, note string").withColumn("none", F.lit(None).cast("string"))
    got = {r.k: [(str(e.event_date), e.event_type, e.detail) for e in r.events] for r in R.event_list(df, ["k"], {"letter": ("d", "detail"), "note": ("none", "note")}).collect()}
    assert got == {1: [("2023-01-01", "letter", "a"), ("2024-05-01", "letter", "b"), ("None", "letter", "c"), ("None", "note", "x")], 2: []}


def test_tables_in_cells_breaks_and_left_out_tags(spark):
    pages = [
        ("a", "<table><tr><td>outer<table><tr><td>in<br>ner</td></tr></table>after</td><td>x</td></tr></table>"),
        ("b", "<table><td>no row<td>&lt;b&gt;<tr><th>next<script>'</td>'</script>"),
        ("c", "<p>no such thing</p>"), ("d", None), ("e", ""),
    ]
    out = D.extract_tables(spark.createDataFrame(pages, "k string, h string"), "k", "h").collect()
    assert sorted((r.k, r.table, r.row, r.col, r.text) for r in out) == [("a", 0, 0, 0, "outer after"), ("a", 0, 0, 1, "x"), ("a", 1, 0, 0, "in ner"), ("b", 0, 0, 0, "no row"), ("b", 0, 0, 1, "<b>"), ("b", 0, 1, 0, "next")]


def test_features_of_wkt_with_holes_and_parts(spark):
    rows = [("p", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))"), ("m", "multipolygon(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5),(5.5 5.2,5.6 5.2,5.6 5.3,5.5 5.2)))"), ("x", "POINT (1 1)"), ("n", None)]
    import json

    got = {f["id"]: f["geometry"] for f in (json.loads(r.feature) for r in S.geojson_features(spark.createDataFrame(rows, "k string, w string"), "k", "w", ["k"]).collect())}
    assert got["p"] == {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}
    assert got["m"]["type"] == "MultiPolygon" and [len(part) for part in got["m"]["coordinates"]] == [1, 2] and got["m"]["coordinates"][1][1][0] == [5.5, 5.2]
    assert got["x"] is None and got["n"] is None


def test_profile_of_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (None, None)], "n int, t string")
    assert sorted((r.column, r.data_type, r.n_rows, r.n_missing, r.n_blank) for r in Q.profile_columns({"x": df}).collect()) == [("n", "int", 3, 1, 0), ("t", "string", 3, 1, 1)]


@pytest.mark.parametrize("n_groups", [3, 400])
def test_weighted_aucs_and_cuts_equal_repeated_rows(spark, n_groups):
    """Few groups go by pairs of groups, many by weighted rows; some replicates' cuts lie below the floor."""
    rng = random.Random(6)
    rows = [(f"g{rng.randrange(n_groups)}", int(rng.random() < 0.3), float(rng.randrange(30))) for _ in range(300)]
    groups = sorted({(g, y) for g, y, _ in rows})
    draws = [(g, y, r, rng.choice([1, 1, 2, 9])) for r in range(12) for g, y in groups if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "g string, y int, s double").withColumn("m", F.lit(1))
    w = spark.createDataFrame(draws, "g string, y int, rep int, times long").withColumn("m", F.lit(1))
    times = {(g, y, r): t for g, y, r, t in draws}
    aucs = {r.rep: r.auc for r in M.weighted_aucs(df, ["m"], "g", "s", "y", w, ["m"]).collect()}
    cuts = {r.rep: r._cut for r in M.weighted_cuts(df.where("y = 0"), ["m"], "g", "s", w.where("y = 0").drop("y")).collect()}
    for rep in range(12):
        p, n = ([s for g, y, s in rows if y == k for _ in range(times.get((g, y, rep), 0))] for k in (1, 0))
        assert cuts[rep] == pytest.approx(np.percentile(n, 95))
        assert aucs[rep] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p for b in n]))


@pytest.mark.parametrize("sent", [0, 1 << 19])
def test_cuts_of_ranges_cut_again_and_again(spark, monkeypatch, sent):
    """Ties, a far value, values a hair apart, and a group whose range has no finite width."""
    for name, value in (("_UNPACKED", 0), ("_BINS", 4), ("_SENT", sent)):
        monkeypatch.setattr(M, name, value)
    rng = random.Random(8)
    scores = {1: lambda: float(rng.randrange(40)), 2: lambda: rng.choice([0.5, 0.5 + 1e-12 * rng.randrange(50), 1e9]), 3: lambda: rng.choice([-1.7e308, 1.7e308, 2.0, 3.0, 3.0]), 4: lambda: 7.0}
    rows = [(m, f"g{rng.randrange(9)}", f()) for m, f in scores.items() for _ in range(250)]
    draws = [(m, g, r, rng.choice([1, 2, 5])) for r in range(5) for m, g in sorted({x[:2] for x in rows}) if rng.random() < 0.7]
    df = spark.createDataFrame([*rows, (1, "g1", None)], "m int, g string, s double")
    got = {(r.m, r.rep): r._cut for r in M.weighted_cuts(df, ["m"], "g", "s", spark.createDataFrame(draws, "m int, g string, rep int, times long")).collect()}
    times = {d[:3]: d[3] for d in draws}
    for m, r in {(d[0], d[2]) for d in draws}:
        values = sorted(s for k, g, s in rows if k == m for _ in range(times.get((m, g, r), 0)))
        at = 0.95 * (len(values) - 1)
        low, high = values[math.floor(at)], values[math.ceil(at)]
        assert got[m, r] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-14)


def test_bootstrap_shuffles_no_row_a_replicate(spark):
    """Each background row above a floor, and each positive row, went through a shuffle once a replicate that drew its group."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x: os.path.getsize(x) for x in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in x and os.path.exists(x)}
    rows = spark.range(40_000).selectExpr("1 as target", "id div 7 % 20 as unit", "id * 48271 % 39989 / 39989 as s", "int(id % 10 = 0) as y")
    rows = stored(rows)
    before = files()
    got = M.group_bootstrap(rows, ["target"], "unit", "s", "y", 500, 3).first()
    left = sum(n for f, n in files().items() if f not in before)
    assert 0.4 < got.auc_low < got.auc_high < 0.6 and 0 < got.recall_low < got.recall_high < 0.1
    assert left < 6e6, left
