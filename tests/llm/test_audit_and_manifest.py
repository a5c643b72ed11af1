"""Divergence audit, language model and Merkle manifest against brute-force versions, and the edge cases their docstrings define."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from orefield.llm import divergence, language_model, merkle, queries
from orefield.llm._common import written
from orefield.operators.state import stored

SMALL = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# columns after n_chars clash with the operators' own
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank int, term string, leaf string, tree string, score double, id long, row long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None, None, None) for r in rows], SCHEMA)


ODD = [
    (1, None, None, None, None),
    (2, "s", None, 0, ""),
    (3, "s", "en", 4, "Word word"),
    (4, "t", "en", 4, "word WÖRD x1y"),
    (4, "t", "en", 4, "word WÖRD x1y"),
    (None, "s", "en", 5, "word without id"),
    (None, "s", "en", 5, "word without id"),
    (5, "u", "en", 6, "é" * 200_000 + " word x y"),
    (6, "", "de", 7, "12 34 !!"),
    (7, "t", "de", 7, "nur einmal"),
    (8, "ü", "en", 7, "a b c x y\n" * 30_000),
]


def made_up(n, seed=5):
    rng = random.Random(seed)
    words = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(300)]
    return [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["en", "de"]), 1, " ".join(rng.choice(words[: rng.choice([5, 300])]) for _ in range(rng.randrange(12)))) for i in range(n)]


# --- 11 --------------------------------------------------------------------------


def brute_audit(rows, least=3, top=200):
    upper = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, source, lang, _, text in rows:
        source, lang = source or "", lang or ""
        groups.add((lang, source))
        terms = [t.encode().translate(upper).decode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, d in df[lang].items() if d >= least]
        own = sorted(s for x, s in groups if x == lang)
        everything = Counter()
        for s in own:
            everything.update(n[lang, s])

        def share(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        p, q = {s: share(n[lang, s]) for s in own}, share(everything)
        for s in own:
            parts = {"pair": [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s], "term": [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]}
            for part, values in parts.items():
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


@pytest.mark.parametrize("rows", [ODD, made_up(400)], ids=["odd", "made up"])
def test_audit_equals_brute_force(spark, rows):
    for width, top in ((4096, 200), (16, 7)):
        got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows), width=width, top_terms=top).collect())
        assert got == brute_audit(rows, top=top)


def test_audit_of_no_rows(spark):
    assert divergence.audit(frame(spark, ODD).where("false")).count() == 0


def test_probability_is_exact_for_large_totals():
    rng = random.Random(1)
    for _ in range(2000):
        total = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(0, total)
        assert divergence.probability(np.array([count]), total)[0] == 1 + 10**9 * (count + 1) // total


def test_trees_share_equal_subtrees_and_meet_each_pair_once():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (5, 64)) * (rng.random((5, 64)) < 0.2)
    trees = divergence.Trees(counts)
    assert len(trees.children[0][0]) < 5 * 32 / 4  # different pairs of neighbouring counts, not all pairs
    who, a, b, times = trees.meet(2, np.arange(5))
    found = Counter({(w, x, y): t for w, x, y, t in zip(who, a, b, times)})
    assert len(found) == len(who)
    assert found == Counter((o, counts[2, i], counts[o, i]) for o in range(5) for i in range(64))


# --- 12 --------------------------------------------------------------------------


def tokens_of(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))), b" "]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute_base(rows):
    counts = Counter()
    for i, text in rows:
        if not held_out(i):
            counts.update(tokens_of(text))
    n, v = counts.total(), len(counts)
    out = []
    for i, text in rows:
        t = tokens_of(text)
        out.append((i is None, i, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)))
    return sorted(out, key=str)


def by_id(rows):
    return sorted(((r.id is None, r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)


@pytest.mark.parametrize("rows", [ODD, made_up(400)], ids=["odd", "made up"])
@pytest.mark.parametrize("bounds", [{}, {"head": 5}, {"head": 0, "filter_bytes": 0}, {"filter_bytes": 0, "shard_bytes": 50}], ids=str)
def test_language_model_base_and_both_ways(spark, rows, bounds):
    docs = frame(spark, rows)
    learn = docs.where("coalesce(crc32(cast(doc_id as string)) % 7 <> 2, true)")
    got = language_model.score(docs, language_model.train(learn, **bounds)).collect()
    expected = brute_base([(r[0], r[4]) for r in rows])
    assert [x[:5] for x in by_id(got)] == [x[:5] for x in expected]
    assert np.allclose([x[5] for x in by_id(got)], [x[5] for x in expected], rtol=1e-9)
    if bounds and "shard_bytes" not in bounds:
        plain = language_model.score(docs, language_model.train(learn)).collect()
        order = lambda rows: np.array(sorted((r.n_tokens, r.score) for r in rows))
        assert np.allclose(order(got), order(plain), rtol=1e-9)


def test_scoring_by_chunks_stores_less_than_the_texts(spark, monkeypatch):
    """Beyond the filter's bound a row a token was stored, with six numbers each, and joined three times."""
    docs = queries.table(spark, SMALL, "documents").select("doc_id", "text")
    model = language_model.train(docs, head=1000, filter_bytes=0)
    made = []
    monkeypatch.setattr(language_model, "written", lambda *a, written=language_model.written, **b: made.append(written(*a, **b)) or made[-1])
    monkeypatch.setattr(language_model, "_CHUNK", 1 << 16, raising=False)
    got = language_model.score(docs, model).select("id", "score")
    plain = language_model.score(docs, language_model.train(docs)).select("id", "score")
    assert dict(got.collect()) == pytest.approx(dict(plain.collect()))
    stored = sum(os.path.getsize(f.removeprefix("file:")) for df in made for f in df.inputFiles() if "lm-model" not in f)
    assert 0 < stored < docs.selectExpr("sum(octet_length(text))").first()[0] / 2


def test_keys_of_parts_come_back():
    keys = np.unique(np.append(np.random.default_rng(5).integers(0, 1 << 64, 5000, dtype=np.uint64), np.array([0, 1, 1 << 32, (1 << 64) - 1], np.uint64)))
    for shards, parts in ((64, 64), (1280, 427), (4103, 513)):
        part, short = language_model.shard_of(keys, shards) % parts, language_model.short_keys(keys, shards, parts)
        for p in range(parts):
            own = np.flatnonzero(part == p)
            own = own[np.argsort(short[own])]
            assert (language_model.unpacked_keys(language_model.packed_keys(short[own]), p, shards, parts) == keys[own]).all()


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x.rsplit("/", 1)[-1] for x in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in x}
    before = files()
    for keep in (lambda df: written(df, "test"), stored):
        assert len(keep(spark.range(10_000).repartition(7, "id")).collect()) == 10_000  # a count would shuffle again
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_language_model_of_empty_tables(spark):
    docs = frame(spark, ODD)
    model = language_model.train(docs.where("false"))
    assert {(r.n_known, r.train_tokens) for r in language_model.score(docs, model).collect()} == {(0, 0)}
    assert language_model.score(docs.where("false"), language_model.train(docs)).count() == 0


def test_levels_come_back_from_the_filter():
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = (rng.pareto(1.0, 20_000) + 1).astype(np.int64)
    shard = language_model.shard_of(pairs, 4)
    bloom = language_model.Filter(4, {s: language_model.filter_bits(pairs[shard == s], counts[shard == s]) for s in range(4)})
    true = np.searchsorted(language_model.levels(), counts, side="right")
    found = bloom.level(pairs)
    assert (found >= true).all() and (found > true).mean() < 0.05
    assert (bloom.level(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.05


def test_model_predicts_held_out_texts_better_than_single_tokens(spark):
    got = queries.op12_language_model(spark, SMALL).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.b < got.s < 0


# --- 13 --------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    values = dict(zip(("doc_id", "source", "lang", "n_chars", "text"), row))
    if lower and values["text"] is not None:
        values["text"] = re.sub("[A-Z]", lambda m: m[0].lower(), values["text"])
    return sha(*["-" if values[f] is None else f"{len(str(values[f]).encode())}:{values[f]}" for f in FIELDS])


def brute_tree(nodes):
    """(root, steps of each leaf) by whole levels."""
    steps, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owner = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for i in owner[a + k]:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            up_owner.append([i for o in owner[a : a + 16] for i in o])
        nodes, owner = up, up_owner
    return nodes[0], steps


def brute_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        parts.append((own, *brute_tree([leaf_of(r) for r in own])))
    root, tops = brute_tree([p[1] for p in parts])
    out = []
    for (own, sub, steps), top in zip(parts, tops):
        for r, path in zip(own, steps):
            path = path + top
            folded = leaf_of(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for a, b in path:
                folded = sha(a, folded, b)
            out.append((r[0], leaf_of(r), sub, root, sha(*[x for p in path for x in p]), folded, folded == root))
    return sorted(out, key=str)


def manifest_of(docs):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    from pyspark.sql import functions as F

    found = merkle.manifest(docs, altered={"text": F.translate("text", upper, upper.lower())}, where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return sorted((tuple(r) for r in found.drop("source").collect()), key=str)


@pytest.mark.parametrize("rows", [ODD, ODD[:1], made_up(1500), [(i, f"s{i % 300}", None, i, "Text") for i in range(700)]], ids=["odd", "one row", "two rounds", "many sources"])
def test_manifest_equals_brute_force(spark, rows):
    assert manifest_of(frame(spark, rows)) == brute_manifest(rows)


def test_manifest_of_three_rounds(spark):
    rows = [(i, "s", "en", 1, "T" if i % 2 else None) for i in range(256 * 256 + 20)]
    assert manifest_of(frame(spark, rows)) == brute_manifest(rows)


def test_manifest_of_no_rows(spark):
    assert manifest_of(frame(spark, ODD).where("false")) == []


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300])
def test_witnesses_grow_while_leaves_are_appended(n):
    nodes = [sha(str(i)) for i in range(n)]
    tree = merkle.Tree()
    for x in nodes:
        tree.append(x)
    root, steps = brute_tree(nodes)
    assert tree.finish() == root
    assert [tree.witness(i, len(steps[i])) for i in range(n)] == steps
    assert all(merkle.fold(x, s) == root for x, s in zip(nodes, steps))
