import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import datagen as G
from tessera.functions.types import IndexKind, LogicalType, Metric, PlanKind
from tessera.operators import ann, bitmaps, learned
from tessera.operators import vectors as V
from tessera.plans import catalog as C
from tessera.plans import planner as P
from tessera.sources import files

L = LogicalType


def names(plans):
    return [(p.kind.value, p.encoding.value, p.rmi_models, p.merge_ratio) for p in plans]


def test_candidates():
    many = C.ColumnShape(100_000, 100_000, True, True)
    assert [n[0] for n in names(C.candidates_for(L.BOOL, C.ColumnShape(100, 2)))] == ["bitmap"]
    assert [n[:2] for n in names(C.candidates_for(L.STRING, C.ColumnShape(100_000, 50_000)))] == [("btree", "composite")]
    assert [n[0] for n in names(C.candidates_for(L.STRING, C.ColumnShape(10**6, 10_000)))] == ["bitmap", "btree"]
    assert [n[:3] for n in names(C.candidates_for(L.INT64, many))] == [("btree", "native", 1024), ("rmi", "native", 64), ("rmi", "native", 1024), ("rmi", "native", 16384)]
    writable = names(C.candidates_for(L.DOUBLE, many, 0.1))
    assert [n[3] for n in writable if n[0] == "dynamic_rmi"] == [0.02, 0.05, 0.20] * 3 and not any(n[0] == "rmi" for n in writable)
    for kind, index, unique in ((L.BOOL, IndexKind.BTREE, False), (L.STRING, IndexKind.RMI, True), (L.INT64, IndexKind.RMI, False), (L.VECTOR, IndexKind.BTREE, True)):
        with pytest.raises(ValueError):
            C.check_kind(kind, index, unique)


@pytest.mark.parametrize("values", [[3, 1, 2], [1, 1, 2], [], [5], [2, 1, 1, 3], [1, 2, None, 3, 9, 9]])
def test_shape(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "r long, v long")
    there = sorted((v, i) for i, v in enumerate(values) if v is not None)
    rows = [i for _, i in there]
    distinct = len({v for v, _ in there})
    assert C.measure_shape(df, "v", "r") == C.ColumnShape(len(there), distinct, len(there) == distinct, rows == sorted(rows), *((there[0][0], there[-1][0]) if there else (0, 0)))


def test_choice_and_catalog(spark, tmp_path):
    shape = C.ColumnShape(5000, 5000, True, False)
    cost = {"btree": 50.0, "rmi": 40.0}
    measure = lambda p: replace(p, ns_per_lookup=cost[p.kind.value], index_bytes=p.rmi_models)
    c = C.IndexCatalog()
    plan, how = c.build_column("k", L.INT64, shape, measure)
    assert (plan.kind, plan.rmi_models, how) == (IndexKind.RMI, 64, "chosen")
    assert c.build_column("k", L.INT64, shape, measure)[1] == "replayed"
    more = replace(shape, rows=6000, distinct=6000)
    assert c.freshness("k", more) == "stale" and c.build_column("k", L.INT64, more, measure)[1] == "retuned"
    cost["rmi"] = 90.0
    plan, how = c.build_column("k", L.INT64, replace(shape, rows=7000, distinct=7000), measure)
    assert (plan.kind, how) == (IndexKind.BTREE, "chosen")
    assert C.choose(L.INT64, shape, measure, size_budget=1).kind == IndexKind.BTREE
    c.save(path := str(tmp_path / "catalog.json"))
    assert C.IndexCatalog.load(path).get("k") == plan and C.IndexCatalog.load(str(tmp_path / "none")).columns() == []
    (tmp_path / "catalog.json").write_text("{")
    with pytest.raises(ValueError):
        C.IndexCatalog.load(path)
    assert c.erase("k") and not c.erase("k") and c.freshness("k", shape) == "missing"


def test_the_rule():
    d = lambda matched, k=10, graph=True, mask=False, t=0.5: P.decide(matched, 100, k, t, graph, mask).kind
    assert d(0) == d(50) == d(90, graph=False) == d(90, k=90) == PlanKind.PRE_FILTER
    assert d(51) == PlanKind.FILTERED_GRAPH and d(51, mask=True) == PlanKind.BITMAP_FILTERED_GRAPH
    assert P.crossover([(0.2, 1, 2), (0.5, 3, 2), (0.8, 4, 2)], 0.5) == 0.35
    assert P.crossover([(0.2, 1, 2)], 0.4) == 0.4 and P.crossover([(0.2, 2, 1)], 0.4) == 0.1


def test_bitmaps(spark):
    draw = random.Random(2)
    rows = [(k, draw.choice([None, 1, 2, 3, 4])) for k in draw.sample(range(100_000), 400)] + [(0, 1), (32768, 2), (32769, 2)]
    rows = list(dict(rows).items())
    b = bitmaps.build(spark.createDataFrame(rows, "k long, v long"), "v", "k")
    got = lambda d: sorted(r[0] for r in bitmaps.keys(d).collect())
    assert got(bitmaps.compare(b, "<=", 2)) == sorted(k for k, v in rows if v is not None and v <= 2)
    assert got(bitmaps.complement(b, bitmaps.between(b, 2, 3))) == sorted(k for k, v in rows if v in (1, 4))
    assert bitmaps.count(bitmaps.intersection(bitmaps.compare(b, ">", 1), bitmaps.compare(b, "<", 4))).first()[0] == sum(v in (2, 3) for _, v in rows)
    assert [r[0] for r in bitmaps.decode(b).collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("shape", ["uniform", "lognormal", "sequential_gaps", "clustered"])
def test_learned_positions(spark, shape):
    rows = G.synthetic_keys(spark, shape, 800, 3, 5).orderBy("value").collect()
    keys = np.array([r["key"] for r in rows])
    assert (np.diff(keys) > 0).all() and [r["value"] for r in rows] == list(range(800)) and (shape != "sequential_gaps" or np.diff(keys).max() <= 7)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    rmi = learned.fit(df, 16)
    assert rmi.validate().count() == 0
    wanted = spark.createDataFrame([(int(k),) for k in keys[::7]] + [(-5,)], "key long")
    assert dict(rmi.find(wanted).collect()) == {int(k): i for i, k in enumerate(keys) if i % 7 == 0}
    s = rmi.stats().first()
    assert s["size"] == 800 and s["max_window"] > s["max_error"] >= s["mean_error"] >= 0
    new = [int(keys[-1]) + 5 + i for i in range(20)]
    merged, report = learned.merge(rmi, spark.createDataFrame([(k,) for k in new], "key long"), wanted.limit(3))
    every = sorted((set(keys.tolist()) | set(new)) - {int(k) for k in keys[::7][:3]})
    assert merged.validate().count() == 0 and [tuple(r) for r in merged.keys.select("key", "pos").orderBy("pos").collect()] == [(k, i) for i, k in enumerate(every)]
    assert 0 < report.filter("disturbed").count() < report.count() or shape in ("lognormal", "clustered")
    assert learned.model_scores(rmi).filter("score < 0 or score is null").count() == 0


def test_degenerate_lines(spark):
    fit = lambda rows: spark.createDataFrame(rows, "x double, y double").agg(*learned.line(F.col("x"), F.col("y"))).first()
    assert tuple(fit([])) == (0, 0) and tuple(fit([(3.0, 7.0)])) == (0, 7) and tuple(fit([(2.0, 1.0), (2.0, 3.0)])) == (0, 2)
    assert learned.normalise_keys(spark.createDataFrame([(5,), (5,)], "key long")).agg(F.max("x")).first()[0] == 0


def test_dynamic_index(spark):
    oracle = {k: k * 10 for k in range(40)}
    d = learned.DynamicIndex(spark.createDataFrame(list(oracle.items()), "key long, value long"))
    rows = lambda kv: spark.createDataFrame(kv, "key long, value long")
    assert [r[0] for r in d.insert(rows([(5, 0), (100, 1)])).collect()] == [5]
    d.erase(rows([(7, 0), (100, 0)]).select("key"))
    d.insert(rows([(7, 77)]))
    oracle[7] = 77
    assert dict(d.live().collect()) == oracle and d.find(7).first()["value"] == 77 and d.merge_due()
    d.merge()
    assert dict(d.live().collect()) == oracle and not d.merge_due() and [r[0] for r in d.range(3, 5).collect()] == [3, 4, 5]


def test_rank_and_thresholds(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 3, 3, 9])], "id long, v double")
    c = learned.ScalarColumn(df, "v", "id")
    assert (c.encode(3.0), c.encode_range(3.0, 5.0), c.key_cut_for_selectivity(0.5)) == (1, (1, 4), 2)
    assert sorted(r[0] for r in c.rows_below(3).collect()) == [1, 2, 3]
    t = [learned.threshold_for_selectivity(df, "v", s) for s in (0, 0.2, 1)]
    assert t[:2] == [1.0, 3.0] and 9 < t[2] < 9.001


def vecs(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<float>")


@pytest.mark.parametrize("metric", list(Metric))
def test_search_against_numpy(spark, metric):
    rng = np.random.default_rng(1)
    data = np.vstack([np.round(rng.normal(size=(80, 5)) * 2) / 2, np.zeros((1, 5))])
    q = data[3]
    dot = data @ q
    rank = ((data - q) ** 2).sum(1) if metric == Metric.L2 else -dot if metric == Metric.INNER_PRODUCT else -np.divide(dot, np.linalg.norm(data, axis=1) * np.linalg.norm(q), out=np.zeros(81), where=np.linalg.norm(data, axis=1) > 0)
    want = np.lexsort((np.arange(81), np.round(rank, 12)))[:12].tolist()
    df = vecs(spark, data)
    score = [r["score"] for r in V.search(df, q, 12, metric).collect()]
    assert score == sorted(score, reverse=metric != Metric.L2)
    if metric != Metric.COSINE:  # rounding may swap equal cosines
        assert [r["id"] for r in V.search(df, q, 12, metric).collect()] == want
    batch = V.search_batch(df, df.filter("id in (3, 4)"), 12, metric, block=1)
    assert batch.count() == 24 and np.allclose([r["score"] for r in batch.filter("qid = 3").orderBy("rank").collect()], score)


def test_scores_of_near_vectors_are_exact():
    """Far from the origin the expanded square cancels; the differences decide."""
    rng = np.random.default_rng(3)
    v = 1e6 + np.round(rng.normal(size=(500, 8)), 2)
    v[100:110] = v[7]  # ties
    q = np.vstack([v[:20] + 1e-3, v[7], np.zeros(8)])
    places, best = V.scores(v, q, Metric.L2, 25)
    d = ((v[:, None, :] - q[None, :, :]) ** 2).sum(axis=2)
    want = np.stack([np.lexsort((np.arange(500), d[:, j]))[:25] for j in range(len(q))], axis=1)
    assert (places == want).all() and np.array_equal(best, np.take_along_axis(d, want, axis=0))


def test_batches_larger_than_a_block(spark):
    base, _ = G.random_vectors(spark, 700, 6, 1, 4, 5)
    data = np.array([r["vector"] for r in base.orderBy("id").collect()], np.float64)
    d = ((data[:, None, :] - data[None, :, :]) ** 2).sum(axis=2)
    got = V.search_batch(base, base, 4, block=100).orderBy("qid", "rank").collect()
    assert [r["id"] for r in got] == [int(i) for j in range(700) for i in np.lexsort((np.arange(700), d[:, j]))[:4]]


def test_flat_index(spark):
    f = V.FlatIndex(spark, 2, Metric.COSINE)
    assert f.add([3, 4]) == 0 and list(f.add_batch([[1, 0], [0, 0]])) == [1, 2] and len(f) == 3
    assert np.allclose(f.vector_at(0), [0.6, 0.8]) and f.vector_at(2).tolist() == [0, 0]
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(f.search([1, 0], 2)) == [1, 0]
    assert ids(f.search_filtered([1, 0], 5, spark.createDataFrame([(2,), (0,)], "id long"))) == [0, 2]
    assert ids(f.search_masked([1, 0], 5, F.col("id") > 0)) == [1, 2]
    with pytest.raises(ValueError):
        f.search_filtered([1, 0], 5, spark.createDataFrame([(9,)], "id long"))
    for bad in ([1, 2, 3], [1]):
        with pytest.raises(ValueError):
            f.add(bad)
    more = V.FlatIndex(spark, 2)
    more.add_frame(vecs(spark, [[0, 0], [1, 1], [2, 2]]), "id")
    assert ids(more.search([2, 2], 1)) == [2]


def test_cells_and_router(spark):
    base, queries = G.random_vectors(spark, 400, 8, 20, 1, 6)
    truth = V.search_batch(base, queries, 5)
    index = ann.CellIndex(spark, base, 8, cells=8, seed=1)
    recalls = [V.recall_at_k(index.search_batch(queries, 5, ef), truth, 5) for ef in (1, 100, ann.FULL_EFFORT)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0 and recalls[1] > 0.8
    q = queries.first()["vector"]
    allowed = base.filter("id % 50 = 0").select("id")
    exact = [r["id"] for r in V.search(base.join(allowed, "id", "left_semi"), q, 3).collect()]
    assert [r["id"] for r in index.search(q, 3, ann.FULL_EFFORT, allowed).collect()] == exact and index.search(q, 3, 1, allowed).count() == 3
    x, y = ann.training_set(index.frame, 200)
    mlp = ann.RouterMLP.fit(x, y, len(index.centres), hidden=32, epochs=150, rate=0.01, batch=32)
    assert np.mean([mlp.predict(v, 1)[0] == c for v, c in zip(x, y, strict=True)]) > 0.8
    assert np.allclose(ann.RouterMLP.from_json(mlp.to_json({0: 5}, 1.5)).logits(x), mlp.logits(x))
    with pytest.raises(ValueError):
        mlp.require_compatible(9, len(index.centres))
    index.set_router(mlp)
    assert V.recall_at_k(index.search_batch(queries, 5, ann.FULL_EFFORT), truth, 5) == 1.0
    assert abs(index.router_health(100) - 1) < 0.5 and V.recall_at_k(truth, truth, 5) == 1
    m = index.repair_router_medoids().collect()
    assert len(m) == len(index.centres) == index.stats()["cells"] and all(r["distance"] >= 0 for r in m)


def test_gradients():
    rng = np.random.default_rng(0)
    params = [rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=(4, 2)), rng.normal(size=2)]
    x, y = rng.normal(size=(6, 3)), rng.integers(0, 2, 6)
    loss = lambda: -np.log(ann.softmax(np.maximum(x @ params[0] + params[1], 0) @ params[2] + params[3])[np.arange(6), y]).mean()
    for p, g in zip(params, ann.RouterMLP.gradients(params, x, y), strict=True):
        at = (0,) * p.ndim
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_standalone_planner(spark):
    base, _ = G.random_vectors(spark, 200, 4, 1, 2, 4)
    attrs = G.hybrid_attributes(spark, 200, 2)
    p = P.HybridPlanner(base)
    p.set_column("price", attrs.select("id", "price"), L.DOUBLE)
    p.set_column("category", attrs.select("id", "category"), L.INT64, bitmap=True)
    q = base.first()["vector"]
    want = [r["id"] for r in V.search(base.join(attrs.filter("price < 900"), "id", "left_semi"), q, 5).collect()]
    assert [r["id"] for r in p.search(("price", "<", 900.0), q, 5)[0].collect()] == want
    p.set_graph(ann.CellIndex(spark, base, 4, cells=4))
    found, plan = p.search(("price", "<", 900.0), q, 5, ann.FULL_EFFORT)
    assert [r["id"] for r in found.collect()] == want and plan.kind == PlanKind.FILTERED_GRAPH
    assert p.explain(("category", ">=", 0)).kind == PlanKind.BITMAP_FILTERED_GRAPH
    assert [r["id"] for r in p.search_with(PlanKind.PRE_FILTER, ("price", "<", 900.0), q, 5).collect()] == want
    with pytest.raises(ValueError):
        p.explain(("price", "is null"))
    with pytest.raises(KeyError, match="price"):
        p.explain(("nope", "=", 1))
    assert 0 <= p.calibrate([q], 5, samples=2) <= 1


def test_files(spark, tmp_path):
    data = np.random.default_rng(0).normal(size=(10, 3)).astype(np.float32)
    path = str(tmp_path / "a.fvecs")
    assert files.write_fvecs(vecs(spark, data), path) == 10
    back = files.read_fvecs(spark, path).orderBy("id").collect()
    assert np.array_equal(np.array([r["vector"] for r in back], np.float32), data) and files.read_fvecs(spark, path, 4).count() == 4
    with open(path, "ab") as f:
        f.write(b"xx")
    with pytest.raises(ValueError):
        files.read_fvecs(spark, path)
    (tmp_path / "e.fvecs").write_bytes(b"")
    with pytest.raises(ValueError):
        files.read_fvecs(spark, str(tmp_path / "e.fvecs"))
    np.concatenate([np.array([2, 7, 8], "<i4")]).tofile(str(tmp_path / "t.ivecs"))
    assert files.read_ivecs(spark, str(tmp_path / "t.ivecs")).first()["vector"] == [7, 8]
    sosd = str(tmp_path / "k_uint64")
    files.write_sosd([5, 3, 5, 9], sosd)
    keys, dropped = files.load_sosd(spark, sosd)
    assert [tuple(r) for r in keys.orderBy("key").collect()] == [(3, 0), (5, 1), (9, 2)] and dropped == 1
    with pytest.raises(ValueError):
        files.write_sosd([1], str(tmp_path / "nowidth"))
    np.save(str(tmp_path / "v.npy"), data)
    assert files.read_npy(spark, str(tmp_path / "v.npy")).count() == 10
    (tmp_path / "k.csv").write_text("a,b\n1,2\nx,3\n4,\n5,6\n")
    good, bad = files.read_key_csv(spark, str(tmp_path / "k.csv"), "a", 1)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2), (5, 6)] and bad == 2
    (tmp_path / "v.csv").write_text("1.5,2\n3,4\n")
    assert sorted(r["vector"] for r in files.read_vector_csv(spark, str(tmp_path / "v.csv")).collect()) == [[1.5, 2.0], [3.0, 4.0]]
