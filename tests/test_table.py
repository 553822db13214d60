import io
import json
import os
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.predicates import Predicate, PredOp
from tessera.functions.schema import ColumnDef, Record, Schema
from tessera.functions.types import IndexKind, LogicalType, Metric, PlanKind, VectorStructure, parse_value
from tessera.operators.table import Table, VectorPlan
from tessera.operators.vectors import FlatIndex
from tessera.sources.files import ranked
from tessera.sources.store import RecordStore
from tessera.streaming.changelog import FollowedTable

L = LogicalType
N = 120


def shop():
    return Schema([ColumnDef("price", L.INT64), ColumnDef("category", L.STRING), ColumnDef("title", L.STRING), ColumnDef("created_at", L.TIMESTAMP), ColumnDef("image", L.VECTOR, 4)])


KINDS = ("tea", "rice", "salt", "oil")
WORDS = ("green leaf", "green tips", "long grain", "sea", "olive", "olive, cold", "50% off")


def record(i):
    c = {"price": str((i * i + 11 * i) % 613), "category": KINDS[i * 5 % 4], "title": WORDS[i * 3 % 7]}
    return Record(i * 3 + 1, c if i % 9 == 4 else c | {"created_at": f"2024-0{i % 6 + 1}-1{i % 10}T0{i % 8}:30:00Z"})


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    t = Table(RecordStore(spark, str(tmp_path_factory.mktemp("shop"))), shop())
    t.put_batch(record(i) for i in range(N))
    rng = np.random.default_rng(7)
    keys = [record(i).key for i in range(N - 1, 9, -1)]  # descending, and not for all records
    t.put_vectors("image", keys, np.round(rng.normal(size=(len(keys), 4)) * 2) / 2)
    t.store.checkpoint()
    t.save_vectors()
    return t


def keys(df):
    return [r[0] for r in df.collect()]


@pytest.mark.parametrize("op, column, v, v2, test", [
    ("=", "price", 60, None, lambda c: c["price"] == "60"),
    ("<", "price", 100, None, lambda c: int(c["price"]) < 100),
    (">=", "price", 400, None, lambda c: int(c["price"]) >= 400),
    ("between", "price", 10, 90, lambda c: 10 <= int(c["price"]) <= 90),
    ("between", "price", 90, 10, lambda c: False),
    ("prefix", "title", "oli", None, lambda c: c["title"].startswith("oli")),
    ("prefix", "title", "%", None, lambda c: False),
    ("contains", "title", "n l", None, lambda c: "n l" in c["title"]),
    ("contains", "title", "%", None, lambda c: "%" in c["title"]),
    ("is null", "created_at", None, None, lambda c: "created_at" not in c),
    (">", "created_at", 1711929600000, None, lambda c: c.get("created_at", "") > "2024-04-01T00"),
])
def test_predicates_against_records(table, op, column, v, v2, test):
    want = [record(i).key for i in range(N) if test(record(i).columns)]
    found, trace = table.select_keys(column, op, v, v2)
    assert keys(found) == want and trace.matched == len(want) == table.count(column, op, v, v2)
    assert trace.scanned == N and not trace.used_index
    assert [r["_key"] for r in table.select(column, op, v, v2)[0].collect()] == want


def test_conjunction_disjunction_scan(table):
    assert len(keys(table.select_all([])[0])) == N and keys(table.select_any([])[0]) == []
    both = [("price", "<", 250), ("category", "=", "rice")]
    a, b = ({record(i).key for i in range(N) if f(record(i).columns)} for f in (lambda c: int(c["price"]) < 250, lambda c: c["category"] == "rice"))
    assert keys(table.select_all(both)[0]) == sorted(a & b) and keys(table.select_any(both)[0]) == sorted(a | b)
    assert keys(table.scan()) == sorted(record(i).key for i in range(N))
    assert keys(table.scan(5, 3)) == [record(i).key for i in range(3, 8)] and keys(table.scan(0, N + 5)) == []


def brute(table, query, k, allowed=None):
    rows = table._vector("image").live().collect()
    d = sorted((float(((np.array(r["embedding"], np.float64) - query) ** 2).sum()), r["_vrow"], r["_key"]) for r in rows if allowed is None or r["_key"] in allowed)
    return [(key, row, round(float(np.sqrt(x)), 6)) for x, row, key in d[:k]]


def rounded(df):
    return [(r["key"], r["row"], round(r["score"], 6)) for r in df.collect()]


def test_knn_breaks_ties_by_row(table):
    q = np.array([0.5, 0, -0.5, 1])
    assert rounded(table.knn("image", q, 15)) == brute(table, q, 15)
    assert table.knn("image", q, 0).count() == 0 and table.knn("image", q, 1000).count() == N - 10
    key = record(20).key
    near = [r["key"] for r in table.knn_by_key("image", key, 4).collect()]
    assert key not in near and len(near) == 4
    with pytest.raises(KeyError):
        table.knn_by_key("image", record(0).key, 3)
    with pytest.raises(ValueError):
        table.knn("image", [1, 2], 3)


def test_all_plans_agree(table):
    q, preds = np.array([0.1, -1, 0.5, 1]), [("price", "<", 300)]
    allowed = {record(i).key for i in range(N) if int(record(i).columns["price"]) < 300}
    want = brute(table, q, 5, allowed)
    found, trace = table.hybrid(preds, "image", q, 5)
    assert rounded(found) == want and trace.plan.kind == PlanKind.PRE_FILTER
    assert trace.without_vector == len(allowed & {record(i).key for i in range(10)}) > 0 and trace.structured.matched == len(allowed)
    table.create_vector_index("image", VectorPlan(VectorStructure.GRAPH, Metric.L2, cells=6))
    kind = table.hybrid(preds, "image", q, 5)[1].plan.kind
    assert kind == PlanKind.FILTERED_GRAPH and table.explain_hybrid(preds, "image", 500).plan.kind == PlanKind.PRE_FILTER
    assert table.explain_hybrid([("price", "<", -1)], "image").plan.matched_rows == 0
    for k in (PlanKind.PRE_FILTER, PlanKind.FILTERED_GRAPH):
        assert rounded(table.hybrid_with(k, preds, "image", q, 5, ef=400)[0]) == want
    post = rounded(table.hybrid_with(PlanKind.POST_FILTER, preds, "image", q, 5, ef=400)[0])
    assert post == want[: len(post)]
    assert not table.plan_available(PlanKind.BITMAP_FILTERED_GRAPH, preds, "image")
    with pytest.raises(ValueError):
        table.hybrid_with(PlanKind.BITMAP_FILTERED_GRAPH, preds, "image", q)
    table.create_index_as("price", IndexKind.BITMAP)
    assert table.hybrid(preds, "image", q, 5)[1].plan.kind == PlanKind.BITMAP_FILTERED_GRAPH
    assert rounded(table.hybrid_with(PlanKind.BITMAP_FILTERED_GRAPH, preds, "image", q, 5, ef=400)[0]) == want
    assert table.hybrid([], "image", q, 3)[1].plan.kind == PlanKind.NO_PREDICATE
    assert table.drop_index("price") and not table.drop_index("price") and table.drop_vector_index("image")


def test_writes_and_reopening(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        Table.open(store)
    t = Table(store, shop())
    with pytest.raises(ValueError):
        t.put_batch([record(1), Record(9, {"price": "x"})])
    assert len(t) == 0
    r = t.put_batch([record(0), record(1), Record(record(1).key, {"price": "5"})])
    assert (r.rows_written, r.rows_created) == (3, 2)
    assert t.get(record(1).key).columns == {"price": "5"}  # the whole record is replaced, the last one holds
    t.update(record(1).key, {"title": "new"})
    assert t.get(record(1).key).columns == {"price": "5", "title": "new"}
    with pytest.raises(KeyError):
        t.update(999, {"title": "x"})
    with pytest.raises(KeyError):
        t.put_vectors("image", [999], [[0, 0, 0, 1]])
    t.put_vectors("image", [1, 4], [[0, 0, 0, 1], [0, 0, 1, 0]])
    assert t.put_vector(1, "image", [1, 1, 1, 1]) == 2
    info = t.vector_info("image")
    assert (info.rows, info.orphans, info.rows_are_keys) == (2, 1, False)
    assert t.get_vector(1, "image").tolist() == [1, 1, 1, 1]
    assert t.compact_vectors("image") == 1 and keys(t.vector_keys("image")) == [4, 1]
    t.create_index("price")
    t.checkpoint()
    assert t.freshness("price") == "fresh"
    t.put(record(7))
    assert t.freshness("price") == "stale"
    assert t.erase(4).rows_written == 1 and t.erase(4).rows_written == 0
    t.validate()
    again = Table.open(RecordStore(spark, str(tmp_path / "s")))
    assert keys(again.scan()) == [1, record(7).key] and not again.has_index("price") and again.catalog.get("price") is not None
    assert again.has_vector(4, "image")  # vectors are kept as of the last save
    with pytest.raises(ValueError):
        again.validate()
    with pytest.raises(ValueError):
        Table(RecordStore(spark, str(tmp_path / "s")), Schema([ColumnDef("price", L.STRING)]))
    again.add_column(ColumnDef("more", L.DOUBLE))
    assert again.count("more", PredOp.IS_NULL) == 2


def test_torn_lines_and_unknown_operations(spark, tmp_path):
    s = RecordStore(spark, str(tmp_path / "w"))
    s.put(Record(1, {"a": "é\n\"x\""}))
    s.put(Record(2, {}))
    with open(f"{s.wal}/{9:020d}.json", "w") as f:
        f.write('{"lsn":9,"op":"put","key":3,"payload":{"a":"b"},"more":1}\n{"lsn":10,"op":"pu')
    s = RecordStore(spark, str(tmp_path / "w"))
    assert len(s) == 3 and s.get(1).columns == {"a": "é\n\"x\""} and s._lsn == 10
    assert s.delete(2) and not s.delete(2) and 2 not in s
    s.checkpoint()
    assert len(RecordStore(spark, str(tmp_path / "w"))) == 2 and len(os.listdir(s.wal)) == 0
    with open(f"{s.wal}/{50:020d}.json", "w") as f:
        f.write(json.dumps({"lsn": 50, "op": "boom"}) + "\n")
    with pytest.raises(ValueError):
        RecordStore(spark, str(tmp_path / "w"))


def test_a_stream_follows_the_log(spark, tmp_path):
    s = RecordStore(spark, str(tmp_path / "l"))
    s.put_many(Record(i, {"v": str(i)}) for i in range(5))
    f = FollowedTable(spark, str(tmp_path / "f"))
    go = lambda: f.follow(s.wal, str(tmp_path / "c")).awaitTermination()
    go()
    s.delete(3)
    s.put(Record(1, {"v": "new"}))
    go()
    assert sorted((r["key"], r["payload"]["v"]) for r in f.frame().collect()) == [(0, "0"), (1, "new"), (2, "2"), (4, "4")]
    before = f._current()
    f.apply(s.spark.createDataFrame([(99, "put", 77, None)], "lsn long, op string, key long, payload map<string,string>"), before["batch"])
    assert f._current() == before and f.frame().filter("key = 77").count() == 0


def texts(spark, rows):
    return spark.createDataFrame(rows, "key long, payload map<string,string>")


def test_frames_are_written_and_come_back(spark, tmp_path):
    t = Table(RecordStore(spark, str(tmp_path / "s")), shop())
    t.put(Record(1, {"price": "1"}))
    first = [(i, {"price": str(i), "title": "a"}) for i in range(1000)]
    again = [(i, {"price": str(-i)}) for i in range(0, 1000, 7)]
    r = t.put_frame(texts(spark, first + again))
    assert (r.rows_written, r.rows_created) == (1000 + len(again), 999)
    want = {k: p for k, p in first} | {k: p for k, p in again}
    state = lambda table: {r["key"]: dict(r["payload"]) for r in table.store.frame().collect()}
    assert state(t) == want and t.get(7).columns == {"price": "-7"}
    assert state(Table(RecordStore(spark, str(tmp_path / "s")), shop())) == want
    t.checkpoint()
    assert state(t) == want and len(os.listdir(t.store.wal)) == 0
    t.put_frame(texts(spark, [(3, {"price": "9"}), (5000, {})]))
    t.erase(4)
    want |= {3: {"price": "9"}, 5000: {}}
    del want[4]
    for table in (t, Table.open(RecordStore(spark, str(tmp_path / "s")))):
        assert state(table) == want
        got = {r["_key"]: r["price"] for r in table.frame().collect()}
        assert got == {k: int(p["price"]) if "price" in p else None for k, p in want.items()}
        assert table.count("price", "<", 0) == sum(int(p.get("price", 1)) < 0 for p in want.values())
    with pytest.raises(ValueError):
        t.put_frame(texts(spark, [(1, {"price": "x"})]))
    with pytest.raises(ValueError):
        t.store.append_frame(spark.createDataFrame([("boom", 1, {})], "op string, key long, payload map<string,string>"))
    assert t.put_frame(texts(spark, [])).rows_written == 0 and state(t) == want


def test_a_column_newer_than_the_snapshot(spark, tmp_path):
    t = Table(RecordStore(spark, str(tmp_path / "s")), Schema([ColumnDef("a", L.INT64)]))
    t.put_batch([Record(1, {"a": "1"}), Record(2, {"a": "2"})])
    t.checkpoint()
    t.add_column(ColumnDef("b", L.STRING))
    t.put(Record(3, {"b": "x"}))
    assert [tuple(r) for r in t.scan().collect()] == [(1, 1, None), (2, 2, None), (3, None, "x")]


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_wide_rows_keep_their_ranks(spark, aqe):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    n = 40_000
    wide = spark.range(n).select((F.col("id") * 7919 % 40_009).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i + F.col("id")).cast("float")).alias("vector"))
    try:
        for parts in ("1", "20", "200"):
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            r = ranked(wide, "id", "__i").select("id", "__i", "vector").orderBy("id").select("__i", (F.col("vector")[0] == F.col("id").cast("float")).alias("own")).collect()
            assert [x[0] for x in r] == list(range(n)) and all(x[1] for x in r)
        flat = FlatIndex(spark, 64)
        assert flat.add_frame(wide, "id") == range(n) and flat.frame.count() == n == flat.frame.select("id").distinct().count()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_ranks_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 2,) for i in range(500)], "k int")
    rows = sorted(tuple(r) for r in ranked(df, "k", "r").select("r", "k").collect())
    assert [r for r, _ in rows] == list(range(500)) and [k for _, k in rows] == sorted((k for _, k in rows), key=lambda k: (k is not None, k))
    assert ranked(df.limit(0), "k").count() == 0


def test_vector_frames_and_compaction(spark, tmp_path):
    n = 20_000
    t = Table(RecordStore(spark, str(tmp_path / "s")), Schema([ColumnDef("image", L.VECTOR, 64)]))
    t.put_frame(spark.range(n).select(F.col("id").alias("key"), F.create_map().cast("map<string,string>").alias("payload")))
    rows = spark.range(n).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * F.col("id")).cast("float")).alias("v"))
    assert t.put_vector_frame("image", rows, "k", "v") == n
    assert t.put_vector_frame("image", rows.filter("k % 10 = 0"), "k", "v") == n // 10
    info = t.vector_info("image")
    assert (info.rows, info.orphans) == (n, n // 10)
    assert t.compact_vectors("image") == n // 10
    info = t.vector_info("image")
    assert (info.rows, info.orphans) == (n, 0)
    got = t._vector("image").live().agg(F.count_distinct("_key"), F.count_distinct("_vrow"), F.min("_vrow"), F.max("_vrow"), F.min(F.col("embedding")[1] == F.col("_key").cast("float"))).first()
    assert tuple(got) == (n, n, 0, n - 1, True)
    assert t.put_vector(5, "image", [1.0] * 64) == n and t.get_vector(5, "image").tolist() == [1.0] * 64
    with pytest.raises(KeyError):
        t.put_vector_frame("image", rows.limit(1).withColumn("k", F.lit(n + 5)), "k", "v")
    t.save()
    again = Table.open(RecordStore(spark, str(tmp_path / "s")))
    assert again.vector_info("image").rows == n and again.get_vector(5, "image").tolist() == [1.0] * 64


def test_many_single_writes_keep_the_plan_short(spark, tmp_path):
    t = Table(RecordStore(spark, str(tmp_path / "s")), Schema([ColumnDef("image", L.VECTOR, 2)]))
    t.put_batch(Record(i, {}) for i in range(3))
    for i in range(20):
        t.put_vector(i % 3, "image", [i, 0])
    assert t._vector("image")._steps < 16 and sorted(t.get_vector(k, "image")[0] for k in range(3)) == [17, 18, 19]


CONDITIONS = [
    ("price", "=", 60), ("price", "=", -1), ("price", "<", 100), ("price", "<=", 60), ("price", ">", 600), ("price", ">=", 400), ("price", "between", 10, 90), ("price", "between", 90, 10),
    ("title", "prefix", "ol"), ("title", "prefix", ""), ("title", "=", "sea"), ("title", "contains", "n l"), ("title", "is null"), ("created_at", ">", 1711929600000), ("created_at", "=", 1704069000000), ("stock", "=", 33), ("stock", "between", 10, 40), ("stock", ">", 10**6),
]


def matches(columns, p):
    c, op, *v = p
    x = columns.get(c)
    if op == "is null":
        return x is None
    if x is None:
        return False
    kind = LAID.type_of(c)
    x = parse_value(kind, x)
    return {"=": lambda: x == v[0], "<": lambda: x < v[0], "<=": lambda: x <= v[0], ">": lambda: x > v[0], ">=": lambda: x >= v[0], "between": lambda: v[0] <= x <= v[1], "prefix": lambda: x.startswith(v[0]), "contains": lambda: v[0] in x}[op]()


LAID = Schema([ColumnDef("price", L.INT64), ColumnDef("title", L.STRING), ColumnDef("created_at", L.TIMESTAMP), ColumnDef("stock", L.INT64)])


def plan_of(df):
    with redirect_stdout(out := io.StringIO()):
        df.explain("formatted")
    return out.getvalue()


def test_layouts_answer_as_the_records_do(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Table, "POINTS", 8)
    t = Table(RecordStore(spark, str(tmp_path / "s")), LAID)
    state = {i: {k: v for k, v in record(i).columns.items() if k != "category"} | {"stock": str(i * i - 40 * i)} for i in range(80)}
    state = {k: v for k, v in state.items() if k < 21 or k > 40}  # stock is unique
    t.put_batch(Record(k, v) for k, v in state.items())
    t.checkpoint()
    kinds = {"price": IndexKind.BITMAP, "title": IndexKind.BTREE, "created_at": IndexKind.BTREE, "stock": IndexKind.RMI}

    def check(over, step=4):
        for p in CONDITIONS[::step]:
            want = sorted(k for k, c in state.items() if matches(c, p))
            found, trace = t.select_keys(*p)
            rows, _ = t.select(*p)
            assert keys(found) == want == keys(rows.select("_key")) and trace.matched == len(want) == t.count(*p), (p, trace.reason)
            indexed = p[1] not in ("contains", "is null")
            assert trace.used_index == (indexed and p[0] in kinds) and trace.scanned == (len(state) if not trace.used_index else over), (p, trace.reason)
        for some in ([("price", ">=", 10), ("title", "prefix", "o")], [("price", "<", 500), ("price", ">", 100)], [("stock", "between", 0, 50), ("title", "prefix", "g"), ("created_at", "is null")])[: 3 if step == 1 else 2]:
            both = sorted(k for k, c in state.items() if all(matches(c, p) for p in some))
            any_ = sorted(k for k, c in state.items() if any(matches(c, p) for p in some))
            assert keys(t.select_all(some)[0]) == both == [r["_key"] for r in t.select_all_records(some)[0].collect()] and keys(t.select_any(some)[0]) == any_, some

    for c, kind in kinds.items():
        info = t.create_index_as(c, kind)
        assert info.kind == kind and info.index_bytes > 0 and info.ns_per_lookup > 0 and not info.dirty
    check(0, 1)
    assert "intersected" in t.select_all([("price", "<", 500), ("price", ">", 100)])[1].reason
    assert "most selective" in t.select_all([("stock", "=", 33), ("title", "prefix", "o")])[1].reason
    assert t.estimate("price", "<", 100) == t.count("price", "<", 100) and t.estimate("title", "=", "sea") == len(state) == t.estimate("price", "is null")
    # writes lie over the layouts until the next checkpoint
    for r in (Record(3, {"price": "60", "title": "sea", "stock": "999999"}), Record(500, {"price": "60"}), Record(7, {})):
        state[r.key] = r.columns
        t.put(r)
    t.erase(12)
    del state[12]
    assert t.info("price").dirty and t.rebuilds() == 0
    check(4)
    t.checkpoint()
    assert t.rebuilds() == 4 and not t.info("price").dirty
    t.put(Record(8, {"price": "61", "stock": "999999"}))  # no longer unique
    state[8] = {"price": "61", "stock": "999999"}
    t.store.checkpoint()  # behind the table's back: the log is gone
    check(0)
    assert t.explain_column("stock").kind == IndexKind.BTREE and t.rebuilds() > 4
    folders = [f for f in os.listdir(t.store.path) if f.startswith("layout-")]
    assert len(folders) == 4 and all(t.drop_index(c) for c in kinds) and not [f for f in os.listdir(t.store.path) if f.startswith("layout-")]


def test_predicates_reach_the_scan_of_a_table(spark, tmp_path):
    t = Table(RecordStore(spark, str(tmp_path / "s")), LAID)
    t.put_frame(spark.range(3000).select(F.col("id").alias("key"), F.create_map(F.lit("price"), (F.col("id") % 100).cast("string"), F.lit("title"), F.concat(F.lit("t"), "id"), F.lit("stock"), (F.col("id") * 7).cast("string")).alias("payload")))
    t.checkpoint()
    plan = plan_of(t.select("price", ">", 90)[0])
    assert "GreaterThan(v_price,90)" in plan and "payload" not in plan, plan
    t.create_index_as("stock", "rmi")
    layout = t._layouts["stock"]
    first, last = layout.window(700)
    assert first <= 100 <= last < 200 and layout.window(700)[1] - first < 3000
    plan = plan_of(layout.keys(Predicate.of(("stock", "=", 700))))
    assert f"GreaterThanOrEqual(pos,{first})" in plan and f"LessThanOrEqual(pos,{last})" in plan, plan
    assert "PushedFilters: [IsNotNull(key)" in plan_of(t.select("stock", "=", 700)[0]) or "EqualTo(key,100)" in plan_of(t.select("stock", "=", 700)[0])
    t.create_index_as("title", "btree")
    assert "StringStartsWith(value,t12)" in plan_of(t.select_keys("title", "prefix", "t12")[0])
    t.create_index_as("price", "bitmap")
    assert "LessThan(value,5)" in plan_of(t.select_keys("price", "<", 5)[0]) and t.count("price", "<", 5) == 150


def test_a_choice_is_measured_and_replayed(spark, tmp_path):
    t = Table(RecordStore(spark, str(tmp_path / "s")), LAID)
    t.put_batch(Record(i, {"price": str(i % 5), "stock": str(i * i)}) for i in range(100))
    info = t.create_index("price")
    assert info.indexed and info.kind in (IndexKind.BITMAP, IndexKind.BTREE) and t.explain_column("price").ns_per_lookup > 0
    before = t.explain_column("price")
    assert t.create_index("price").indexed and t.explain_column("price") == before  # replayed
    assert keys(t.select_keys("price", "=", 3)[0]) == list(range(3, 100, 5))
    t.put(Record(99, {"price": "77"}))
    assert t.freshness("price") == "stale" and t.create_index("price").indexed and t.freshness("price") == "fresh"
    assert t.explain_column("price").key_max == 77 and not [f for f in os.listdir(t.store.path) if f == "measured"]
