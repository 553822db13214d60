"""Queries over the driver's tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import types as X
from tessera.functions.predicates import Predicate, PredOp, all_of, any_of
from tessera.functions.schema import ColumnDef, Schema
from tessera.functions.types import LogicalType, Metric, PlanKind
from tessera.operators import ann, bitmaps, learned
from tessera.operators import vectors as V
from tessera.plans import catalog, planner
from tessera.sources.store import fold

L = LogicalType
PART = Schema([ColumnDef("p_name", L.STRING), ColumnDef("p_brand", L.STRING), ColumnDef("p_type", L.STRING), ColumnDef("p_size", L.INT64), ColumnDef("p_retailprice", L.DOUBLE)])
ORDERS = Schema([ColumnDef("o_totalprice", L.DOUBLE), ColumnDef("o_orderdate", L.TIMESTAMP), ColumnDef("o_orderstatus", L.STRING), ColumnDef("o_orderpriority", L.STRING)])
EVENTS = Schema([ColumnDef("ts", L.TIMESTAMP), ColumnDef("event_type", L.STRING), ColumnDef("value", L.DOUBLE)])

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _part(spark, sf):
    return _t(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("long"))


# predicates


def _predicate(name: str, table: str, schema: Schema, key: str, p: Predicate, where: str) -> None:
    def run(spark, sf):
        rows = _part(spark, sf) if table == "part" else _t(spark, sf, table)
        return rows.filter(p.compile(schema)).select(key).orderBy(key)

    query(f"SELECT {key} FROM {table} WHERE {where} ORDER BY {key}", name)(run)


P = Predicate
_predicate("pred_eq_string", "part", PART, "p_partkey", P("p_brand", PredOp.EQ, "Brand#12"), "p_brand = 'Brand#12'")
_predicate("pred_eq_int", "part", PART, "p_partkey", P("p_size", PredOp.EQ, 7), "p_size = 7")
_predicate("pred_lt_int", "part", PART, "p_partkey", P("p_size", PredOp.LT, 7), "p_size < 7")
_predicate("pred_le_double", "orders", ORDERS, "o_orderkey", P("o_totalprice", PredOp.LE, 50000.0), "o_totalprice <= 50000.0")
_predicate("pred_gt_double", "orders", ORDERS, "o_orderkey", P("o_totalprice", PredOp.GT, 200000.0), "o_totalprice > 200000.0")
_predicate("pred_ge_timestamp", "orders", ORDERS, "o_orderkey", P("o_orderdate", PredOp.GE, 852076800000), "epoch_ms(o_orderdate) >= 852076800000")
_predicate("pred_between_int", "part", PART, "p_partkey", P("p_size", PredOp.BETWEEN, 10, 20), "p_size BETWEEN 10 AND 20")
_predicate("pred_between_timestamp", "orders", ORDERS, "o_orderkey", P("o_orderdate", PredOp.BETWEEN, 757382400000, 788918400000), "epoch_ms(o_orderdate) BETWEEN 757382400000 AND 788918400000")
_predicate("pred_between_inverted_empty", "part", PART, "p_partkey", P("p_size", PredOp.BETWEEN, 20, 10), "p_size BETWEEN 20 AND 10")
_predicate("pred_prefix", "part", PART, "p_partkey", P("p_type", PredOp.PREFIX, "S"), "starts_with(p_type, 'S')")
_predicate("pred_prefix_empty", "part", PART, "p_partkey", P("p_name", PredOp.PREFIX, ""), "p_name IS NOT NULL")
_predicate("pred_prefix_literal_percent", "part", PART, "p_partkey", P("p_name", PredOp.PREFIX, "%"), "starts_with(p_name, '%')")
_predicate("pred_contains", "part", PART, "p_partkey", P("p_name", PredOp.CONTAINS, "l r"), "contains(p_name, 'l r')")
_predicate("pred_contains_long_text", "documents", Schema([ColumnDef("text", L.STRING)]), "doc_id", P("text", PredOp.CONTAINS, "license"), "contains(text, 'license')")


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS ts FROM events) WHERE ts IS NULL")
def pred_is_null(spark, sf):
    rows = _t(spark, sf, "events").withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return rows.filter(P("ts", PredOp.IS_NULL).compile(EVENTS)).select("event_id")


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_brand = 'Brand#12' AND p_retailprice < 1500.0 ORDER BY p_partkey")
def select_all_and(spark, sf):
    conds = [("p_size", ">=", 10), ("p_brand", "=", "Brand#12"), ("p_retailprice", "<", 1500.0)]
    return _part(spark, sf).filter(all_of(conds, PART)).select("p_partkey").orderBy("p_partkey")


@query("SELECT p_partkey FROM part ORDER BY p_partkey")
def select_all_empty_list(spark, sf):
    return _part(spark, sf).filter(all_of([], PART)).select("p_partkey").orderBy("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size = 3 OR p_brand = 'Brand#21' OR starts_with(p_type, 'E') ORDER BY p_partkey")
def select_any_or(spark, sf):
    conds = [("p_size", "=", 3), ("p_brand", "=", "Brand#21"), ("p_type", "prefix", "E")]
    return _part(spark, sf).filter(any_of(conds, PART)).select("p_partkey").orderBy("p_partkey")


@query("SELECT p_partkey FROM part WHERE false")
def select_any_empty_list(spark, sf):
    return _part(spark, sf).filter(any_of([], PART)).select("p_partkey")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000.0")
def count_pred(spark, sf):
    return _t(spark, sf, "orders").filter(P("o_totalprice", PredOp.GT, 100000.0).compile(ORDERS)).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_partkey LIMIT 25 OFFSET 50")
def scan_limit_offset(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", "p_name", "p_size").orderBy("p_partkey").offset(50).limit(25)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 17")
def get_key(spark, sf):
    return _t(spark, sf, "part").filter(F.col("p_partkey") == 17).select("p_partkey", "p_name")


# shapes and layouts

_SHAPE = """SELECT '{c}' AS name, count(*) AS "rows", count(DISTINCT v) AS "distinct", count(*) = count(DISTINCT v) AS is_unique,
  coalesce(bool_and(r > lag_r), true) AS monotone, 1.0 - count(DISTINCT v) / count(*) AS duplicate_fraction
  FROM (SELECT v, r, coalesce(lag(r) OVER (ORDER BY v, r), -1) AS lag_r FROM (SELECT {c} AS v, {k} AS r FROM {t}))"""
_COLUMNS = [("part", "p_partkey", c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")] + [("orders", "o_orderkey", c) for c in ("o_totalprice", "o_orderdate", "o_orderstatus")]


@query(" UNION ALL ".join(_SHAPE.format(t=t, k=k, c=c) for t, k, c in _COLUMNS))
def describe_columns(spark, sf):
    out = None
    for table, key, c in _COLUMNS:
        s = catalog.shape_frame(_t(spark, sf, table).select(key, F.col(c).alias("__v")), "__v", key)
        s = s.select(F.lit(c).alias("name"), "*", (1.0 - F.col("distinct") / F.col("rows")).alias("duplicate_fraction"))
        out = s if out is None else out.unionByName(s)
    return out


@query(
    """WITH s AS (SELECT 'p_size' AS name, 'int64' AS type, count(*) AS n, count(DISTINCT p_size) AS d FROM part UNION ALL
  SELECT 'o_totalprice', 'double', count(*), count(DISTINCT o_totalprice) FROM orders UNION ALL
  SELECT 'p_partkey', 'int64', count(*), count(DISTINCT p_partkey) FROM part UNION ALL
  SELECT 'o_orderstatus', 'string', count(*), count(DISTINCT o_orderstatus) FROM orders)
SELECT name, 'bitmap' AS kind, 'dictionary' AS encoding, CAST(0 AS BIGINT) AS models FROM s WHERE d <= 1024 OR d / n <= 0.01
UNION ALL SELECT name, 'btree', CASE WHEN n = d THEN 'native' ELSE 'composite' END, 0 FROM s
UNION ALL SELECT name, 'rmi', 'native', m FROM s, (SELECT unnest([64, 1024, 16384, 262144]) AS m) WHERE n = d AND type <> 'string' AND m <= n"""
)
def candidates_rule(spark, sf):
    rows = []
    for table, key, c, kind in (("part", "p_partkey", "p_size", "int64"), ("orders", "o_orderkey", "o_totalprice", "double"), ("part", "p_partkey", "p_partkey", "int64"), ("orders", "o_orderkey", "o_orderstatus", "string")):
        shape = catalog.measure_shape(_t(spark, sf, table).select(F.col(key).alias("__k"), F.col(c).alias("__v")), "__v", "__k")
        rows += [(c, p.kind.value, p.encoding.value, p.rmi_models if p.kind == X.IndexKind.RMI else 0) for p in catalog.candidates_for(kind, shape)]
    return spark.createDataFrame(rows, "name string, kind string, encoding string, models long")


@query("SELECT p_size AS value, count(*) AS n FROM part GROUP BY p_size")
def bitmap_counts_by_value(spark, sf):
    return bitmaps.build(_part(spark, sf), "p_size", "p_partkey").groupBy(F.col("value").cast("int").alias("value")).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def _two(spark, sf):
    rows = _part(spark, sf)
    return bitmaps.prefix(bitmaps.build(rows, "p_brand", "p_partkey"), "Brand#1"), bitmaps.between(bitmaps.build(rows, "p_size", "p_partkey"), 5, 30)


@query("SELECT count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_size BETWEEN 5 AND 30")
def bitmap_and_count(spark, sf):
    return bitmaps.count(bitmaps.intersection(*_two(spark, sf)))


@query("SELECT count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') OR p_size BETWEEN 5 AND 30")
def bitmap_or_range_count(spark, sf):
    return bitmaps.count(bitmaps.union(*_two(spark, sf)))


@query('SELECT p_partkey AS "key" FROM part WHERE starts_with(p_brand, \'Brand#1\') AND p_size BETWEEN 5 AND 30')
def bitmap_and_keys(spark, sf):
    return bitmaps.keys(bitmaps.intersection(*_two(spark, sf)))


@query('SELECT p_partkey AS "key" FROM part WHERE NOT p_size > 10')
def bitmap_complement_keys(spark, sf):
    b = bitmaps.build(_part(spark, sf), "p_size", "p_partkey")
    return bitmaps.keys(bitmaps.complement(b, bitmaps.compare(b, ">", 10)))


# vectors

_DOT = "list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), lambda z: z[1] * z[2]))"
_NORM = "sqrt(list_sum(list_transform(CAST({0} AS DOUBLE[]), lambda z: z * z)))"
_D2 = "list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_Q42 = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 42)"


def _embeddings(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _seed(spark, sf, row=42):
    return _embeddings(spark, sf).filter(F.col("id") == row).first()["vector"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, round(sqrt({_D2}), 6) AS score FROM embeddings, {_Q42} ORDER BY {_D2}, vec_id LIMIT 10")
def knn_l2(spark, sf):
    return _rounded(V.search(_embeddings(spark, sf), _seed(spark, sf), 10))


@query(f"SELECT vec_id AS id, round({_DOT}, 6) AS score FROM embeddings, {_Q42} ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def knn_ip(spark, sf):
    return _rounded(V.search(_embeddings(spark, sf), _seed(spark, sf), 10, Metric.INNER_PRODUCT))


_COS = f"{_DOT} / ({_NORM.format('embedding')} * {_NORM.format('q')})"


@query(f"SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings, {_Q42} ORDER BY {_COS} DESC, vec_id LIMIT 10")
def knn_cosine(spark, sf):
    return _rounded(V.search(_embeddings(spark, sf), _seed(spark, sf), 10, Metric.COSINE))


@query(f"SELECT vec_id AS id, round(sqrt({_D2}), 6) AS score FROM embeddings, {_Q42} WHERE vec_id <> 42 ORDER BY {_D2}, vec_id LIMIT 5")
def knn_by_key(spark, sf):
    return _rounded(V.search_masked(_embeddings(spark, sf), _seed(spark, sf), 5, F.col("id") != 42))


@query(f"SELECT vec_id AS id, round(sqrt({_D2}), 6) AS score FROM embeddings, {_Q42} WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size < 20) ORDER BY {_D2}, vec_id LIMIT 10")
def knn_filtered(spark, sf):
    allowed = _t(spark, sf, "part").filter("p_size < 20").select("p_partkey")
    return _rounded(V.search_filtered(_embeddings(spark, sf), _seed(spark, sf), 10, allowed, strict=False))


@query(f"SELECT vec_id AS id, round(sqrt({_D2}), 6) AS score FROM embeddings, {_Q42}")
def knn_k_gt_n(spark, sf):
    return _rounded(V.search(_embeddings(spark, sf), _seed(spark, sf), 1_000_000))


_BATCH = f"""SELECT qid, id, round(sqrt(d2), 6) AS score, rank FROM (
  SELECT qid, id, d2, CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS INTEGER) AS rank FROM (
    SELECT qid, vec_id AS id, {_D2} AS d2 FROM embeddings, (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 10 = 0))) WHERE rank <= 5"""


@query(_BATCH)
def knn_batch(spark, sf):
    e = _embeddings(spark, sf)
    return V.search_batch(e, e.filter("id % 10 = 0"), 5).withColumn("score", F.round("score", 6))


def _hybrid(spark, sf):
    parts = _part(spark, sf).filter(all_of([("p_size", "<", 20), ("p_retailprice", ">", 905.0)], PART)).select("p_partkey")
    return _embeddings(spark, sf), parts


_MATCH = "vec_id IN (SELECT p_partkey FROM part WHERE p_size < 20 AND p_retailprice > 905.0)"


@query(f"SELECT vec_id AS id, round(sqrt({_D2}), 6) AS score FROM embeddings, {_Q42} WHERE {_MATCH} ORDER BY {_D2}, vec_id LIMIT 10")
def hybrid_prefilter(spark, sf):
    e, parts = _hybrid(spark, sf)
    return _rounded(planner.execute(PlanKind.PRE_FILTER, e, _seed(spark, sf), 10, 0, Metric.L2, parts, None))


@query(f"SELECT id, score FROM (SELECT vec_id AS id, vec_id, {_D2} AS d2, round(sqrt({_D2}), 6) AS score FROM embeddings, {_Q42} ORDER BY d2, vec_id LIMIT 100) WHERE {_MATCH} ORDER BY d2, id LIMIT 10")
def hybrid_postfilter(spark, sf):
    e, parts = _hybrid(spark, sf)
    return _rounded(planner.execute(PlanKind.POST_FILTER, e, _seed(spark, sf), 10, 0, Metric.L2, parts, None))


@query(
    f"SELECT vec_id AS id, round(sqrt({_D2}), 6) AS score FROM embeddings, {_Q42} WHERE {_MATCH} ORDER BY {_D2}, vec_id LIMIT 10",
)
def hybrid_filtered_graph_full_effort(spark, sf):
    e, parts = _hybrid(spark, sf)
    graph = ann.CellIndex(spark, e.select("id", "vector"), 64)
    return _rounded(planner.execute(PlanKind.FILTERED_GRAPH, e, _seed(spark, sf), 10, ann.FULL_EFFORT, Metric.L2, parts, graph))


@query("SELECT count(*) AS matched, count(*) - count(vec_id) AS without_vector FROM (SELECT p_partkey FROM part WHERE p_size < 20) LEFT JOIN embeddings ON vec_id = p_partkey")
def hybrid_without_vector_count(spark, sf):
    parts = _t(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").alias("id"))
    j = parts.join(_embeddings(spark, sf).select("id", F.lit(1).alias("has")), "id", "left")
    return j.agg(F.count("*").alias("matched"), (F.count("*") - F.count("has")).alias("without_vector"))


@query(
    """WITH c AS (SELECT count(*) AS corpus FROM embeddings), m AS (SELECT t.size AS size, count(vec_id) AS matched FROM (SELECT unnest([0, 2, 10, 26, 51]) AS size) t LEFT JOIN part ON p_size < t.size LEFT JOIN embeddings ON vec_id = p_partkey GROUP BY 1)
SELECT size, matched, corpus, matched / corpus AS selectivity, CASE WHEN matched <= 10 OR matched / corpus <= 0.5 THEN 'pre_filter' ELSE 'filtered_graph' END AS plan FROM m, c"""
)
def hybrid_explain(spark, sf):
    e, parts = _embeddings(spark, sf), _t(spark, sf, "part")
    sizes = [0, 2, 10, 26, 51]
    found = e.join(parts, F.col("id") == F.col("p_partkey")).agg(F.lit(1), *(F.coalesce(F.sum((F.col("p_size") < s).cast("long")), F.lit(0)) for s in sizes)).first()[1:]
    n = e.count()
    plans = [planner.decide(m, n, 10, 0.5, True) for m in found]
    return spark.createDataFrame([(s, p.matched_rows, p.corpus_rows, p.selectivity, p.kind.value) for s, p in zip(sizes, plans, strict=True)], "size int, matched long, corpus long, selectivity double, plan string")


@query(
    f"""WITH d AS (SELECT qid, vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY {_D2}, vec_id) AS r, {_MATCH} AS m,
    row_number() OVER (PARTITION BY qid, {_MATCH} ORDER BY {_D2}, vec_id) AS rm
  FROM embeddings, (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 10 = 0))
SELECT round(sum(CASE WHEN r <= 50 AND m AND rm <= 5 THEN 1 ELSE 0 END) / (count(DISTINCT qid) * 5), 6) AS recall FROM d"""
)
def recall_postfilter_vs_truth(spark, sf):
    e, parts = _hybrid(spark, sf)
    queries = e.filter("id % 10 = 0")
    truth = V.search_batch(e.join(parts, e["id"] == parts["p_partkey"], "left_semi"), queries, 5)
    near = V.search_batch(e, queries, 50)
    found = near.join(parts, near["id"] == parts["p_partkey"], "left_semi")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return spark.createDataFrame([(round(V.recall_at_k(best, truth, 5), 6),)], "recall double")


_SIZES = (2, 6, 11, 26, 51)


@query(
    " UNION ALL ".join(
        f"""SELECT {s} AS size, CAST(sum(greatest(5 - c, 0)) AS BIGINT) AS missing FROM (SELECT qid, count(*) FILTER (r <= 50 AND vec_id IN (SELECT p_partkey FROM part WHERE p_size < {s})) AS c
  FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY {_D2}, vec_id) AS r FROM embeddings, (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 25 = 0)) GROUP BY qid)"""
        for s in _SIZES
    )
)
def hybrid_postfilter_shortfall(spark, sf):
    """Rows that a post-filter of ten times five nearest falls short of five, by the size the parts are filtered on."""
    e = _embeddings(spark, sf)
    queries = e.filter("id % 25 = 0")
    near = V.search_batch(e, queries, 50).join(_part(spark, sf).select(F.col("p_partkey").alias("id"), "p_size"), "id", "left")
    counts = near.groupBy("qid").agg(*(F.sum(F.coalesce((F.col("p_size") < s).cast("long"), F.lit(0))).alias(f"c{s}") for s in _SIZES))
    total = counts.agg(*(F.sum(F.greatest(5 - F.col(f"c{s}"), F.lit(0))).alias(f"c{s}") for s in _SIZES))
    return total.select(F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.col(f"c{s}").alias("missing")) for s in _SIZES))).alias("x")).select("x.*")


# learned positions

_KEYS = "(SELECT CAST(k AS DOUBLE) AS x, k, CAST(row_number() OVER (ORDER BY k) - 1 AS DOUBLE) AS p FROM (SELECT DISTINCT o_totalprice AS k FROM orders))"


def _price_keys(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_totalprice").alias("key")).distinct()


@query(f"SELECT count(*) AS n, round(regr_slope(p, x), 6) AS slope, round(regr_intercept(p, x), 3) AS intercept FROM {_KEYS}")
def rmi_stage1_fit(spark, sf):
    s, i = learned.line(F.col("key"), F.col("pos").cast("double"))
    return learned.positions(_price_keys(spark, sf)).agg(F.count("*").alias("n"), F.round(s, 6).alias("slope"), F.round(i, 3).alias("intercept"))


@query(
    f"""WITH k AS (SELECT * FROM {_KEYS}), s1 AS (SELECT regr_slope(p, x) AS a, regr_intercept(p, x) AS b, count(*) AS n FROM k),
r AS (SELECT x, p, n, CAST(greatest(0, least(63, floor((a * x + b) * (64.0 / n)))) AS INTEGER) AS model FROM k, s1),
s2 AS (SELECT model, CASE WHEN var_pop(x) = 0 THEN 0 ELSE regr_slope(p, x) END AS a, CASE WHEN var_pop(x) = 0 THEN avg(p) ELSE regr_intercept(p, x) END AS b, count(*) AS c FROM r GROUP BY model),
e AS (SELECT r.model, c, greatest(0, least(n - 1, floor(a * x + b))) - p AS err FROM r JOIN s2 USING (model))
SELECT model, c AS n, CAST(max(greatest(err, 0)) AS BIGINT) AS back, CAST(max(greatest(-err, 0)) AS BIGINT) AS fwd FROM e GROUP BY model, c"""
)
def rmi_segment_errors(spark, sf):
    rmi = learned.fit(_price_keys(spark, sf), 64)
    return rmi.keys.groupBy("model").agg(F.count("*").alias("n")).join(rmi.models.select("model", "back", "fwd"), "model")


@query("SELECT k AS \"key\", row_number() OVER (ORDER BY k) - 1 AS pos FROM (SELECT DISTINCT o_totalprice AS k FROM orders)")
def rmi_find_positions(spark, sf):
    """Every key by its model's window: one that lay outside would be missing."""
    keys = _price_keys(spark, sf)
    return learned.fit(keys, 64).find(keys)


@query("SELECT CAST(0 AS BIGINT) AS outside, 0 AS found_of_other_keys")
def rmi_windows_hold(spark, sf):
    keys = _price_keys(spark, sf)
    rmi = learned.fit(keys, 64)
    other = keys.select((F.col("key") + 0.001).alias("key")).join(keys, "key", "left_anti")
    return rmi.validate().agg(F.count("*").alias("outside")).withColumn("found_of_other_keys", F.lit(rmi.find(other).count()))


@query(f"SELECT round(avg(abs(p - (a * x + b))), 3) AS mean_error, round(max(abs(p - (a * x + b))), 3) AS max_error, round(any_value(l), 6) AS linearity FROM {_KEYS}, (SELECT regr_slope(p, x) AS a, regr_intercept(p, x) AS b, pow(corr(x, p), 2) AS l FROM {_KEYS})")
def position_error(spark, sf):
    e = learned.position_error(learned.positions(_price_keys(spark, sf)))
    return e.select(F.round("mean_error", 3).alias("mean_error"), F.round("max_error", 3).alias("max_error"), F.round("linearity", 6).alias("linearity"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_totalprice < 100000) AS lower_bound, (SELECT count(*) FROM orders WHERE o_totalprice <= 100000) AS upper_bound")
def lower_upper_bound_rank(spark, sf):
    o = _t(spark, sf, "orders")
    lower, upper = (f(o, 100000, "o_totalprice").first()[0] for f in (learned.lower_bound, learned.upper_bound))
    return spark.createDataFrame([(lower, upper)], "lower_bound long, upper_bound long")


@query("SELECT p_partkey AS \"row\", p_size AS value, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS rank FROM part")
def encode_ranks(spark, sf):
    c = learned.ScalarColumn(_t(spark, sf, "part"), "p_size", "p_partkey")
    return c.frame.select("row", "value", "rank")


@query("SELECT s, (SELECT o_totalprice FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS r, count(*) OVER () AS n FROM orders) WHERE r = CAST(round_even(s * n, 0) AS BIGINT)) AS threshold FROM (SELECT unnest([CAST(0.0 AS DOUBLE), 0.1, 0.5]) AS s)")
def threshold_for_selectivity(spark, sf):
    o = _t(spark, sf, "orders")
    return spark.createDataFrame([(s, learned.threshold_for_selectivity(o, "o_totalprice", s)) for s in (0.0, 0.1, 0.5)], "s double, threshold double")


# changes


def _log(spark, sf):
    """events as a change log of users: an entry an event, every seventh a delete."""
    e = _t(spark, sf, "events")
    return e.select(F.col("event_id").alias("lsn"), F.when(F.col("event_id") % 7 == 0, "delete").otherwise("put").alias("op"), F.col("user_id").alias("key"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("n"), F.col("event_id").cast("string")).alias("payload"))


@query("SELECT user_id AS \"key\", event_type AS type, CAST(event_id AS VARCHAR) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 7 <> 0")
def wal_fold(spark, sf):
    return fold(_log(spark, sf)).select("key", F.col("payload")["type"].alias("type"), F.col("payload")["n"].alias("n"))


@query(
    """WITH base AS (SELECT user_id AS k, max(event_id) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1), delta AS (SELECT user_id AS k, max(event_id) AS v FROM events WHERE event_id % 3 = 1 AND event_id % 5 = 0 GROUP BY 1),
dead AS (SELECT DISTINCT user_id AS k FROM events WHERE event_id % 3 = 2 AND event_id % 11 = 0)
SELECT coalesce(d.k, b.k) AS "key", coalesce(d.v, b.v) AS value FROM (SELECT * FROM base WHERE k NOT IN (SELECT k FROM dead)) b FULL JOIN delta d ON b.k = d.k"""
)
def delta_merge_latest_wins(spark, sf):
    e = _t(spark, sf, "events")
    part = lambda c: e.filter(c).groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("value"))
    dead = e.filter("event_id % 3 = 2 and event_id % 11 = 0").select(F.col("user_id").alias("key")).distinct()
    return learned.merge_on_read(part("event_id % 3 = 0"), part("event_id % 3 = 1 and event_id % 5 = 0"), dead)


# cells

_CENTRES = "(SELECT label AS cell, list(c ORDER BY i) AS q FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS c FROM embeddings, unnest(generate_series(1, 64)) AS s(i) GROUP BY 1, 2) GROUP BY 1)"


def _label_centres(spark, sf):
    import numpy as np

    e = _embeddings(spark, sf)
    rows = e.groupBy("label").agg(*(F.avg(F.col("vector")[i].cast("double")) for i in range(64))).orderBy("label").collect()  # a row a label
    return np.array([r[1:] for r in rows])


@query(f"SELECT id, cell FROM (SELECT vec_id AS id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY {_D2}, cell) AS r FROM embeddings, {_CENTRES}) WHERE r = 1")
def centroid_assign(spark, sf):
    return ann.assign(_embeddings(spark, sf), _label_centres(spark, sf)).select("id", "cell")


@query(f"SELECT cell, id AS medoid, round(sqrt(d2), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY d2, id) AS r FROM (SELECT vec_id AS id, label AS cell, {_D2} AS d2 FROM embeddings JOIN {_CENTRES} ON cell = label)) WHERE r = 1")
def medoid_per_cluster(spark, sf):
    e = _embeddings(spark, sf).withColumnRenamed("label", "cell")
    return ann.medoids(e, _label_centres(spark, sf)).withColumn("distance", F.round("distance", 6))


@query(f"SELECT round(avg(d), 6) AS entry_distance FROM (SELECT vec_id, sqrt(min({_D2})) AS d FROM embeddings, {_CENTRES} GROUP BY vec_id)")
def entry_distance_baseline(spark, sf):
    centres = _label_centres(spark, sf)
    e = ann.assign(_embeddings(spark, sf), centres)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, c array<double>")
    d = e.join(table, "cell").select(F.sqrt(V.rank_score("vector", F.col("c"), Metric.L2)).alias("d"))
    return d.agg(F.round(F.avg("d"), 6).alias("entry_distance"))


@query()
def ann_recall(spark, sf):
    """Recall of the cells at growing effort; no SQL, the cells are fitted."""
    e = _embeddings(spark, sf).select("id", "vector")
    queries = e.filter("id % 20 = 0")
    truth, index = V.search_batch(e, queries, 10), ann.CellIndex(spark, e, 64)
    rows = [(ef, V.recall_at_k(index.search_batch(queries, 10, ef), truth, 10)) for ef in (10, 50, 200, ann.EF_SEARCH, ann.FULL_EFFORT)]
    return spark.createDataFrame(rows, "ef int, recall double")


# texts as values

_TEXTS = "(SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '-' || p_size WHEN 2 THEN p_size || ' ' WHEN 3 THEN p_name WHEN 4 THEN '' WHEN 5 THEN '99999999999999999999' WHEN 6 THEN '1.5' ELSE NULL END AS t FROM part)"


def _texts(spark, sf):
    p = _t(spark, sf, "part")
    size = F.col("p_size").cast("string")
    m = F.col("p_partkey") % 8
    t = F.when(m == 0, size).when(m == 1, F.concat(F.lit("-"), size)).when(m == 2, F.concat(size, F.lit(" "))).when(m == 3, F.col("p_name")).when(m == 4, "").when(m == 5, "9" * 20).when(m == 6, "1.5")
    return p.select(F.col("p_partkey").alias("id"), t.alias("t"))


@query(f"SELECT id, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN try_cast(t AS BIGINT) END AS value FROM {_TEXTS}")
def parse_int64_strict(spark, sf):
    return _texts(spark, sf).select("id", X.parsed(F.col("t"), L.INT64).alias("value"))


_BOOLS = "['true', 'FALSE', '1', '0', 'yes', 't', '', ' true']"


@query(f"SELECT p_partkey AS id, CASE WHEN lower(t) IN ('true', '1') THEN true WHEN lower(t) IN ('false', '0') THEN false END AS value FROM (SELECT p_partkey, ({_BOOLS})[p_partkey % 8 + 1] AS t FROM part)")
def parse_bool_strict(spark, sf):
    words = F.array(*(F.lit(x) for x in ("true", "FALSE", "1", "0", "yes", "t", "", " true")))
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.parsed(F.get(words, (F.col("p_partkey") % 8).cast("int")), L.BOOL).alias("value"))


@query("SELECT event_id AS id, CAST(CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_ms(date_trunc('day', ts)) ELSE NULL END AS BIGINT) AS ms FROM events")
def parse_timestamp_iso(spark, sf):
    e, m = _t(spark, sf, "events"), F.col("event_id") % 3
    text = F.when(m == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(m == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    return e.select(F.col("event_id").alias("id"), F.unix_millis(X.parsed(text, L.TIMESTAMP)).alias("ms"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS text FROM orders")
def format_timestamp_iso(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.formatted(F.date_trunc("second", "o_orderdate"), L.TIMESTAMP).alias("text"))


@query(f"SELECT vec_id AS key, round(sqrt({_D2}), 6) AS score FROM embeddings, {_Q42} WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size < 20) ORDER BY {_D2}, vec_id LIMIT 10")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The k nearest embeddings to that of row 42 among the parts of size under 20."""
    allowed = _t(spark, sf, "part").filter(P("p_size", PredOp.LT, 20).compile(PART)).select("p_partkey")
    found = V.search_filtered(_embeddings(spark, sf).drop("label"), _seed(spark, sf), 10, allowed, strict=False)
    return found.select(F.col("id").alias("key"), F.round("score", 6).alias("score"))


def queries() -> dict[str, Query]:
    from tessera import table_queries  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tessera import table_queries  # noqa: F401

    return dict(_SQL)
