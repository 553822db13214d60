"""Queries through tables, stores, indexes, planners and files, each with SQL that says the same."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.schema import ColumnDef, Record, Schema
from tessera.functions.types import IndexKind, LogicalType, Metric, PlanKind, VectorStructure, formatted
from tessera.operators import ann, learned
from tessera.operators import vectors as V
from tessera.operators.table import Table, VectorPlan
from tessera.plans import catalog
from tessera.plans.planner import HybridPlanner
from tessera.registry import _D2, _Q42, _embeddings, _label_centres, _log, _part, _seed, _t, query
from tessera.sources import files, shared
from tessera.sources.store import RecordStore
from tessera.streaming.changelog import FollowedTable

L = LogicalType
PARTS = Schema([ColumnDef("name", L.STRING), ColumnDef("brand", L.STRING), ColumnDef("size", L.INT64), ColumnDef("price", L.DOUBLE), ColumnDef("large", L.BOOL), ColumnDef("image", L.VECTOR, 64)])
_PARTS = "(SELECT p_partkey AS \"key\", CASE WHEN p_partkey % 9 <> 4 THEN p_name END AS name, p_brand AS brand, CAST(p_size AS BIGINT) AS size, p_retailprice AS price, p_size > 25 AS large FROM part)"
_TABLES: dict[tuple[str, str], Table] = {}


def _payload(spark: SparkSession, sf: str) -> DataFrame:
    """part as records: texts by column, every ninth without a name."""
    p = _part(spark, sf)
    texts = {"name": F.when(F.col("p_partkey") % 9 != 4, F.col("p_name")), "brand": F.col("p_brand"), "size": F.col("p_size").cast("string"), "price": formatted(F.col("p_retailprice"), L.DOUBLE), "large": (F.col("p_size") > 25).cast("string")}
    whole = F.create_map(*(x for name, text in texts.items() for x in (F.lit(name), text)))
    return p.select(F.col("p_partkey").alias("key"), F.map_filter(whole, lambda _, v: v.isNotNull()).alias("payload"))


def _new_table(spark: SparkSession, sf: str) -> Table:
    t = Table(RecordStore(spark, shared.shared_folder(spark, "table")), PARTS)
    t.put_frame(_payload(spark, sf))
    return t


def _table(spark: SparkSession, sf: str) -> Table:
    """The table of parts, with vectors, a checkpoint and a layout of each kind; made once a session."""
    known = (spark.sparkContext.applicationId, sf)
    if known not in _TABLES:
        t = _new_table(spark, sf)
        e = _embeddings(spark, sf).join(_t(spark, sf, "part").select(F.col("p_partkey").alias("id")), "id", "left_semi")
        t.put_vector_frame("image", e, "id", "vector")
        t.checkpoint()
        t.create_index_as("size", IndexKind.BITMAP)
        t.create_index_as("large", IndexKind.BITMAP)
        t.create_index_as("brand", IndexKind.BTREE)
        t.create_index_as("price", IndexKind.RMI if _unique_prices(spark, sf) else IndexKind.BTREE)
        t.create_vector_index("image", VectorPlan(VectorStructure.GRAPH, Metric.L2))
        _TABLES[known] = t
    return _TABLES[known]


def _unique_prices(spark: SparkSession, sf: str) -> bool:
    return _t(spark, sf, "part").groupBy("p_retailprice").count().filter("count > 1").limit(1).count() == 0


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# records


@query(f"SELECT \"key\", name, brand, size, price, large FROM {_PARTS}")
def table_put_frame(spark, sf):
    """Written as a frame of changes, read back by a store that was opened again."""
    t = _new_table(spark, sf)
    again = Table(RecordStore(spark, t.store.path), PARTS)
    return again.frame().withColumnRenamed("_key", "key")


@query(
    f"""SELECT "key", name, brand, CASE WHEN "key" = 7 THEN 1000 WHEN "key" % 10 = 0 THEN 99 ELSE size END AS size,
  CASE WHEN "key" % 10 <> 0 THEN price END AS price, CASE WHEN "key" % 10 <> 0 THEN large END AS large
FROM (SELECT "key", CASE WHEN "key" % 10 <> 0 THEN name END AS name, CASE WHEN "key" % 10 <> 0 THEN brand END AS brand, size, price, large FROM {_PARTS}) WHERE "key" NOT IN (5, 6)
UNION ALL SELECT -3, 'new', NULL, NULL, NULL, NULL"""
)
def table_writes_and_checkpoints(spark, sf):
    """Frame, checkpoint, replaced records, an update, erased records, a new one; checkpoint and reopening in between."""
    t = _new_table(spark, sf)
    t.save()
    t.store.checkpoint()
    every_tenth = _payload(spark, sf).filter("key % 10 = 0").select("key", F.create_map(F.lit("size"), F.lit("99")).alias("payload"))
    t.put_frame(every_tenth)
    t.update(7, {"size": "1000"})
    t = Table.open(RecordStore(spark, t.store.path))
    t.erase(5)
    t.checkpoint()
    t.erase(6)
    t.put(Record(-3, {"name": "new"}))
    return Table.open(RecordStore(spark, t.store.path)).frame().withColumnRenamed("_key", "key")


@query(
    """SELECT user_id AS "key", event_type AS type, CAST(event_id AS VARCHAR) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 7 <> 0"""
)
def store_replays_a_log(spark, sf):
    """The change log of users through a store: frames in the order of their lsn, a checkpoint between them."""
    s = RecordStore(spark, shared.shared_folder(spark, "store"))
    log = _log(spark, sf)
    half = log.agg(F.max("lsn")).first()[0] // 2
    for part in (log.filter(F.col("lsn") <= half), log.filter(F.col("lsn") > half)):
        s.append_frame(part.orderBy("lsn").select("op", "key", "payload"))
        s.checkpoint()
    return RecordStore(spark, s.path).frame().select("key", F.col("payload")["type"].alias("type"), F.col("payload")["n"].alias("n"))


@query(
    """SELECT user_id AS "key", event_type AS type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 7 <> 0"""
)
def stream_follows_a_log(spark, sf):
    """The same log followed by a stream of two batches."""
    log, folder = _log(spark, sf), shared.shared_folder(spark, "log")
    half = log.agg(F.max("lsn")).first()[0] // 2
    f, at = FollowedTable(spark, shared.shared_folder(spark, "followed")), shared.shared_folder(spark, "offsets")
    for part in (log.filter(F.col("lsn") <= half), log.filter(F.col("lsn") > half)):
        part.write.mode("append").json(folder)
        f.follow(folder, at).awaitTermination()
    return f.frame().select("key", F.col("payload")["type"].alias("type"))


@query(f"SELECT \"key\", name, size FROM {_PARTS} WHERE \"key\" IN (0, 17, 199)")
def table_get(spark, sf):
    t = _table(spark, sf)
    rows = [t.get(k) for k in (0, 17, 199, -5)]
    return spark.createDataFrame([(r.key, r.columns.get("name"), int(r.get("size"))) for r in rows if r], "key long, name string, size long")


@query(f"SELECT \"key\", name FROM {_PARTS} ORDER BY \"key\" LIMIT 25 OFFSET 40")
def table_scan(spark, sf):
    return _table(spark, sf).scan(25, 40).select(F.col("_key").alias("key"), "name")


_CONDITIONS = {
    "bitmap_eq": (("size", "=", 7), "size = 7"),
    "bitmap_range": (("size", "between", 10, 12), "size BETWEEN 10 AND 12"),
    "bitmap_bool": (("large", "=", True), "large"),
    "btree_eq": (("brand", "=", "Brand#12"), "brand = 'Brand#12'"),
    "btree_prefix": (("brand", "prefix", "Brand#2"), "starts_with(brand, 'Brand#2')"),
    "learned_eq": (("price", "=", 905.5), "price = 905.5"),
    "learned_range": (("price", ">=", 912.25), "price >= 912.25"),
    "scan_contains": (("name", "contains", "d b"), "contains(name, 'd b')"),
    "scan_prefix": (("name", "prefix", "re"), "starts_with(name, 're')"),
    "scan_null": (("name", "is null"), "name IS NULL"),
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS which, \"key\" FROM {_PARTS} WHERE {where}" for n, (_, where) in _CONDITIONS.items()))
def table_select_keys(spark, sf):
    """Each operator through its layout, or the scan where there is none."""
    t = _table(spark, sf)
    return _union([t.select_keys(*p)[0].select(F.lit(n).alias("which"), F.col("_key").alias("key")) for n, (p, _) in _CONDITIONS.items()])


@query(" UNION ALL ".join(f"SELECT '{n}' AS which, \"key\", name, size, price FROM {_PARTS} WHERE {where}" for n, (_, where) in _CONDITIONS.items()))
def table_select_records(spark, sf):
    t = _table(spark, sf)
    return _union([t.select(*p)[0].select(F.lit(n).alias("which"), F.col("_key").alias("key"), "name", "size", "price") for n, (p, _) in _CONDITIONS.items()])


@query(" UNION ALL ".join(f"SELECT '{n}' AS which, count(*) AS n, {str(not n.startswith('scan')).lower()} AS used_layout FROM {_PARTS} WHERE {where}" for n, (_, where) in _CONDITIONS.items()))
def table_counts(spark, sf):
    t = _table(spark, sf)
    return spark.createDataFrame([(n, t.count(*p), t.select_keys(*p)[1].used_index) for n, (p, _) in _CONDITIONS.items()], "which string, n long, used_layout boolean")


_LISTS = {
    "bitmaps": ([("size", ">=", 20), ("large", "=", False)], "size >= 20 AND NOT large"),
    "selective": ([("price", "=", 905.5), ("brand", "prefix", "B")], "price = 905.5 AND starts_with(brand, 'B')"),
    "scan": ([("price", ">", 905.0), ("name", "contains", "e")], "price > 905.0 AND contains(name, 'e')"),
    "one": ([("size", "<", 5)], "size < 5"),
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS which, \"key\" FROM {_PARTS} WHERE {where}" for n, (_, where) in _LISTS.items()))
def table_select_all(spark, sf):
    t = _table(spark, sf)
    return _union([t.select_all(ps)[0].select(F.lit(n).alias("which"), F.col("_key").alias("key")) for n, (ps, _) in _LISTS.items()])


@query(f"SELECT \"key\" FROM {_PARTS} WHERE size = 3 OR brand = 'Brand#21' OR contains(name, 'bolt')")
def table_select_any(spark, sf):
    return _table(spark, sf).select_any([("size", "=", 3), ("brand", "=", "Brand#21"), ("name", "contains", "bolt")])[0].withColumnRenamed("_key", "key")


@query(f"SELECT \"key\" FROM {_PARTS} WHERE size = 7 AND \"key\" NOT IN (SELECT \"key\" FROM {_PARTS} WHERE \"key\" % 10 = 0) UNION ALL SELECT \"key\" FROM {_PARTS} WHERE \"key\" % 10 = 0 AND \"key\" % 20 = 0")
def table_layout_with_later_writes(spark, sf):
    """A bitmap answers, with writes from the log laid over it."""
    t = _new_table(spark, sf)
    t.create_index_as("size", IndexKind.BITMAP)
    t.put_frame(_payload(spark, sf).filter("key % 10 = 0").select("key", F.create_map(F.lit("size"), F.when(F.col("key") % 20 == 0, "7").otherwise("8")).alias("payload")))
    return t.select_keys("size", "=", 7)[0].withColumnRenamed("_key", "key")


_INFO = "SELECT '{c}' AS name, count({c}) AS \"rows\", count(*) - count({c}) AS skipped, count(DISTINCT {c}) AS \"distinct\", count({c}) = count(DISTINCT {c}) AS is_unique FROM " + _PARTS


@query(" UNION ALL ".join(_INFO.format(c=c) for c in ("name", "brand", "size", "price", "large")))
def table_describe(spark, sf):
    rows = [(i.name, i.rows, i.skipped, i.distinct, i.unique) for i in _table(spark, sf).describe()]
    return spark.createDataFrame(rows, "name string, rows long, skipped long, distinct long, is_unique boolean")


@query(
    f"""WITH s AS ({" UNION ALL ".join(_INFO.format(c=c) for c in ("size", "brand"))})
SELECT name, CASE name WHEN 'size' THEN 'bitmap' ELSE 'btree' END AS kind, CASE name WHEN 'size' THEN 'dictionary' ELSE 'composite' END AS encoding, "rows" AS n_keys, "distinct", step, CASE step WHEN 2 THEN 'stale' ELSE 'fresh' END AS freshness
FROM s, (SELECT unnest([1, 2]) AS step)"""
)
def catalog_kept_and_read(spark, sf):
    """Decisions written as JSON and read back: fresh, then stale as the greatest value moves."""
    t, c, out = _table(spark, sf), catalog.IndexCatalog(), []
    for name in ("size", "brand"):
        c.set(name, t.explain_column(name))
    path = shared.shared_folder(spark, "catalog")
    c.save(path)
    again = catalog.IndexCatalog.load(path)
    for name in again.columns():
        plan, shape = again.get(name), t._shape(name)
        for step, s in ((1, shape), (2, catalog.ColumnShape(shape.rows, shape.distinct, shape.unique, shape.monotone, shape.key_min, shape.key_max + 1))):
            out.append((name, plan.kind.value, plan.encoding.value, plan.n_keys, plan.distinct, step, again.freshness(name, s)))
    return spark.createDataFrame(out, "name string, kind string, encoding string, n_keys long, distinct long, step int, freshness string")


# vectors


def _near(df: DataFrame) -> DataFrame:
    return df.select("key", F.round("score", 6).alias("score"))


_VECTORS = "(SELECT * FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part))"


@query(f"SELECT vec_id AS \"key\", round(sqrt({_D2}), 6) AS score FROM {_VECTORS}, {_Q42} ORDER BY {_D2}, vec_id LIMIT 10")
def table_knn(spark, sf):
    return _near(_table(spark, sf).knn("image", _seed(spark, sf), 10, exact=True))


@query(f"SELECT vec_id AS \"key\", round(sqrt({_D2}), 6) AS score FROM {_VECTORS}, {_Q42} WHERE vec_id <> 42 ORDER BY {_D2}, vec_id LIMIT 10")
def table_knn_by_key(spark, sf):
    return _near(_table(spark, sf).knn_by_key("image", 42, 10, ef=ann.FULL_EFFORT))


_SMALL = [("size", "<", 20), ("price", ">", 905.0)]
_MANY = [("size", "<", 45)]
_IN = {"small": "p_size < 20 AND p_retailprice > 905.0", "many": "p_size < 45", "both": "p_size < 45 AND NOT p_size > 25"}


def _hybrid_sql(which: str, kind: str) -> str:
    inside = f"vec_id IN (SELECT p_partkey FROM part WHERE {_IN[which]})"
    if kind == "post_filter":
        return f"SELECT '{which}' AS which, '{kind}' AS plan, \"key\", score FROM (SELECT vec_id AS \"key\", vec_id, {_D2} AS d2, round(sqrt({_D2}), 6) AS score FROM {_VECTORS}, {_Q42} ORDER BY d2, vec_id LIMIT 100) WHERE {inside} QUALIFY row_number() OVER (ORDER BY d2, \"key\") <= 10"
    return f"SELECT '{which}' AS which, '{kind}' AS plan, vec_id AS \"key\", round(sqrt({_D2}), 6) AS score FROM {_VECTORS}, {_Q42} WHERE {inside} QUALIFY row_number() OVER (ORDER BY {_D2}, vec_id) <= 10"


_KINDS = [("small", _SMALL, k) for k in (PlanKind.PRE_FILTER, PlanKind.POST_FILTER, PlanKind.FILTERED_GRAPH)] + [("both", [("size", "<", 45), ("large", "=", False)], PlanKind.BITMAP_FILTERED_GRAPH)]


@query(" UNION ALL ".join(f"({_hybrid_sql(w, k.value)})" for w, _, k in _KINDS))
def table_hybrid_with(spark, sf):
    """Every plan, asked for; the graph at full effort."""
    t, q = _table(spark, sf), _seed(spark, sf)
    found = [t.hybrid_with(k, ps, "image", q, 10, ann.FULL_EFFORT)[0].select(F.lit(w).alias("which"), F.lit(k.value).alias("plan"), "key", F.round("score", 6).alias("score")) for w, ps, k in _KINDS]
    return _union(found)


@query(f"({_hybrid_sql('small', 'pre_filter')}) UNION ALL ({_hybrid_sql('many', 'bitmap_filtered_graph')})")
def table_hybrid(spark, sf):
    """The plan that the planner takes: exact below the threshold, the graph above one half."""
    t, q, out = _table(spark, sf), _seed(spark, sf), []
    for which, ps in (("small", _SMALL), ("many", _MANY)):
        found, trace = t.hybrid(ps, "image", q, 10, ann.FULL_EFFORT)
        out.append(found.select(F.lit(which).alias("which"), F.lit(trace.plan.kind.value).alias("plan"), "key", F.round("score", 6).alias("score")))
    return _union(out)


@query(
    " UNION ALL ".join(
        f"SELECT '{w}' AS which, count(*) AS matched, count(*) - count(vec_id) AS without_vector, {mask} AS mask_used FROM part LEFT JOIN embeddings ON vec_id = p_partkey WHERE {_IN[w]}"
        for w, mask in (("small", "false"), ("many", "true"), ("both", "true"))
    )
)
def table_explain_hybrid(spark, sf):
    t, out = _table(spark, sf), []
    for which, ps in (("small", _SMALL), ("many", _MANY), ("both", [("size", "<", 45), ("large", "=", False)])):
        trace = t.explain_hybrid(ps, "image")
        out.append((which, trace.structured.matched, trace.without_vector, trace.mask_used))
    return spark.createDataFrame(out, "which string, matched long, without_vector long, mask_used boolean")


@query(
    f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 4 = 0) AS again, count(*) FILTER (vec_id = 9) AS gone FROM {_VECTORS})
SELECT 1 AS step, n AS "rows", again + gone AS orphans FROM n UNION ALL SELECT 2, n - gone, 0 FROM n"""
)
def table_vectors_compacted(spark, sf):
    """Live rows (less one that was erased) and orphans, before and after compaction."""
    t = _new_table(spark, sf)
    e = _embeddings(spark, sf).join(_t(spark, sf, "part").select(F.col("p_partkey").alias("id")), "id", "left_semi")
    t.put_vector_frame("image", e, "id", "vector")
    t.put_vector_frame("image", e.filter("id % 4 = 0"), "id", "vector")
    t.erase_vector(9, "image")
    one = t.vector_info("image")
    t.compact_vectors("image")
    two = t.vector_info("image")
    return spark.createDataFrame([(1, one.rows + 1, one.orphans), (2, two.rows, two.orphans)], "step int, rows long, orphans long")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, embedding[1] AS first, embedding[64] AS last, vec_id FROM embeddings")
def flat_index_of_a_wide_frame(spark, sf):
    """Rows of a flat index by rank, each beside the vector it was made from."""
    e = _embeddings(spark, sf)
    f = V.FlatIndex(spark, 64)
    f.add_frame(e.repartition(7).withColumn("more", F.transform("vector", lambda x: x * 2)), "id")
    rank = e.select(F.col("id").alias("vec_id"), (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("id"))  # the ids alone
    return f.frame.join(rank, "id").select("id", F.col("vector")[0].alias("first"), F.col("vector")[63].alias("last"), "vec_id")


_BEST = f"""SELECT qid, id, round(sqrt(d2), 6) AS score, rank FROM (
  SELECT qid, id, d2, CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS INTEGER) AS rank FROM (
    SELECT qid, vec_id AS id, {_D2} AS d2 FROM embeddings, (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0))) WHERE rank <= 10"""


@query(_BEST)
def ann_batch_full_effort(spark, sf):
    """All cells probed: the approximate index is exact."""
    e = _embeddings(spark, sf).select("id", "vector")
    return ann.CellIndex(spark, e, 64).search_batch(e.filter("id % 20 = 0"), 10, ann.FULL_EFFORT).withColumn("score", F.round("score", 6))


@query("SELECT CAST(1 AS DOUBLE) AS health, 10 AS medoids, true AS same")
def router_of_label_centres(spark, sf):
    """A centroid router over the centres of the labels: its health when it is set, its medoids, and its JSON."""
    e = _embeddings(spark, sf).select("id", "vector")
    index = ann.CellIndex(spark, e, 64, centres=_label_centres(spark, sf))
    index.set_router(ann.CentroidRouter(index.centres), 1)
    q = _seed(spark, sf)
    back = ann.CentroidRouter.from_json(index.router.to_json())
    return spark.createDataFrame([(index.router_health(), len(index.repair_router_medoids().collect()), back.predict(q, 3) == index.router.predict(q, 3))], "health double, medoids int, same boolean")


@query("SELECT size, count(vec_id) AS matched, CASE WHEN count(vec_id) <= 10 OR count(vec_id) <= 0.5 * (SELECT count(*) FROM embeddings) THEN 'pre_filter' ELSE 'filtered_graph' END AS plan FROM (SELECT unnest([2, 10, 26, 51]) AS size) LEFT JOIN part ON p_size < size LEFT JOIN embeddings ON vec_id = p_partkey GROUP BY 1")
def planner_explain(spark, sf):
    e = _embeddings(spark, sf).select("id", "vector")
    p = HybridPlanner(e)
    sizes = _part(spark, sf).join(e, F.col("p_partkey") == F.col("id"), "left_semi")
    p.set_column("size", sizes.select("p_partkey", "p_size"), L.INT64)
    p.set_graph(ann.CellIndex(spark, e, 64, centres=_label_centres(spark, sf)))
    plans = [(s, p.explain(("size", "<", s))) for s in (2, 10, 26, 51)]
    return spark.createDataFrame([(s, x.matched_rows, x.kind.value) for s, x in plans], "size int, matched long, plan string")


@query(f"SELECT vec_id AS id, round(sqrt({_D2}), 6) AS score FROM embeddings, {_Q42} WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size < 20) ORDER BY {_D2}, vec_id LIMIT 10")
def planner_search(spark, sf):
    p = HybridPlanner(_embeddings(spark, sf).select("id", "vector"))
    p.set_column("size", _part(spark, sf).select("p_partkey", "p_size"), L.INT64)
    return p.search(("size", "<", 20), _seed(spark, sf), 10)[0].select("id", F.round("score", 6).alias("score"))


# learned positions


@query(
    """WITH base AS (SELECT DISTINCT p_partkey * 3 AS k FROM part), new AS (SELECT k, -k AS v FROM (SELECT p_partkey * 2 AS k FROM part) WHERE k NOT IN (SELECT k FROM base))
SELECT k AS "key", k AS value FROM base WHERE k % 5 <> 0 UNION ALL SELECT k, v FROM new WHERE k % 5 <> 0"""
)
def dynamic_index(spark, sf):
    """Inserts that meet live keys are refused, erased keys are gone, before and after a merge."""
    p = _t(spark, sf, "part")
    d = learned.DynamicIndex(p.select((F.col("p_partkey") * 3).alias("key"), (F.col("p_partkey") * 3).alias("value")))
    d.insert(p.select((F.col("p_partkey") * 2).alias("key"), (F.col("p_partkey") * -2).alias("value")))
    if d.merge_due():
        d.merge()
    d.erase(d.live().filter("key % 5 = 0").select("key"))
    return d.live()


# files


@query("SELECT vec_id AS id, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def fvecs_there_and_back(spark, sf):
    """Vectors written to an fvecs file and read; their ids are their places."""
    path = shared.shared_folder(spark, "a") + ".fvecs"
    files.write_fvecs(_embeddings(spark, sf).select("id", "vector"), path)
    return files.read_fvecs(spark, path).select("id", F.col("vector")[0].alias("first"), F.col("vector")[63].alias("last"))


@query("SELECT k AS \"key\", row_number() OVER (ORDER BY k) - 1 AS value FROM (SELECT DISTINCT o_custkey AS k FROM orders)")
def sosd_there_and_back(spark, sf):
    path = shared.shared_folder(spark, "keys_uint64")
    files.write_sosd([r[0] for r in _t(spark, sf, "orders").select("o_custkey").distinct().toLocalIterator()] * 2, path)
    return files.load_sosd(spark, path)[0]


@query("SELECT p_partkey AS \"key\", CAST(p_size AS BIGINT) AS value FROM part WHERE p_partkey % 3 <> 0")
def key_csv_there_and_back(spark, sf):
    """Rows whose key is no number are left out."""
    path = shared.shared_folder(spark, "csv")
    key = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), "p_partkey")).otherwise(F.col("p_partkey").cast("string"))
    _t(spark, sf, "part").select(key.alias("k"), "p_name", "p_size").write.csv(path, header=True)
    return files.read_key_csv(spark, path, "k", 2)[0]


@query("SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings WHERE embedding[1] IS NOT NULL")
def vector_json_kept(spark, sf):
    """A vector column of a table saved, opened again and read."""
    t = Table(RecordStore(spark, shared.shared_folder(spark, "table")), Schema([ColumnDef("image", L.VECTOR, 64)]))
    e = _embeddings(spark, sf)
    t.put_frame(e.select(F.col("id").alias("key"), F.create_map().cast("map<string,string>").alias("payload")))
    t.put_vector_frame("image", e, "id", "vector")
    t.checkpoint()
    again = Table.open(RecordStore(spark, t.store.path))
    assert json.loads(shared.read_text(f"{t.store.path}/vectors.json", spark))["vectors"][0]["dim"] == 64
    return again._vector("image").live().select(F.col("_key").alias("id"), F.col("embedding")[0].cast("double").alias("first"))
