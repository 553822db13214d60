import math

import duckdb
import pytest

from tessera import registry
from tessera.operators import ann, vectors

from .conftest import SF01

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    return c


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    found = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SF01)
    assert sorted(df.columns) == sorted(found.columns)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    at = [found.columns.index(c) for c in cols]
    want = sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=repr)
    assert len(got) == len(want) and [repr(g) for g in got] == [repr(w) for w in want], [(g, w) for g, w in zip(got, want) if g != w][:4]


def test_recall_grows_to_one(spark):
    r = [x["recall"] for x in registry.queries()["ann_recall"](spark, SF01).orderBy("ef").collect()]
    assert r == sorted(r) and r[-1] == 1.0 and r[1] > 0.5


def test_recall_at_default_effort(spark):
    e = registry._embeddings(spark, SF01.replace("0.01", "0.1")).select("id", "vector")
    queries = e.filter("id % 20 = 0")
    found = ann.CellIndex(spark, e, 64).search_batch(queries, 10)
    assert vectors.recall_at_k(found, vectors.search_batch(e, queries, 10), 10) >= 0.9


def test_default_effort_is_what_a_search_without_effort_probes(spark):
    e = registry._embeddings(spark, SF01).select("id", "vector")
    index = ann.CellIndex(spark, e, 64, cells=11)
    query = e.filter("id = 42").first()["vector"]
    assert index.search(query, 10).count() == 10 and index.last_probed == index.probes() == index.probes(ann.EF_SEARCH) == 7
    assert index.search(query, 10, 40).count() == 10 and index.last_probed == index.probes(40) == 2
    assert sorted(map(tuple, index.search_batch(e.limit(9), 3).collect())) == sorted(map(tuple, index.search_batch(e.limit(9), 3, ann.EF_SEARCH).collect()))


def test_wal_fold_matters(spark):
    assert registry.queries()["wal_fold"](spark, SF01).count() > 0
