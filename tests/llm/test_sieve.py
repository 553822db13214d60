import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import neardup, sieve

from ..conftest import SF


@pytest.mark.parametrize("bits", [(15, 27), (15, 15)])
def test_no_key_is_lost(spark, monkeypatch, bits):
    monkeypatch.setattr(sieve, "BITS", bits)
    rows = spark.range(20000).select("id", F.xxhash64("id").alias("h"))
    keys = rows.filter("id % 10 = 3").select("h")
    maybe, none = (sorted(r["id"] for r in df.collect()) for df in sieve.sieved(rows, F.col("h"), keys, 2000))
    assert sorted(maybe + none) == list(range(20000)) and set(range(3, 20000, 10)) <= set(maybe)
    assert len(maybe) < (2600 if bits[1] == 27 else 4000)
    for df, want in zip(sieve.sieved(rows, F.col("h"), keys.limit(0), 0), (0, 20000), strict=True):
        assert df.count() == want


def test_texts_that_nothing_is_like_are_not_shuffled(spark, monkeypatch):
    """A thousand different texts and four copies in pairs: only about four texts meet the members."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(1000)] + [(2000 + i, " ".join(f"w{i}x{j}" for j in range(30)) + " end") for i in range(2)]
    seen = []
    own = neardup.sieved
    monkeypatch.setattr(neardup, "sieved", lambda *a: seen.append([df.count() for df in own(*a)]) or own(*a))
    found = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in found.filter("doc_id <> class_id").collect()) == [2000, 2001]
    assert len(seen) == 1 and 4 <= seen[0][0] < 40 and sum(seen[0]) == len(rows)


def test_rows_that_stay_are_not_shuffled_however_many_go(spark, monkeypatch):
    """Without broadcasts of keys, as for tables too large for them: texts go through an exchange only if the sieve lets them."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    rows = [(i, text(i)) for i in range(300)] + [(1000 + i, text(i)) for i in range(20)] + [(5, text(5))] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (P.unique, P.clean):
            out = stage(spark, docs, SF)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"BroadcastHashJoin .*LeftAnti", plan) and re.search(r"BroadcastHashJoin .*LeftSemi", plan)
            got = sorted(r["doc_id"] for r in out.collect())
            assert got == (list(range(300)) if stage is P.unique else sorted(r[0] for r in rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
