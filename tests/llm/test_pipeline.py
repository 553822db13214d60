import duckdb
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import decontam, neardup, quality

from ..conftest import SF, SF01
from .test_secrets import base


def test_first_three_stages_against_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"CREATE TABLE documents AS SELECT * FROM '{SF01}/documents.parquet'")
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF01}/benchmark.parquet'")
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    tests = [
        f"WITH docs AS (SELECT doc_id, text FROM documents), {quality.RULES_SQL} SELECT doc_id FROM rules WHERE kept",
        f"SELECT doc_id FROM ({neardup.OP10_SQL}) WHERE doc_id = class_id",
        f"WITH docs AS (SELECT doc_id, text FROM documents), {decontam.LEAKS_SQL} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
    ]
    for k, sql in enumerate(tests):
        want = {r[0] for r in con.sql(sql).fetchall()}
        out = P.STAGES[k][1](spark, docs, SF01)
        assert out.columns == docs.columns
        out.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(want)
        con.sql(f"CREATE OR REPLACE TABLE documents AS SELECT * FROM '{path}/*.parquet'")
        assert 0 < len(want)


def test_whole_run(spark):
    rows = P.run(spark, SF).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert rows and all(r["round_trip"] for r in rows)
    for r in rows:
        text = sp.decode(list(r["ids"]))
        assert len(text) == r["n_chars"] and not base(text) and r["n_tokens"] == len(sp.encode(text))


def test_edges(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(None, long, "a", 1), (None, long, "b", 1), (5, long, "c", 1), (5, long, "c", 1), (None, None, None, None), (7, "", "d", 0), (None, long.replace("word", "other"), "e", 1), (8, long.replace("word", "third") + " token=abcdefgh", "f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, n_chars long").withColumns({c: F.lit(c) for c in ("kept", "secrets", "n_words", "matched", "seed", "shard")})
    out = docs
    for name, stage in P.STAGES[:4]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    assert all(r[c] == c for r in out.collect() for c in ("kept", "secrets", "n_words", "matched", "seed", "shard"))
    got = sorted((r["doc_id"] or 0, r["text"][:5], r["n_chars"] == len(r["text"])) for r in out.collect())
    assert got == [(0, "other", True), (5, "word0", True), (8, "third", True)]
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_differing_texts_under_one_id(spark):
    texts = {w: " ".join(f"{w}{i}" for i in range(80)) for w in ("one", "two", "three")}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    near = texts["three"] + " end"
    rows = [(3, texts["one"]), (5, texts["one"]), (5, texts["two"]), (5, texts["two"]), (7, texts["three"]), (7, near), (8, texts["three"]), (9, item), (9, "Some clean text.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in P.unique(spark, docs, SF).collect())
    assert got[:2] == [(3, texts["one"]), (5, texts["two"])] and got[3:] == sorted([(9, item), (9, "Some clean text.")])
    assert got[2] in ((7, texts["three"]), (7, near))
    assert sorted(r["text"] for r in P.clean(spark, docs.filter("doc_id = 9"), SF).collect()) == ["Some clean text."]
