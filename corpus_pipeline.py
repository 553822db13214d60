"""From raw documents to token ids in five stages; each reads what the one before has written.

A stage is a function of (spark, docs, sf_dir) that returns a DataFrame. All but the last return the columns of docs,
whatever these are, with doc_id and text among them. Documents without an id are told apart by their text; rows that
repeat an id and a text are one document. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, neardup, pieces, quality, secrets
from tessera.llm.frames import shielded
from tessera.llm.sieve import sieved
from tessera.sources.shared import delete, kept, shared_folder

#: The last stage can't be said in SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None

_KEY = "__key"


def _key() -> Column:
    """The id and a 128-bit digest of the text, which tell documents apart: differing texts under one id are documents
    of their own. Without an id, a number above all ids that follows from the text takes its place."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    return F.struct(own.alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    inside, restored = shielded(docs, "text")
    return restored(quality.quality_rules(spark, inside).filter("kept"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, once if it is repeated."""
    keyed = docs.withColumn(_KEY, _key())
    found = neardup.near_duplicates(spark, keyed.select(_KEY, "text"), key=_KEY)
    touched = found.groupBy(_KEY).agg(F.max(F.col(_KEY) != F.col("class_id")).alias("gone"), F.count("*").alias("n"))
    touched = kept(spark, touched.filter("gone OR n > 1"), "touched")
    maybe, untouched = sieved(keyed, F.xxhash64(_KEY), touched.select(F.xxhash64(_KEY)), touched.count())
    once = maybe.dropDuplicates([_KEY])  # combines before the shuffle
    return untouched.unionByName(once.join(touched.filter("gone").select(_KEY), _KEY, "left_anti")).select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    keyed = docs.withColumn(_KEY, _key())
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = decontam.leaks(spark, keyed.select(_KEY, "text"), items.select("item_id", "text"), key=_KEY)
    leaked = kept(spark, leaked.select(_KEY).distinct(), "leaked")
    maybe, others = sieved(keyed, F.xxhash64(_KEY), leaked.select(F.xxhash64(_KEY)), leaked.count())
    return others.unionByName(maybe.join(leaked, _KEY, "left_anti")).select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; the documents stay, and a column n_chars follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, and the bytes of the text (as it then was) that each comes from: starts, ends;
    round_trip: decoding the ids gives the text back."""
    import public_tokenizers

    found = pieces.encode_pieces(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))
    made = ("ids", "starts", "ends")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *made, "n_tokens", "round_trip")]
    return found.select(*rest, *made, F.size("ids").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", rules),
    ("near duplicates", unique),
    ("decontamination", clean),
    ("secrets", redacted),
    ("pieces", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the table of documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(before, spark)
        before = path
    return docs
