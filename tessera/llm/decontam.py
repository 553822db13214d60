"""Benchmark decontamination by spaced seeds.

A document leaks an item if some stretch of WINDOW consecutive words of the one, laid on as many of the other, agrees
in NEED places or more (in every word, for an item of fewer words than NEED). The other places may hold any words.
Items of fewer words than a mask looks at would be met by chance everywhere: such an item is leaked by a document one of
whose lines is just its words, which is an exact look-up.

Each fixed mask looks at some positions of a stretch and ignores the rest. MASKS are chosen so that, wherever
WINDOW - NEED words are substituted in a window, one of them fits between: no leak is lost (tested over all cases).
Hashes of what the masks see in the items go into a bit table of fixed size; only document hashes that it may know
are joined with the items', and each carries the words around it, so that a hit is verified where it is joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import Words, mix, slices, small_batches
from tessera.sources.shared import kept

WINDOW = 13
NEED = 10
# The masks; 1 is a position that counts.
MASKS = ("111111", "11101011", "1100100111", "1011000111", "1110001011", "11100101001")
WEIGHT = 6
TABLE_BITS = (20, 30)  # the bit table has 2**20 to 2**30 bits (128 MB), about 1024 for each seed of the items
AROUND = WINDOW - 1

_MARKS = re.compile(r"[\W_]+")


def _words(texts: list[str]) -> tuple[Words, np.ndarray]:
    """Lower-case words of letters and digits, and their hashes."""
    words = Words([_MARKS.sub(" ", t.lower()) for t in texts])
    return words, words.hashes()


def _seeds(words: Words, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number of the beginning, hash) of every mask at every place where it lies within one text."""
    end = words.first[1:][words.doc] if len(h) else np.zeros(0, np.int64)
    for k, mask in enumerate(MASKS):
        at = np.flatnonzero(np.arange(len(h)) + len(mask) <= end)
        value = np.full(len(at), k + 1, np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                value = value * np.uint64(0x9E3779B97F4A7C15) + h[at + i]
        yield at, mix(value)


def _bits(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bit table of 2**size bits."""
    return (value >> np.uint64(64 - size)).astype(np.int64), (value & np.uint64((1 << size) - 1)).astype(np.int64)


def _contexts(words: Words, h: np.ndarray, at: np.ndarray, nothing: int) -> np.ndarray:
    """The words from AROUND before to AROUND behind each place, as 32-bit hashes; `nothing` beyond the text's ends."""
    small = np.append((h >> np.uint64(32)).astype(np.uint32) | np.uint32(2), np.uint32(nothing))
    place = at[:, None] + np.arange(-AROUND, AROUND + 1)
    first, end = words.first[:-1][words.doc[at]], words.first[1:][words.doc[at]]
    return small[np.where((place >= first[:, None]) & (place < end[:, None]), place, len(h))]


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _once(doc: np.ndarray, value: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Places of the first of equal rows: a passage that a text repeats is looked up once."""
    return np.unique(np.concatenate([doc[:, None].astype(np.uint64), value[:, None], around], axis=1), axis=0, return_index=True)[1]


def _item_seeds(items: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            words, h = _words(texts)
            n = words.counts()
            for at, value in _seeds(words, h):
                doc = words.doc[at]
                keys = part.column(0).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.minimum(n[doc], NEED)), pa.array(value.view(np.int64)), _binary(_contexts(words, h, at, 0))], ["item", "need", "seed", "item_words"])

    thin = items.select(items[key].cast("long").alias("k"), items[text].alias("t"))
    return thin.mapInArrow(run, "item long, need long, seed long, item_words binary").distinct()


def _bit_table(spark: SparkSession, seeds: DataFrame) -> tuple[np.ndarray, int]:
    """(the bits of all seeds, how many bits there are as a power of two); what comes to the driver is 4 KB for each of
    2**(bits - 15) stretches at most."""
    size = min(max((1024 * seeds.count()).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(value, size)))], ["bit"])

    bits = seeds.select("seed").mapInArrow(run, "bit long")
    parts = bits.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % (1 << 15)).alias("map"))
    table = np.zeros((1 << size) // 8, np.uint8)
    for part, found in parts.toLocalIterator():
        table[part * 4096 : (part + 1) * 4096] = np.frombuffer(found, np.uint8)
    return table, size


def _words_of(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def _short_leaks(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(doc, item, matched) of items of fewer than WEIGHT words, one at least; None if there are no such items."""
    short = items.select(F.col("k").alias("item"), _words_of(F.col("t")).alias("w")).filter(F.size("w").between(1, WEIGHT - 1)).distinct()
    if not short.limit(1).count():
        return None
    lines = docs.select(F.col("k").alias("doc"), F.explode(F.split("t", "\n")).alias("line")).select("doc", _words_of(F.col("line")).alias("w"))
    lines = lines.filter(F.size("w").between(1, WEIGHT - 1)).distinct()
    return lines.join(short, "w").select("doc", "item", F.size("w").cast("long").alias("matched"))


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_key and `matched` (agreeing words of the best window, WINDOW at most) of every leak, once a pair.

    Null and empty texts leak nothing. Rows with the same key (of any type) count as one document, null keys too;
    repeated items with one key count as one. No documents or no items give no rows; other columns are left out.
    """
    small_batches(spark)
    seeds = kept(spark, _item_seeds(items, item_key, item_text), "seeds")
    bits, size = _bit_table(spark, seeds)
    table = spark.sparkContext.broadcast(bits)  # 128 MB at most

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for part, texts in slices(batches, "t"):
            words, h = _words(texts)
            for at, value in _seeds(words, h):
                maybe = np.ones(len(at), bool)
                for bit in _bits(value, size):
                    maybe[maybe] = (known[bit[maybe] >> 3] >> (bit[maybe] & 7).astype(np.uint8)) & 1 > 0
                at, value = at[maybe], value[maybe]
                if len(at):
                    doc, around = words.doc[at], _contexts(words, h, at, 1)
                    one = _once(doc, value, around)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[one])), pa.array(value[one].view(np.int64)), _binary(around[one])], ["doc", "seed", "doc_words"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, 2 * AROUND + 1) for i in (3, 4))
            agree = np.cumsum(np.pad(a == b, ((0, 0), (1, 0))), axis=1)
            best = (agree[:, WINDOW:] - agree[:, :-WINDOW]).max(axis=1)
            need = batch.column(2).to_numpy()
            good = pa.array(np.flatnonzero((best >= need) & (need >= WEIGHT)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good), pa.array(best.astype(np.int64)).take(good)], ["doc", "item", "matched"])

    thin = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    kind = thin.schema["k"].dataType.simpleString()
    found = thin.mapInArrow(hits, f"doc {kind}, seed long, doc_words binary").join(seeds, "seed").select("doc", "item", "need", "doc_words", "item_words")
    sure = found.mapInArrow(verify, f"doc {kind}, item long, matched long")
    lines = _short_leaks(thin, items.select(items[item_key].cast("long").alias("k"), items[item_text].alias("t")))
    sure = sure if lines is None else sure.unionByName(lines)
    return sure.groupBy(F.col("doc").alias(key), F.col("item").alias(item_key)).agg(F.max("matched").alias("matched"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it leaks."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return leaks(spark, read("documents").select("doc_id", "text"), read("benchmark").select("item_id", "text"))


#: Leaks of a table or CTE `docs` (doc_id, text), as CTEs that end in `leaks`.
LEAKS_SQL = f"""
doc_words AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM docs)
), item_words AS (
  SELECT item_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS q FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark)
), agree AS (
  SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, p - q ORDER BY q RANGE BETWEEN CURRENT ROW AND {AROUND} FOLLOWING) AS c
  FROM doc_words JOIN item_words USING (w)
), line_words AS (
  SELECT doc_id, regexp_extract_all(lower(l), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM docs)
), short_items AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark
), leaks AS (
  SELECT doc_id, item_id, max(c) AS matched FROM (
    SELECT doc_id, item_id, c FROM agree WHERE c >= least({NEED}, n) AND n >= {WEIGHT}
    UNION ALL SELECT doc_id, item_id, len(s.w) FROM line_words l JOIN short_items s ON l.w = s.w WHERE len(s.w) BETWEEN 1 AND {WEIGHT - 1}
  ) GROUP BY doc_id, item_id
)"""

OP7_SQL = f"WITH docs AS (SELECT doc_id, text FROM documents), {LEAKS_SQL} SELECT * FROM leaks"
