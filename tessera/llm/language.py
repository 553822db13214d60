"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs, drawn from its code point alone. A sequence of N letters is bound
into one vector: the product of its letters' vectors, each rotated by its distance from the end, so that order counts.
The bundle of a text is the sum of the vectors of all its sequences, that of a language the sum of its texts' (each
text counting alike). A text gets the language whose bundle has the greatest cosine with its own, after the part that
all languages share is taken out of both.

Texts become small letters, with one blank for whatever stands between them. The sum over sequences is a matrix
product: counts of a text's distinct sequences times their vectors.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import slices, small_batches

DIMENSIONS = 1024
N = 3
SEED = 7919
SLICE = 1 << 20
CELLS = 1 << 22  # of one table of counts, texts times sequences
MOST_LANGUAGES = 4096


@lru_cache(maxsize=1 << 16)
def letter(code: int) -> np.ndarray:
    """The signs of a letter; the blank is code 32."""
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS, np.int8)
    return (2 * bits - 1).astype(np.float32)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, text of each, code points of the symbols): symbol 0 is the blank; a text has a blank at either end."""
    joined = "".join(f" {t.lower()} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t.lower()) + 2 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    present = np.unique(codes) if len(codes) > 1 << 22 or codes.max(initial=0) > 1 << 16 else np.flatnonzero(np.bincount(codes))
    alphabet = [c for c in present.tolist() if unicodedata.category(chr(c))[0] == "L"]
    table = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int32)
    table[alphabet] = np.arange(1, len(alphabet) + 1)
    symbol = table[codes]
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0) | (doc[1:] != doc[:-1])
    return symbol[keep], doc[keep], np.array([32, *alphabet], np.int64)


def bundles(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bundles divided by the number of sequences, whether there are letters), part by part."""
    symbol, doc, codes = _letters(texts)
    n, k = len(texts), len(codes)
    has = np.bincount(doc[symbol > 0], minlength=n) > 0
    m = len(symbol) - N + 1
    gram = np.zeros(max(m, 0), np.int64)
    for i in range(N):
        gram = gram * k + symbol[i : i + m] if m > 0 else gram
    whole = doc[:m] == doc[N - 1 :] if m > 0 else np.zeros(0, bool)
    gram, doc = gram[whole], doc[:m][whole] if m > 0 else doc[:0]
    if k**N <= 1 << 24:
        seen = np.flatnonzero(np.bincount(gram, minlength=1))
        place = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.int64)
        place[seen] = np.arange(len(seen))
        gram = place[gram]
    else:
        seen, gram = np.unique(gram, return_inverse=True)
    signs = np.stack([letter(int(c)) for c in codes])
    first = np.searchsorted(doc, np.arange(n + 1))
    step = max(1, CELLS // max(1, min(len(seen), 1 << 13)))
    for a in range(0, n, step):
        b = min(n, a + step)
        own, rows = gram[first[a] : first[b]], doc[first[a] : first[b]] - a
        out = np.zeros((b - a, DIMENSIONS), np.float32)
        for at in range(0, len(seen), 1 << 13):
            part = seen[at : at + (1 << 13)]
            inside = (own >= at) & (own < at + len(part)) if len(seen) > 1 << 13 else slice(None)
            counts = np.bincount(rows[inside] * len(part) + own[inside] - at, minlength=(b - a) * len(part)).reshape(b - a, len(part))
            bound, rest = np.ones((len(part), DIMENSIONS), np.float32), part.copy()
            for i in range(N):
                bound *= np.roll(signs, i, axis=1)[rest % k]
                rest //= k
            out += counts.astype(np.float32) @ bound
        yield a, out / np.maximum(np.diff(first)[a:b], 1)[:, None], has[a:b]


def learn(spark: SparkSession, labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, unit prototypes) from all rows with a language; rows without letters teach nothing.

    What comes to the driver is DIMENSIONS numbers a language, and MOST_LANGUAGES languages at most (an error beyond).
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in slices(batches, "t", SLICE):
            langs = part.column(0).to_pylist()
            for a, found, has in bundles(texts):
                for row, ok, name in zip(found, has, langs[a : a + len(found)], strict=True):
                    if ok:
                        sums.setdefault(name, np.zeros(DIMENSIONS))
                        sums[name] += row
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x].tolist() for x in names], pa.list_(pa.float64()))], ["lang", "v"])

    thin = labelled.select(labelled[lang].alias("l"), labelled[text].alias("t")).filter("l is not null and t is not null")
    parts = thin.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = sums.select("lang", F.col("v.x").alias("v")).limit(MOST_LANGUAGES + 1).collect()  # DIMENSIONS numbers a language; one pass over the texts
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows.sort(key=lambda r: r["lang"])
    names = [r["lang"] for r in rows]
    found = np.array([r["v"] for r in rows], np.float64).reshape(len(names), DIMENSIONS)
    return names, _unit(found)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def predict(spark: SparkSession, df: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text") -> DataFrame:
    """df with `lang_pred` and `score` (0 to 1), which replace columns of these names; all others stay.

    `und` and 0 for a null text, one without a letter, or where no language was learned; a tie goes to the first name.
    """
    small_batches(spark)
    rest = df.drop("lang_pred", "score")
    columns = rest.columns
    shared = _unit(prototypes.mean(axis=0)) if len(names) > 1 else np.zeros(DIMENSIONS)
    apart = _unit(prototypes - np.outer(prototypes @ shared, shared)).astype(np.float32)
    known = spark.sparkContext.broadcast((names, shared.astype(np.float32), apart))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shared, apart = known.value
        for part, texts in slices(batches, text, SLICE):
            best, score = [], []
            for _, found, has in bundles(texts):
                v = found - np.outer(found @ shared, shared)
                cos = _unit(v) @ apart.T if names else np.zeros((len(found), 1))
                top = cos.argmax(axis=1)
                best += [names[k] if ok and names else "und" for k, ok in zip(top, has, strict=True)]
                score.append(np.where(has & bool(names), np.clip(cos.max(axis=1), 0, 1), 0))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(np.concatenate(score).astype(np.float64))], [*columns, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32 of the id's digits leaves 0 or 2 modulo 3."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    names, prototypes = learn(spark, docs.filter(~held_out).select("lang", "text"))
    found = predict(spark, docs.select("doc_id", held_out.alias("held_out"), "text"), names, prototypes)
    return found.select("doc_id", "held_out", "lang_pred", "score")
