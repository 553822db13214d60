"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the verdict.

Documents with equal sets of word n-grams are one node (told apart by 128 bits of hash). Bands of a node's MinHash
signature are shuffled by their hash; nodes that share a band are tied to the least of them, so a bucket of any size
gives as many ties as it has members. Components of these ties of up to DIRECT blocks of about BLOCK nodes are dealt
into blocks, and each pair of blocks is verified as one group. Larger ones may be chains of pairs that are only half
alike, so there only nodes that share a band are compared: a bucket that fits into a block is one group, in which a pair
counts if the band is the first one it shares; buckets of more nodes are joined where they overlap and dealt into blocks
in the same way.

A group is of bounded size: its n-gram sets (hashes of 64 bits) are intersected as columns of a 0/1 matrix, and for
every node only the number of its links and its least partner come out. No list of pairs is ever made, and no bucket,
partner list or component is cut short. Every pair is verified in one group only.

Numbers of bands and rows follow from the wanted recall: `rows` hashes must agree in a band, and there are as many
bands as give a pair at the threshold that chance of meeting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import Words, mix, release, slices, small_batches, windows
from tessera.llm.components import connected_components, looked_up
from tessera.llm.sieve import sieved
from tessera.sources.shared import forget, kept

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 8
BLOCK = 256
DIRECT = 16  # components of so many blocks are compared as a whole; a node then goes to 16 groups at most
WEIGHT = 1 << 14  # a set of more n-grams than this counts as several nodes of a block
COLUMNS = 4096


def bands_for(threshold: float, rows: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct n-grams of lower-case words, text by text. A text of fewer words than n, but one
    at least, has one: all its words."""
    words = Words([t.lower() for t in texts])
    h, counts = words.hashes(), words.counts()
    full = windows(h, n)
    at = np.arange(len(full))
    inside = words.doc[at] == words.doc[np.minimum(at + n - 1, len(h) - 1)] if len(full) else np.zeros(0, bool)
    doc, value = words.doc[: len(full)][inside], full[inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        few = [int(mix(windows(h[words.first[i] : words.first[i + 1]], int(counts[i])) + np.uint64(counts[i]))[0]) for i in short]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, np.array(few, np.uint64)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_hashes(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes for each set of n-grams, whatever their order; zeros for an empty one."""
    size = np.diff(first)
    has = np.flatnonzero(size)
    out = np.zeros((2, len(size)), np.uint64)
    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F) if len(has) else ()):
        out[k, has] = mix(np.add.reduceat(mix(value ^ np.uint64(salt)), first[has]) + size[has].astype(np.uint64))
    return out[0], out[1]


def band_hashes(value: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each set; an empty set's are zero."""
    has = np.flatnonzero(np.diff(first))
    draw = np.random.Generator(np.random.PCG64(20240817))
    a = draw.integers(0, 1 << 64, bands * rows, np.uint64) | np.uint64(1)
    b = draw.integers(0, 1 << 64, bands * rows, np.uint64)
    out = np.zeros((len(first) - 1, bands), np.uint64)
    for band in range(bands if len(has) else 0):
        h = np.full(len(has), band, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            h = mix(h * np.uint64(0x100000001B3) + np.minimum.reduceat(value * a[k] + b[k], first[has]))
        out[has, band] = h
    return out


def signed(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """k (the key), th (a hash of the text), h1 and h2 (of the set; null without n-grams), bands, and size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            value, first = shingles(texts, n)
            size = np.diff(first)
            one, two = (pa.array(h.view(np.int64), mask=size == 0) for h in set_hashes(value, first))
            found = band_hashes(value, first, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(found.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), one, two, lists, pa.array(size)], ["k", "th", "h1", "h2", "bands", "size"])

    thin = docs.select(docs[key].alias("k"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("t"))
    return thin.mapInArrow(run, f"k {thin.schema['k'].dataType.simpleString()}, th long, h1 long, h2 long, bands array<long>, size long")


def _sets(members: DataFrame, count: int, docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """The `count` members (with rep, the key and text hash of one of their documents, h1 and h2) with `grams`, the set,
    8 bytes each. Only texts that a bit table of the members may know are shuffled."""
    texts = docs.select(docs[key].alias("__k"), F.xxhash64(docs[text]).alias("__th"), docs[text].alias("t"))
    texts, _ = sieved(texts, F.xxhash64("__k", "__th"), members.select(F.xxhash64("rep.k", "rep.th")), count)
    # one plan at every size: a broadcast of few members would only hide that texts are shuffled
    met = members.hint("merge").join(texts, F.col("rep.k").eqNullSafe(F.col("__k")) & (F.col("rep.th") == F.col("__th"))).drop("__k", "__th", "rep")
    names = [c for c in met.columns if c not in ("h1", "h2", "t")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            value, first = shingles(texts, n)
            one, two = set_hashes(value, first)
            h1, h2 = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("h1", "h2"))
            right = pa.array(np.flatnonzero((one.view(np.int64) == h1) & (two.view(np.int64) == h2)))  # texts may share a key and a hash
            grams = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(first.astype(np.int64) * 8), pa.py_buffer(value.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)).take(right) for c in names), grams.take(right)], [*names, "grams"])

    kinds = dict(met.dtypes)
    return met.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", grams binary")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal values of `names`, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            if held and tuple(keys[s]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = tuple(keys[s])
    if held:
        yield pa.Table.from_batches(held)
    release()


def _overlaps(value: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets `left` with the sets `right`."""
    member = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, code, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    member, code = member[shared[code]], place[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    member, code = member[order], code[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        s, e = np.searchsorted(code, [at, at + COLUMNS])
        m = np.zeros((len(first) - 1, COLUMNS), np.float32)
        m[member[s:e], code[s:e] - at] = 1
        out += m[left] @ m[right].T
    return out


GROUP = ["band", "g", "i", "j"]


def _linked(group: pa.Table, threshold: float) -> list[tuple[int, int, int]]:
    """(node, links to rows of other nodes, least node that is tied to it here) of a group."""
    band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
    node, block, copies = (group.column(c).to_numpy() for c in ("node", "block", "copies"))
    sets = group.column("grams").to_pylist()
    value = np.frombuffer(b"".join(sets), np.uint64)
    size = np.array([len(x) // 8 for x in sets], np.int64)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    common = _overlaps(value, np.concatenate([[0], np.cumsum(size)]), left, right)
    # sizes of sets are far below 2**24, so 32-bit floats hold them exactly
    near = common >= threshold * (size[left][:, None] + size[right][None, :] - common) - 1e-6
    if band >= 0:  # a bucket: the pairs that met in no earlier band, and in no larger bucket
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        for earlier in range(band):
            near &= bands[:, earlier][:, None] != bands[:, earlier][None, :]
        large = group.column("large").to_numpy()
        near &= (large[:, None] != large[None, :]) | (large[:, None] < 0)
    linked = np.zeros((len(node), len(node)), bool)
    linked[np.ix_(left, right)] = near
    linked |= linked.T
    np.fill_diagonal(linked, False)
    tied, before = node.copy(), None
    while before is None or (tied != before).any():
        before = tied
        tied = np.minimum(tied, np.where(linked, tied[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
    return [(int(node[r]), int(k), int(tied[r])) for r, k in enumerate(linked @ copies) if k]


def _ties(buckets: DataFrame, total: int) -> DataFrame:
    """(node, least) of the nodes that share a bucket (node, band, c: its members, least: the least of them)."""
    least = buckets.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("c")).filter("c > 1")
    return looked_up(buckets, least, "band", "c", total).filter("node <> least").select("node", "least").distinct()


def _blocks(members: DataFrame, label: str, total: int) -> DataFrame:
    """members (node, label, w), with `blocks`: into how many their component is dealt."""
    sizes = members.groupBy(label).agg(F.count("*").alias("n"), F.ceil(F.sum("w") / BLOCK).cast("int").alias("blocks"))
    return looked_up(members, sizes, label, "n", total).drop("n")


def _groups_of(spark: SparkSession, nodes: DataFrame, sets_of) -> tuple[DataFrame, list[DataFrame]]:
    """(the groups to verify: GROUP, and of each of their nodes block, node, copies, grams, bands, large; tables they are read from)."""
    weighed = nodes.select("node", "w")
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    found = connected_components(spark, _ties(buckets, buckets.count()))
    count = found.count()
    found = kept(spark, _blocks(found.join(weighed, "node"), "label", count), "candidates")
    members = kept(spark, found.join(nodes.drop("w", "set_id"), "node"), "members")
    sets = kept(spark, sets_of(members, count), "sets")
    forget(members)
    if sets.count() > count:  # rows that repeat a key and a text
        repeated, sets = sets, kept(spark, sets.dropDuplicates(["node"]), "sets")
        forget(repeated)

    def dealt(rows: DataFrame, label: str) -> DataFrame:
        """Every pair of blocks of a component."""
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
        rows = rows.withColumn("p", F.explode(pair))
        none = F.lit(None).cast("array<long>")
        return rows.select(F.lit(-1).alias("band"), F.col(label).alias("g"), "p.i", "p.j", "block", "node", "copies", "grams", none.alias("bands"), F.lit(-1).cast("long").alias("large"))

    groups = dealt(sets.filter(F.col("blocks") <= DIRECT), "label")
    large = found.filter(F.col("blocks") > DIRECT)
    n = large.count()
    if not n:
        return groups, [found, sets]
    # larger components: their buckets
    inside = sets.filter(F.col("blocks") > DIRECT).select("node", "w", F.posexplode("bands").alias("pos", "band"))
    mark = F.xxhash64("node").cast("decimal(38,0)")
    shapes = inside.groupBy("band").agg(F.first("pos").alias("pos"), F.count("*").alias("c"), F.sum("w").alias("w"), F.sum(mark).alias("m"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("m2"))
    shapes = kept(spark, shapes.filter("c > 1"), "buckets")
    wide = looked_up(inside.drop("w", "pos"), shapes.filter(F.col("w") > BLOCK).select("band", "c"), "band", "c", n * 64).select("node", "band")
    wide = kept(spark, wide, "wide")
    joined = connected_components(spark, _ties(wide, wide.count()))
    joined = kept(spark, _blocks(joined.join(weighed, "node"), "label", joined.count()).select("node", F.col("label").alias("large"), "blocks"), "large")
    groups = groups.unionByName(dealt(sets.drop("blocks", "label").join(joined, "node"), "large"))
    # of buckets with the same members the one of the first band is enough
    few = shapes.filter(F.col("w") <= BLOCK).groupBy("c", "m", "m2").agg(F.min(F.struct("pos", "band")).alias("b")).select("b.band", "c")
    narrow = looked_up(inside.drop("w"), few, "band", "c", n * 64).select("node", F.col("pos").alias("band"), F.col("band").alias("g"))
    own = sets.filter(F.col("blocks") > DIRECT).drop("blocks", "label").join(joined.drop("blocks"), "node", "left")
    none = F.lit(0).cast("int")
    narrow = narrow.join(own, "node").select("band", "g", none.alias("i"), none.alias("j"), none.alias("block"), "node", "copies", "grams", "bands", F.coalesce("large", F.lit(-1)).alias("large"))
    return groups.unionByName(narrow), [found, sets, shapes, wide, joined]


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """key, class_id, n_links and set_id of every row; the key may be of any type that has an order.

    class_id: the least key of the rows joined by links of Jaccard >= threshold, directly or through others; n_links:
    other rows at that similarity, those with the same set included; set_id: the least key of those with the same set.
    A null, empty or blank text has no n-grams and no links, and is its own class. Rows with a null key take part and
    come back with a null key (and a null class, if it has no other key). Repeated rows, and differing texts under one
    key, are rows of their own. No rows give no rows; other columns are left out. The result is written to the shared
    folder, what was written on the way there is deleted.
    """
    small_batches(spark)
    bands = bands_for(threshold, rows, recall)
    signs = kept(spark, signed(docs, key, text, n, bands, rows), "signed")
    total = signs.count()
    nodes = signs.filter("h1 is not null").groupBy("h1", "h2")
    nodes = nodes.agg(F.min("k").alias("set_id"), F.min(F.struct("k", "th")).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max(F.ceil(F.col("size") / WEIGHT)).alias("w"))
    nodes = kept(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups, tables = _groups_of(spark, nodes, lambda members, count: _sets(members, count, docs, key, text, n))
    groups = groups.repartition(*GROUP).sortWithinPartitions(*GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, GROUP):
            if out := _linked(group, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["node", "links", "tied"])

    links = kept(spark, groups.mapInArrow(run, "node long, links long, tied long"), "links")
    classes = connected_components(spark, links.select("node", "tied"))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("h1", "h2", "node", "set_id", "copies").join(classes.join(counts, "node", "left"), "node", "left")
    names = known.filter("label is not null").groupBy("label").agg(F.min("set_id").alias("class_id"), F.count("*").alias("m"))
    grouped = looked_up(known.filter("label is not null"), names, "label", "m", total).drop("m")
    known = grouped.unionByName(known.filter("label is null").withColumn("class_id", F.lit(None).cast(signs.schema["k"].dataType)))
    known = kept(spark, known.select("h1", "h2", "class_id", "links", "copies", "set_id"), "known")
    rows_of = signs.select("k", "h1", "h2")
    out = looked_up(rows_of, known, ["h1", "h2"], "copies", total)
    alone = rows_of.filter("h1 is null").select(F.col("k").alias(key), F.col("k").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("set_id"))
    out = out.select(
        F.col("k").alias(key),
        F.coalesce("class_id", "set_id", "k").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("set_id", "k").alias("set_id"),
    )
    out = kept(spark, out.unionByName(alone), "classes")
    for done in (signs, nodes, links, classes, known, *tables):
        forget(done)
    return out


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word Jaccard of 0.8 or more over all documents."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s(i) WHERE len(w) > 0
), sets AS (
  SELECT doc_id, list(g ORDER BY g) AS gs, count(*) AS n FROM grams GROUP BY doc_id
), same AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY gs) AS set_id, count(*) OVER (PARTITION BY gs) AS copies FROM sets
), reps AS (
  SELECT doc_id AS set_id, n, copies FROM same WHERE doc_id = set_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM grams a JOIN grams b USING (g) JOIN reps p ON p.set_id = a.doc_id JOIN reps q ON q.set_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y, q.copies FROM common JOIN reps p ON p.set_id = x JOIN reps q ON q.set_id = y
  WHERE c >= 0.8 * (p.n + q.n - c) - 1e-6
), reach AS (
  SELECT set_id AS x, set_id AS y FROM reps
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), classes AS (
  SELECT x AS set_id, min(y) AS class_id FROM reach GROUP BY x
), degree AS (
  SELECT x AS set_id, sum(copies) AS links FROM links GROUP BY x
)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id,
  CAST(coalesce(g.links, 0) + coalesce(s.copies, 1) - 1 AS BIGINT) AS n_links, coalesce(s.set_id, d.doc_id) AS set_id
FROM documents d LEFT JOIN same s USING (doc_id) LEFT JOIN classes c ON c.set_id = s.set_id LEFT JOIN degree g ON g.set_id = s.set_id
"""
