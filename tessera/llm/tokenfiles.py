"""Token ids of documents in segments whose document boundaries are Elias-Fano coded.

A segment holds consecutive documents in key order, in one run of bytes:

    magic 'TEF1', then little-endian: width of an id in bytes (B), flags (B: 1 if there are keys), documents (I),
    ids (Q), least key (q), then the Elias-Fano sequence of the documents' ends, that of the keys (less the least)
    if there are keys, and the ids one after another.

An Elias-Fano sequence of n ascending numbers up to u keeps the low floor(log2(u / n)) bits of each in a packed array
and the high bits in unary, in a bit vector of about 2n bits: near 2 + log2(u / n) bits a number instead of 64. The
position of every 256th one of the bit vector is kept too (`select` samples, 32 bits each): the i-th number is read
by counting ones from its sample on. Files are read by the same select structures, the 256 numbers of one sample at a
time: no table of 64-bit offsets is ever made.

On Spark a segment is a row of a Parquet table (part, seg, docs, ids, payload), so that the files are committed by
Spark's own writer on any file system. Segments of one part, and the parts, are in key order.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import slices, small_batches
from tessera.sources.shared import shared_folder

MAGIC = b"TEF1"
HEAD = struct.Struct("<4sBBIQq")
SEQ = struct.Struct("<IQBIII")
SAMPLE = 256
SEGMENT_IDS = 1 << 20
CACHE = 1_000_000


class EliasFano:
    """n ascending numbers, 0 or more."""

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, top, low_bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = [a.tobytes() for a in (self.low, self.high, self.samples)]
        return SEQ.pack(self.n, self.top, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the beginning of data, and how many bytes it takes."""
        n, top, low_bits, *sizes = SEQ.unpack_from(data)
        at, parts = SEQ.size, []
        for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4"), strict=True):
            parts.append(np.frombuffer(data[at : at + size], kind))
            at += size
        return cls(n, top, low_bits, *parts), at

    def block(self, b: int) -> np.ndarray:
        """The numbers from one sample to the next: at most SAMPLE, the first of them the (b * SAMPLE)-th."""
        i, n = b * SAMPLE, min(SAMPLE, self.n - b * SAMPLE)
        at = int(self.samples[b])
        end = int(self.samples[b + 1]) if b + 1 < len(self.samples) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[at // 8 : (end + 7) // 8], bitorder="little")) + at // 8 * 8
        high = ones[(ones >= at)][:n] - np.arange(i, i + n)
        bit = i * self.low_bits
        bits = np.unpackbits(self.low[bit // 8 : (bit + n * self.low_bits + 7) // 8], bitorder="little")[bit % 8 :][: n * self.low_bits]
        low = (bits.reshape(n, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | low

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i // SAMPLE)[i % SAMPLE])

    def __iter__(self) -> Iterator[int]:
        for b in range(len(self.samples)):
            yield from self.block(b).tolist()

    def nbytes(self) -> int:
        return SEQ.size + self.low.nbytes + self.high.nbytes + self.samples.nbytes


def write_segment(ids: list[bytes], keys: list[int] | None, width: int) -> bytes:
    """ids: of each document, as little-endian unsigned 32-bit numbers; keys: ascending, or None."""
    ends = np.cumsum([len(b) // 4 for b in ids], dtype=np.uint64)
    flat = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}")
    least = keys[0] if keys else 0
    head = HEAD.pack(MAGIC, width, keys is not None, len(ids), len(flat), least)
    known = EliasFano.of([k - least for k in keys]).to_bytes() if keys is not None else b""
    return head + EliasFano.of(ends).to_bytes() + known + flat.tobytes()


class Segment:
    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.width, keyed, self.docs, self.n_ids, least = HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.ends, took = EliasFano.from_bytes(view[HEAD.size :])
        at, self.keys = HEAD.size + took, False
        if keyed:
            self.gaps, took = EliasFano.from_bytes(view[at:])
            self.keys, self.least, at = True, least, at + took
        self.flat = np.frombuffer(view[at : at + self.n_ids * self.width], f"<u{self.width}")

    def ids(self, i: int) -> np.ndarray:
        """The ids of document i, found through the two selects around it."""
        return self.flat[self.ends.select(i - 1) if i else 0 : self.ends.select(i)].astype("<u4")

    def key(self, i: int) -> int | None:
        return self.least + self.gaps.select(i) if self.keys else None

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, place of the first id, ids) of every document, in order."""
        at = 0
        for end, gap in zip(self.ends, self.gaps if self.keys else repeat(None)):  # noqa: B905
            yield None if gap is None else self.least + gap, at, self.flat[at:end].astype("<u4")
            at = end


# White space and the mark that splits pieces: where any of it stands, pieces may part elsewhere.
_RARE = re.compile("[\0\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")


def _plain(text: str) -> bool:
    """Only blanks and line feeds, never two of them side by side."""
    return "  " not in text and "\n " not in text and " \n" not in text and "\n\n" not in text and not _RARE.search(text)


class _Numbers(dict):
    """Numbers chunks as they come; `new` has those that have not been encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    """Ids of whole texts by the tokenizers library, as bytes of unsigned 32-bit numbers.

    A byte-level vocabulary splits a text before every single blank and around every single line feed, whatever stands
    around: the ids of a plain text are those of its chunks, each a word with the blank before it, or a line feed.
    Chunks are numbered as they are met and encoded once, many at a time, as lines of one text; a text's ids are then
    gathered by its chunks' numbers. When too many chunks are known, all are forgotten. Other texts are encoded whole.
    """

    LINES = 512

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        pre = str(self.tok.pre_tokenizer)
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        self.splits = "ByteLevel(" in pre and "add_prefix_space=False" in pre and "use_regex=True" in pre and self.tok.normalizer is None and len(feed) == 1
        self.feed = feed[0]
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.known[""], self.known["\n"] = 0, 1
        self.size, self.flat = 1, np.full(1 << 16, self.feed, np.uint32)
        self.at = np.array([0, 0, 1], np.int64)  # chunk n has flat[at[n]:at[n + 1]]

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        chunks, self.known.new = self.known.new, []
        groups = ["\n".join(chunks[i : i + self.LINES]) for i in range(0, len(chunks), self.LINES)]
        if not groups:
            return
        feed = np.array([self.feed], np.uint32)
        ids = np.concatenate([x for found in self._raw(groups) for x in (found, feed)])
        ends = np.flatnonzero(ids == self.feed)
        if len(ends) != len(chunks):
            raise ValueError("the line feed is no piece of its own in this vocabulary")
        ids = np.delete(ids, ends)
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.size : self.size + len(ids)] = ids
        self.at = np.concatenate([self.at, self.size + ends - np.arange(len(ends))])
        self.size += len(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.splits and _plain(t) for t in texts]
        cut = [t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") for t, ok in zip(texts, plain, strict=True) if ok]
        if len(self.known) > CACHE:
            self._forget()
        sizes = [len(chunks) for chunks in cut]
        n = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, sum(sizes))
        self._learn()
        start, count = self.at[n], self.at[n + 1] - self.at[n]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(start - ends + count, count) + np.arange(total)].astype("<u4")
        text_ends = np.append(0, ends)[np.cumsum(sizes, dtype=np.int64)] if sizes else np.zeros(0, np.int64)
        whole = [t for t, ok in zip(texts, plain, strict=True) if not ok]
        rest = iter(self._raw(whole) if whole else ())
        each = iter(zip(np.append(0, text_ends[:-1]).tolist(), text_ends.tolist(), strict=True)) if sizes else iter(())
        out = []
        for ok in plain:
            if ok:
                a, b = next(each)
                out.append(ids[a:b].tobytes())
            else:
                out.append(next(rest).tobytes())
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(spark: SparkSession, df: DataFrame, out: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the segments of df, in ascending key order, to the folder `out` (a path of Spark's).

    A null text is empty (its document is the end id alone). Null keys come first, in segments without keys; rows
    with the same key follow each other by crc32 and text, and may lie in several parts, so a hot key is no hot task.
    Other columns are left out. Segments hold about `segment_ids` ids, or one document that is longer.
    """
    small_batches(spark)
    thin = df.select(df[key].cast("long").alias("k"), F.coalesce(df[text], F.lit("")).alias("t"))
    thin = thin.withColumn("c", F.crc32("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg = TaskContext.get().partitionId(), 0
        tok, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        keys: list[int | None] = []
        size = 0

        def flush():
            nonlocal held, keys, size, seg
            payload = write_segment(held, None if keys[0] is None else keys, tok.width)
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seg]), pa.array([len(held)]), pa.array([size]), pa.array([payload], pa.binary())], ["part", "seg", "docs", "ids", "payload"])
            held, keys, size, seg = [], [], 0, seg + 1
            return row

        for rows, texts in slices(batches, "t"):
            for k, ids in zip(rows.column(0).to_pylist(), tok.encode(texts), strict=True):
                if held and (size + len(ids) // 4 + 1 > segment_ids or (keys[0] is None) != (k is None)):
                    yield flush()
                held.append(ids + end)
                keys.append(k)
                size += len(ids) // 4 + 1
        if held:
            yield flush()

    ordered = thin.repartitionByRange("k", "c").sortWithinPartitions("k", "c", "t").select("k", "t")
    segments = ordered.mapInArrow(run, "part long, seg long, docs long, ids long, payload binary")
    segments.write.option("compression", "zstd").parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """key, start (ids before the document, of all documents), n_tokens, ids_crc32 of every document written."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))  # a row a part
    inside = Window.partitionBy("part").orderBy("seg")
    places = files.select("part", "seg", (F.sum("ids").over(inside) - F.col("ids")).alias("within")).join(parts, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                s = Segment(payload.as_py())
                found = [(key, at, len(ids), zlib.crc32(ids.tobytes())) for key, at, ids in s.documents()]
                keys, at, n, crc = map(list, zip(*found, strict=True))
                m = len(found)
                cols = [pa.array([part.as_py()] * m), pa.array([seg.as_py()] * m), pa.array(keys, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "seg", "key", "at", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seg", "payload").mapInArrow(run, "part long, seg long, key long, at long, n_tokens long, ids_crc32 long")
    return rows.join(places, ["part", "seg"]).select("key", (F.col("before") + F.col("within") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back; the end id is 0."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shared_folder(spark, "tokens")
    write_tokens(spark, docs, out, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, out).withColumnRenamed("key", "doc_id")
