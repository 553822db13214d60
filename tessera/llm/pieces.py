"""SentencePiece encoding that knows where in the original bytes every piece comes from, and decoding.

The model's compiled character map is a trie of byte strings with what replaces them. Normalisation takes the longest
prefix that the trie knows (or one character as it stands), appends its replacement and notes for every byte of the
result at which byte of the source it began. Stretches in which no entry of the trie can begin are taken as they stand
in one step. Pieces are cut from the normalised text, so their ends there give spans in the original.

Merging in a BPE vocabulary never joins what no piece spans. Where the map is empty and no piece has the blank mark
behind another character, a text's pieces are those of the words of its normalised form, each with the marks before it;
words that were met before are taken from memory. Other vocabularies encode whole texts.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tessera.llm.arrow import slices, small_batches

MARK = "▁"
CACHE = 100_000
BPE = 2  # model_type of the trainer's settings


class CharacterMap:
    """The compiled map: 32-bit length of a double-array trie, its units, then replacements ended by zero bytes."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.targets = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(length of the longest known prefix of data[at:], place of its replacement); (0, 0) if none is known."""
        units, best = self.units, (0, 0)
        if not units:
            return best
        step = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        pos = step(units[0])
        for i in range(at, len(data)):
            pos ^= data[i]
            unit = units[pos]
            if unit & 0x800000FF != data[i]:
                break
            pos ^= step(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[pos] & 0x7FFFFFFF)
        return best

    def target(self, at: int) -> bytes:
        return self.targets[at : self.targets.index(0, at)]


class Normaliser:
    def __init__(self, charsmap: bytes, add_dummy_prefix: bool, remove_extra_whitespaces: bool, escape_whitespaces: bool):
        self.map = CharacterMap(charsmap)
        self.prefix, self.squeeze, self.escape = add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces
        self.blank = MARK.encode() if escape_whitespaces else b" "
        #: whether an entry of the map, or what is squeezed, can begin with a byte
        self.begins = np.array([self._can_begin(b) for b in range(256)])
        if remove_extra_whitespaces:
            self.begins[0x20] = True

    def _can_begin(self, b: int) -> bool:
        units = self.map.units
        if not units:
            return False
        at = ((units[0] >> 10) << ((units[0] & 0x200) >> 6)) ^ b
        return at < len(units) and units[at] & 0x800000FF == b

    def _next(self, data: bytes, at: int) -> tuple[bytes, int]:
        size, place = self.map.longest(data, at)
        if size:
            return self.map.target(place), size
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + size], size

    def _plain(self, data: bytes, at: int, end: int) -> tuple[bytes, np.ndarray]:
        """A stretch of whole characters that stand for themselves, and for each of its bytes where its character begins."""
        part = np.frombuffer(data, np.uint8, end - at, at)
        origin = np.maximum.accumulate(np.where((part & 0xC0) != 0x80, np.arange(at, end), at))
        if not self.escape:
            return data[at:end], origin
        return data[at:end].replace(b" ", self.blank), np.repeat(origin, np.where(part == 0x20, len(self.blank), 1))

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and for their end, the place in data where its source begins."""
        at, n, after_blank = 0, len(data), self.squeeze
        while self.squeeze and at < n:  # leading blanks
            piece, size = self._next(data, at)
            if piece != b" ":
                break
            at += size
        if at == n:
            return b"", np.array([at])
        out: list[bytes] = [self.blank] if self.prefix else []
        origin = [np.full(len(self.blank), at)] if self.prefix else []
        special = np.flatnonzero(self.begins[np.frombuffer(data, np.uint8)])
        while at < n:
            k = np.searchsorted(special, at)
            stop = int(special[k]) if k < len(special) else n
            if at < stop:
                piece, places = self._plain(data, at, stop)
                out.append(piece)
                origin.append(places)
                after_blank, at = False, stop
                continue
            piece, size = self._next(data, at)
            piece = piece.lstrip(b" ") if after_blank else piece
            if piece:
                shown = piece.replace(b" ", self.blank)
                out.append(shown)
                origin.append(np.full(len(shown), at))
                after_blank = self.squeeze and piece.endswith(b" ")
            at += size
        text, places = b"".join(out), np.concatenate([*origin, [at]])
        while self.squeeze and text.endswith(self.blank):
            text, places = text[: -len(self.blank)], places[: len(places) - len(self.blank)]
        return text, places


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        spec = model.normalizer_spec
        self.norm = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        names = [p.piece for p in model.pieces]
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        own = any(p.type == p.USER_DEFINED for p in model.pieces)
        suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.by_word = plain and not own and not suffix and model.trainer_spec.model_type == BPE and not any(MARK in p.lstrip(MARK) for p in names)
        # bytes of the normalised text that a piece covers
        self.norm_size = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in model.pieces], np.int32)
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == p.UNKNOWN}
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        return np.array(ids, "<u4").tobytes(), b",".join(b"%d" % i for i in ids)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes, np.ndarray]]:
        """Of each text: its ids as little-endian unsigned 32-bit numbers, the same as decimals joined by commas, and the
        bounds of its pieces: piece i comes from the bytes bounds[i] to bounds[i + 1] of the text."""
        normal = [self.norm.normalise(t.encode()) for t in texts]
        if self.by_word:
            found = self._by_word([n.decode() for n, _ in normal])
        else:
            found = [self._entry(ids) for ids in self.sp.encode(texts, num_threads=1)]
        return [(ids, said, self._bounds(np.frombuffer(ids, "<u4").astype(np.int32), *n)) for (ids, said), n in zip(found, normal, strict=True)]

    def _by_word(self, normal: list[str]) -> list[tuple[bytes, bytes]]:
        cut = [re.findall(f"{MARK}+[^{MARK}]*", s) if MARK * 2 in s else [MARK + w for w in s.split(MARK)[1:]] for s in normal]
        if len(self.known) > CACHE:
            self.known = {}
        new = list({w for words in cut for w in words} - self.known.keys())
        # the library puts a mark before each word itself
        for w, ids in zip(new, self.sp.encode([w[1:] for w in new], num_threads=1), strict=True):
            self.known[w] = self._entry(ids if w != MARK else [self.sp.piece_to_id(MARK)])
        out = []
        for words in cut:
            found = [self.known[w] for w in words]
            out.append((b"".join([a for a, _ in found]), b",".join([b for _, b in found])))
        return out

    def _bounds(self, ids: np.ndarray, norm: bytes, origin: np.ndarray) -> np.ndarray:
        """Places in the source: where each piece begins, and where the last one ends. Of a character that became several
        pieces all but the last are empty, as the library has it; a blank put before the text covers no byte."""
        if not len(ids):
            return np.zeros(1, np.int64)
        sizes = self.norm_size[ids].astype(np.int64)
        unknown = np.flatnonzero(np.isin(ids, list(self.unknown))) if self.unknown else ()
        for i in unknown:  # an unknown piece takes what lies before the next known one
            at = int(sizes[:i].sum())
            later = next((self.sp.id_to_piece(int(j)).encode() for j in ids[i + 1 :] if int(j) not in self.unknown), None)
            sizes[i] = (norm.index(later, at + 1) if later else len(norm)) - at
        return origin[np.minimum(np.concatenate([[0], np.cumsum(sizes)]), len(norm))]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1) if ids else []


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(spark: SparkSession, df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with `ids` array<int>, `starts` and `ends` array<int> (byte spans in the text) and `decoded` string.

    A null text counts as empty and gives empty arrays and an empty string. Columns of these names are replaced, all
    others stay; repeated rows each give a row. The model is read on the executors from `path`, once in each worker.
    """
    small_batches(spark)
    rest = df.drop("ids", "starts", "ends", "decoded")
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for part, texts in slices(batches, part_name):
            found = model.encode(texts)
            ids = [np.frombuffer(a, "<u4").astype(np.int32) for a, _, _ in found]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
            of = lambda arrays: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)))
            new = [of(ids), of([b[:-1] for _, _, b in found]), of([b[1:] for _, _, b in found]), pa.array(model.decode([i.tolist() for i in ids]), pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "ids", "starts", "ends", "decoded"])

    part_name = rest.columns[at]
    schema = StructType(list(rest.schema.fields))
    for name in ("ids", "starts", "ends"):
        schema = schema.add(name, ArrayType(IntegerType()))
    schema = schema.add("decoded", "string")
    return rest.mapInArrow(run, schema)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all documents; span_bytes: bytes of the text that pieces cover;
    bounds_sha256: digest of where the pieces begin, and the end, as little-endian 32-bit numbers."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part, texts in slices(batches, "text"):
            found = model.encode(texts)
            back = model.decode([np.frombuffer(a, "<u4").tolist() for a, _, _ in found])
            cols = [
                pa.array([len(a) // 4 for a, _, _ in found], pa.int64()),
                pa.array([sha(b) for _, b, _ in found]),
                pa.array([sha(t.encode()) for t in back]),
                pa.array([int(b[-1] - b[0]) for _, _, b in found], pa.int64()),
                pa.array([sha(b.astype("<u4").tobytes()) for _, _, b in found]),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "bounds_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long, bounds_sha256 string")
