import hashlib
import tempfile

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from tessera.llm import pieces as P

from ..conftest import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.text(st.sampled_from("ab the▁ \n\t  é　日\U0001f600ｈ①㍿ﾞｶ́e"), max_size=30)


def ids_of(text):
    return np.frombuffer(P.load(PATH).encode([text])[0][0], "<u4")


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_ids_and_round_trip(text):
    ids = ids_of(text).tolist()
    assert ids == LIB.encode(text)
    assert P.load(PATH).decode([ids])[0] == LIB.decode(ids)


def offsets(lib, text):
    """(begin, end) of the library's pieces in bytes."""
    return [(p.begin, p.end) for p in lib.encode(text, return_type="proto").pieces]


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_spans_are_those_of_the_library(text):
    bounds = P.load(PATH).encode([text])[0][2].tolist()
    assert list(zip(bounds, bounds[1:], strict=False)) == offsets(LIB, text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_spans_through_a_compiled_map(rule, text):
    """The vocabulary of the given model behind another character map: nothing is bypassed."""
    model = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.ModelProto.FromString(norm.serialized_model_proto()).normalizer_spec
    model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = rule != "identity"
    with tempfile.NamedTemporaryFile(suffix=".model") as f:
        f.write(model.SerializeToString())
        f.flush()
        mine, lib = P.Pieces(f.name), sentencepiece.SentencePieceProcessor(model_file=f.name)
    ids, _, bounds = mine.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text)
    got = list(zip(bounds.tolist(), bounds.tolist()[1:], strict=False))
    assert got == offsets(lib, text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_compiled_map_against_the_library(rule, text):
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    spec = sentencepiece_model_pb2.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec
    mine = P.Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
    got, origin = mine.normalise(text.encode())
    assert got.decode() == lib.normalize(text)
    assert len(origin) == len(got) + 1 and (np.diff(origin) >= 0).all() and origin[-1] <= len(text.encode())


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = P.op4_pieces(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]] or ""
        ids = LIB.encode(text)
        assert r["n_tokens"] == len(ids) and r["span_bytes"] == len(text.encode())
        starts = [s for s, _ in offsets(LIB, text)] + [len(text.encode())]
        assert r["bounds_sha256"] == hashlib.sha256(np.array(starts, "<u4").tobytes()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "aé", "x"), (3, "aé", "x")], "doc_id long, text string, ids string")
    rows = sorted(P.encode_pieces(spark, df, PATH).collect(), key=lambda r: r["doc_id"])
    assert [r["decoded"] for r in rows] == ["", "", "aé", "aé"] and rows[0]["ids"] == [] and rows[2] == rows[3]
    assert rows[2]["ids"] == LIB.encode("aé") and rows[2]["ends"][-1] == 3
    assert P.encode_pieces(spark, df.limit(0), PATH).count() == 0
