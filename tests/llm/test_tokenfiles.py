import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import tokenfiles as T
from tessera.sources.shared import shared_folder

from ..conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


@given(st.lists(st.integers(0, 1 << 50) | st.integers(0, 40), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    ef, size = T.EliasFano.from_bytes(memoryview(T.EliasFano.of(values).to_bytes() + b"rest"))
    assert size == ef.nbytes() and list(ef) == values
    assert [ef.select(i) for i in range(len(values))] == values


def test_near_minimal_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 900, 20_000))
    assert T.EliasFano.of(ends).nbytes() * 8 / len(ends) < 2.3 + np.log2(ends[-1] / len(ends))


@given(st.text(st.sampled_from("ab'sé12 \n\t,.\x1c\x85\xa0     　\U0001f600\0"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_chunks_give_the_ids_of_the_whole(text):
    got = np.frombuffer(T.encoder(PATH).encode([text])[0], "<u4").tolist()
    assert got == LIB.encode(text, add_special_tokens=False).ids


def brute(rows):
    at, out = 0, []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), r[1] or "")):
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in T.op2_token_files(spark, SF).collect()) == brute(rows)


@pytest.mark.parametrize("n", [0, 40])
def test_edges(spark, n):
    draw = random.Random(2)
    rows = [(draw.choice([None, 7, -3, 1 << 60]), draw.choice([None, "", "a b", "x" * 5000, "a  b"]), "n") for _ in range(n)]
    out = shared_folder(spark, "t")
    T.write_tokens(spark, spark.createDataFrame(rows, "doc_id long, text string, k string"), out, PATH, 0, segment_ids=50)
    order = lambda r: (r[1],)
    assert sorted((tuple(r) for r in T.read_tokens(spark, out).collect()), key=order) == brute([r[:2] for r in rows])


def test_a_segment_reads_single_documents():
    docs = [[5, 6], [], [70_000, 1, 2]]
    s = T.Segment(T.write_segment([np.array(d, "<u4").tobytes() for d in docs], [-5, -5, 9], 4))
    assert [s.ids(i).tolist() for i in range(3)] == docs and [s.key(i) for i in range(3)] == [-5, -5, 9]
    assert [(k, at) for k, at, _ in s.documents()] == [(-5, 0), (-5, 2), (9, 2)]
