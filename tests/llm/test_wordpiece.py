import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from tessera.llm import wordpiece as W
from tessera.llm.arrow import Words

from ..conftest import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")


def greedy(word, begin, rest):
    n, at = 0, 0
    while at < len(word):
        known = rest if at else begin
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_small_vocabularies():
    draw = random.Random(5)
    for _ in range(60):
        make = lambda: "".join(draw.choice("abé") for _ in range(draw.randint(1, 5)))
        begin, rest = {make() for _ in range(6)}, {make() for _ in range(6)}
        words = ["".join(draw.choice("abé") for _ in range(draw.randint(1, 12))) for _ in range(60)]
        got = W.Automaton(tuple(begin), tuple(rest)).count(Words([" ".join(words)]))
        assert list(got) == [greedy(w, begin, rest) for w in words]


def test_against_the_library():
    begin, rest = W.pieces(PATH)
    vocab = {p: i for i, p in enumerate(["[UNK]", *begin, *("##" + p for p in rest)])}
    library = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6))
    words = ["the", "unglaublich", "zzzzqqqq", "Straßenbahn!!", "\U0001f600x", "a" * 300, "naïve,", "(x)"]
    got = W.automaton(PATH).count(Words([" ".join(words)]))
    for w, n in zip(words, got, strict=True):
        ids = library.encode(w).ids
        assert (n == -1 and ids == [0]) or n == len(ids)


def test_query(spark):
    begin, rest = map(set, W.pieces(PATH))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in W.op5_token_counts(spark, SF).collect()}
    assert len(got) == len(docs)
    known = {}
    for d in docs[:60]:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n = [known.setdefault(w, greedy(w, begin, rest)) for w in words]
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(words), sum(max(x, 1) for x in n), n.count(-1))


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (1, "", "b"), (1, " \n", "c"), (None, "the the", "d")]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted(tuple(r) for r in W.count_tokens(spark, df, PATH).na.fill(-1).collect())
    assert got == sorted([(-1, 2, 2, 0), (1, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0)] if rows else [])


def test_long_words(spark):
    """Words of megabytes, beside many short ones; one dies at once, one near its end."""
    begin, rest = W.pieces(PATH)
    long = "ab" * 2_500_000
    words = [long, long + "\U0010ffff", "the", "x" * 300, "\U0010ffff" * 1000, "y" * 256, "z" * 257]
    got = W.automaton(PATH).count(Words([" ".join(words)])).tolist()
    short = {w: greedy(w, set(begin), set(rest)) for w in words[2:]}
    assert got[2:] == [short[w] for w in words[2:]] and got[1] == -1
    few = [greedy("ab" * k, set(begin), set(rest)) for k in (50, 100)]
    assert got[0] == few[0] + (few[1] - few[0]) * (2_500_000 - 50) // 50
