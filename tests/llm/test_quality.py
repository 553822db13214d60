import random
import tracemalloc

import numpy as np
import pytest

from tessera.llm import quality as Q
from tessera.llm.arrow import Words

from ..conftest import SF01
from .oracle import agree


def arrays(texts):
    w = Words(texts)
    return w, Q.SuffixArray(w.hashes(), w.doc, w.first)


def random_texts(seed, n=12):
    draw = random.Random(seed)
    return [" ".join(draw.choice("ab" if draw.random() < 0.9 else "cde") for _ in range(draw.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_longest_repeat_from_each_word(seed):
    texts = random_texts(seed) + ["a " * 40, "", "x y z"]
    w, array = arrays(texts)
    deepest = array.deepest()
    for d, t in enumerate(texts):
        words = t.split()
        for i in range(len(words)):
            want = max((next((k for k in range(len(words)) if max(i, j) + k >= len(words) or words[i + k] != words[j + k]), 0) for j in range(len(words)) if j != i), default=0)
            assert deepest[w.first[d] + i] == want


@pytest.mark.parametrize("seed", range(5))
def test_intervals_cover_what_the_deepest_cover(seed):
    texts = random_texts(seed, 1)
    w, array = arrays(texts)
    n, want = len(w.start), set()
    for length, s, e in array.intervals(3):
        for i in array.order[s:e]:
            want |= set(range(i, i + length))
    got = Q.covered(array.deepest(), 3, np.full(n, n))
    assert set(np.flatnonzero(got)) == want
    assert want == {p for length, spans in Q.repeats(texts[0], 3) for s, e in spans for p in range(n) if s <= w.start[p] and w.end[p] <= e}


def test_repeats_are_maximal():
    text = "one two three four x one two three four y two three"
    assert [(n, [text[s:e] for s, e in spans]) for n, spans in Q.repeats(text, 2)] == [(4, ["one two three four"] * 2), (2, ["two three"] * 3)]


def test_query_against_sql(spark):
    agree(spark, "op3_quality", SF01)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\x0b", "x"), (4, "é&é", "x"), (None, "a b " * 30, "x"), (5, " ".join(map(str, range(60))), "x"), (5, " ".join(map(str, range(60))), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["base_failed"], r["kept"]) for r in Q.quality_rules(spark, df).collect())
    assert got == [(0, 60, 60, 0, True, False), (1, 0, 0, 0, True, False), (2, 0, 0, 0, True, False), (3, 0, 0, 0, True, False), (4, 1, 3, 1, True, False), (5, 60, 110, 0, False, True), (5, 60, 110, 0, False, True)]
    assert Q.quality_rules(spark, df.limit(0)).count() == 0


def test_a_long_repeat_is_rejected():
    words = [f"w{i}" for i in range(1000)]
    m = Q.measure([" ".join(words), " ".join(words + words[:101]), " ".join(words + words[:100]), " ".join(words[:100] + words[:20] + words[:20] + words[:20] + words[:20])])
    assert list(m["kept"]) == [True, False, True, False]
    assert list(m["long_repeat"]) == [False, True, False, False]


def test_ten_megabytes_of_one_word():
    """Memory follows the text, not what it repeats: eight arrays of ranks at most."""
    text = "same word " * 1_000_000
    tracemalloc.start()
    got = Q.measure([text, "a b c"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["n_words"].tolist() == [2_000_000, 3] and got["n_covered_words"].tolist() == [2_000_000, 0] and got["long_repeat"].tolist() == [True, False]
    assert got["n_repeat_words"].tolist() == [2_000_000, 0] and peak < 500e6, peak


@pytest.mark.parametrize("seed", range(4))
def test_a_bounded_depth_gives_the_same_verdicts(seed):
    draw = random.Random(seed)
    words = [draw.choice("abc") for _ in range(60)]
    text = " ".join(words + ["x"] + words * draw.randint(1, 4) + words[: draw.randint(0, 50)])
    w = Words([text, "a b " * 80])
    h = w.hashes()
    full, some = (Q.SuffixArray(h, w.doc, w.first, d).deepest() for d in (None, Q.MAX_REPEAT + 1))
    assert (np.minimum(full, 128) == np.minimum(some, 128)).all() and (some <= full).all()
    end = w.first[1:][w.doc]
    assert (Q.covered(full, 10, end) == Q.covered(some, 10, end)).all()
