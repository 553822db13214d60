import random
from itertools import combinations

from tessera.llm import decontam as D

from ..conftest import SF01
from .oracle import agree


def test_no_window_escapes_the_masks():
    for wrong in combinations(range(D.WINDOW), D.WINDOW - D.NEED):
        assert any(all(o + i not in wrong for i, c in enumerate(m) if c == "1") for m in D.MASKS for o in range(D.WINDOW - len(m) + 1)), wrong
    assert {m.count("1") for m in D.MASKS} == {D.WEIGHT}


def test_query_against_sql(spark):
    agree(spark, "op7_decontamination", SF01)


def brute(docs, items):
    import re

    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for k, t in docs:
        a = cut(t)
        for i, s in items:
            b = cut(s)
            if len(b) < D.WEIGHT:
                if b and any(cut(line) == b for line in (t or "").split("\n")):
                    out[k, i] = len(b)
                continue
            for d in range(-len(b), len(a)):
                hit = [q for q in range(len(b)) if 0 <= q + d < len(a) and a[q + d] == b[q]]
                best = max((sum(q <= x < q + D.WINDOW for x in hit) for q in hit), default=0)
                if best >= min(D.NEED, len(b)):
                    out[k, i] = max(out.get((k, i), 0), best)
    return sorted(((*p, m) for p, m in out.items()), key=repr)


def test_substitutions_and_edges(spark):
    draw = random.Random(4)
    word = lambda: draw.choice("abcdefgh") + str(draw.randint(0, 30))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 14, 13, 12, 10, 9, 7, 6, 5, 2])] + [(20, None), (21, ""), (0, "one two three four five six seven")]
    docs = [(1, None), (2, ""), (3, "one, TWO! three_four five six seven")]
    for k in range(60):
        w = draw.choice(items[:9])[1].split()
        for _ in range(draw.randint(0, 5)):
            w[draw.randrange(len(w))] = word()
        docs.append((10 + k // 2, " ".join([*(word() for _ in range(draw.randint(0, 20))), *w, *(word() for _ in range(draw.randint(0, 20)))])))
    docs.append((None, items[0][1].upper()))
    docs += [(90, f"some text\n- {items[8][1].upper()}!\nmore"), (91, f"before {items[8][1]}"), (92, items[9][1]), (92, items[9][1]), (93, f"{items[9][1]} \n{items[9][1]}")]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    assert sorted((tuple(r) for r in D.leaks(spark, df, it).collect()), key=repr) == brute(docs, items)
    assert D.leaks(spark, df.limit(0), it).count() == 0 and D.leaks(spark, df, it.limit(0)).count() == 0


def test_a_passage_repeated_a_hundred_thousand_times(spark):
    """Ten megabytes of one passage: equal surroundings are looked up once."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    df = spark.createDataFrame([(1, f"{item} " * 130_000), (2, "xi omicron " * 500_000)], "doc_id long, text string")
    it = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [tuple(r) for r in D.leaks(spark, df, it).collect()] == [(1, 5, 13)]


def test_keys_of_any_type(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    df = spark.createDataFrame([(1, "x", item), (1, "y", "clean"), (None, "z", item)], "a long, b string, text string").selectExpr("struct(a, b) as id", "text")
    it = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted(r["id"]["b"] for r in D.leaks(spark, df, it, key="id").collect()) == ["x", "z"]
