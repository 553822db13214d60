import random

import pytest

from tessera.llm import components
from tessera.llm import neardup as N
from tessera.llm.components import connected_components

from ..conftest import SF01
from .oracle import agree


def test_query_against_sql(spark):
    agree(spark, "op10_near_duplicates", SF01)


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    n = len(rows)
    link = [[i != j and bool(a) and len(a & b) >= 0.8 * len(a | b) - 1e-6 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            new = [j for j in range(n) if link[x][j] and j not in seen]
            seen.update(new)
            todo += new
        same = [rows[j][0] for j in range(n) if sets[j] == sets[i] and sets[i]] or [rows[i][0]]
        ids = lambda v: min((x for x in v if x is not None), default=None)
        out.append((rows[i][0], ids([rows[j][0] for j in seen]), sum(link[i]), ids(same)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2, 9, 256])
def test_groups_and_edges(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "DIRECT", 1 if block == 9 else 2)
    draw = random.Random(3)
    base = [draw.choice("abcdefghijklmnop") + str(draw.randint(0, 99)) for _ in range(150)]
    rows = []
    for k in range(25):
        w = list(base)
        for _ in range(draw.randint(0, 3)):
            w[draw.randrange(150)] = "new%d" % draw.randint(0, 5)
        rows.append((100 + k, " ".join(w)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "one three"), (None, " ".join(base)), (None, "one two"), (None, "alone here"), (7, rows[0][1].upper())]
    rows += [(200 + k, " ".join(draw.choice("xyz") + str(draw.randint(0, 999)) for _ in range(30))) for k in range(5)]
    rows += [(300, rows[0][1]), (300, "another text under that key"), (300, "another text under that key")]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, class_id int")
    assert sorted((tuple(r) for r in N.near_duplicates(spark, df).collect()), key=repr) == brute(rows)


def brute_links(rows):
    return sorted(((k, c, n) for k, c, n, _ in brute(rows)), key=repr)


def test_chains_that_are_half_alike_cost_no_square(spark, monkeypatch):
    """Documents that each share three quarters with the next: one component of ties, hardly any links."""
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "DIRECT", 2)
    words = [f"w{i}" for i in range(4 * 1500 + 40)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 36])) for i in range(1500)] + [(2000 + i, " ".join(words[4 * i : 4 * i + 37])) for i in range(0, 1500, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    kept_groups = N._groups_of
    monkeypatch.setattr(N, "_groups_of", lambda *a: made.append(kept_groups(*a)) or made[-1])
    monkeypatch.setattr(N, "forget", lambda df: None)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in N.near_duplicates(spark, df).collect()), key=repr)
    assert got == brute_links(rows)
    sizes = [r["count"] for r in made[0][0].groupBy(*N.GROUP).count().collect()]
    assert max(sizes) <= 2 * 16 * 2 and sum(s * s for s in sizes) < 42 * 16 * len(rows) and sum(sizes) > len(rows)


@pytest.mark.parametrize("direct", [1, 16])
def test_a_large_group_of_copies_and_one_of_near_copies(spark, monkeypatch, direct):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "DIRECT", direct)
    draw = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)] + [(None, "  "), (None, None), (7, "")] * 20
    for k in range(150):
        w = list(base)
        for _ in range(draw.randint(0, 5)):
            w[draw.randrange(120)] = f"n{draw.randint(0, 50)}"
        rows.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in N.near_duplicates(spark, df).collect()), key=repr) == brute(rows)


def test_keys_of_any_type(spark):
    rows = [("b", 2, "one two three"), ("a", 9, "One two three"), ("c", 1, "else")]
    df = spark.createDataFrame(rows, "x string, y long, text string").selectExpr("struct(x, y) as id", "text")
    got = sorted(tuple(map(tuple, (r["id"], r["class_id"], r["set_id"]))) + (r["n_links"],) for r in N.near_duplicates(spark, df, "id").collect())
    assert got == [(("a", 9), ("a", 9), ("a", 9), 1), (("b", 2), ("a", 9), ("a", 9), 1), (("c", 1), ("c", 1), ("c", 1), 0)]


def test_no_rows(spark):
    assert N.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_reach_the_recall():
    b = N.bands_for(0.8, 8, 0.9995)
    assert 1 - (1 - 0.8**8) ** b >= 0.9995 > 1 - (1 - 0.8**8) ** (b - 1)


@pytest.mark.parametrize("hot", [2, 4096])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT", hot)
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + draw.randint(0, 60), 100 + draw.randint(0, 60)) for _ in range(45)] + [(300, 300), (None, 5)] + [(500, 501 + i) for i in range(200)] + [(900 - i, 990) for i in range(150)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = dict(connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: root(x) for x in parent}
