import zlib

import numpy as np

from tessera.llm import language as L

from ..conftest import SF01


def plain(text):
    """The bundle of one text, sequence by sequence."""
    s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    while "  " in s:
        s = s.replace("  ", " ")
    out = np.zeros(L.DIMENSIONS)
    grams = [s[i : i + L.N] for i in range(len(s) - L.N + 1)]
    for g in grams:
        v = np.ones(L.DIMENSIONS)
        for i, c in enumerate(reversed(g)):
            v *= np.roll(L.letter(ord(c)), i)
        out += v
    return out / max(1, len(grams))


def test_bundles_against_sequence_by_sequence(monkeypatch):
    texts = ["Hello, World", "", "...", "éèê über", "日本語 テキスト", "a", "x1y2 z", "the " * 50]
    for cells in (1 << 22, 3):
        monkeypatch.setattr(L, "CELLS", cells)
        got = np.concatenate([b for _, b, _ in L.bundles(texts)])
        has = np.concatenate([h for _, _, h in L.bundles(texts)])
        assert list(has) == [True, False, False, True, True, True, True, True]
        for i, t in enumerate(texts):
            if has[i]:
                assert np.allclose(got[i], plain(t), atol=1e-4), t


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = L.op8_language(spark, SF01).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) / len(out)
    print("held out", len(out), right, [(r["doc_id"], r["lang_pred"], truth[r["doc_id"]], r["score"]) for r in out if r["lang_pred"] != truth[r["doc_id"]]][:20])
    assert right > 0.98


def test_edges(spark):
    rows = [(1, "the house", "en", "q"), (2, "das Haus", "de", "q"), (3, None, "en", "q"), (4, "12 !", "de", "q"), (5, "xyz", None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    names, p = L.learn(spark, df)
    assert names == ["de", "en"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(spark, df, names, p).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == ("und", 0.0)
    names, p = L.learn(spark, df.limit(0))
    assert {r["lang_pred"] for r in L.predict(spark, df, names, p).collect()} == {"und"}
    assert L.predict(spark, df.limit(0), names, p).count() == 0
