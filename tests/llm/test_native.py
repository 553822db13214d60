import io
import re
from contextlib import redirect_stdout

import pytest

from tessera.llm import queries

from ..conftest import SF


@pytest.mark.parametrize("name", ["op1_sharding", "op6_licences", "op9_secrets"])
def test_no_python_in_the_plan(spark, name):
    with redirect_stdout(out := io.StringIO()):
        queries.queries()[name](spark, SF).explain("formatted")
    assert not re.search("Python|Arrow|Pandas", out.getvalue())


def test_every_operator_has_a_query():
    names = queries.queries()
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")}) == list(range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
