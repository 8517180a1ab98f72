import re

import pytest

from gridloom.llm import registry
from tests.compare import connection, difference

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, DATA), connection(DATA), registry.ORACLES[name]) is None


def test_one_query_an_operator():
    numbers = [int(m[1]) for n in registry.QUERIES if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14))
    assert "pipeline" in registry.QUERIES


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    top = Path(registry.__file__).parents[1]
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "gridloom.llm" not in p.read_text()
