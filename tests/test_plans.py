import pytest
from oracle import SAME_TYPES, compare, connect

import __spark_entry__ as entry
from plumbline.plans import REGISTRY


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.oracle))
def test_query_equals_duckdb(spark, duck, sf_dir, name):
    types = compare(REGISTRY[name].run(spark, sf_dir), duck, REGISTRY[name].oracle)
    assert all(SAME_TYPES.get(a) == b for a, b in types.values()), types


def test_every_query_has_an_oracle():
    assert [n for n, q in REGISTRY.items() if not q.oracle] == []


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
