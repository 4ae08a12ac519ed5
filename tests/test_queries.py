import pytest
from conftest import same

from fiscalis import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    same(spark, catalogue.queries()[name], SQL[name], data)


def test_greedy_pairs_use_each_box_once(spark, data):
    rows = catalogue.queries()["geo_greedy_match"](spark, data).collect()
    for side in ("a", "b"):
        used = [(r["page"], r[side]) for r in rows]
        assert len(used) == len(set(used))


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
