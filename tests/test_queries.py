"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as E
from tests.compare import check
from tests.conftest import SF

Q, O = E.queries(), E.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, con, name):
    _, text, ok = check(spark, con, name, Q[name], O.get(name), SF)
    assert ok, text


def test_entry_has_rows(spark):
    assert E.entry(spark).count() > 0
