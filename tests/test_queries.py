"""Every registered query with SQL gives the rows of that SQL; the others run and have a stable schema."""

import pytest

import __spark_entry__ as entry
from compare import compare


def own(names):
    """Queries of the llm package are tested in tests/llm."""
    import re

    return [n for n in names if not re.match(r"p(1|2|3|4|6|8|9|10)_", n)]


@pytest.mark.parametrize("name", own(entry.oracle_sql()))
def test_same_as_sql(spark, data, name):
    assert compare(spark, data, [name], entry.queries(), entry.oracle_sql()) == []


@pytest.mark.parametrize("name", [n for n in own(entry.queries()) if n not in entry.oracle_sql() and not n.startswith(("train_", "cv_", "final_", "predict_", "parity_"))])
def test_runs(spark, data, name):
    a, b = (entry.queries()[name](spark, data) for _ in range(2))
    assert a.schema == b.schema and a.count() == b.count()


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
