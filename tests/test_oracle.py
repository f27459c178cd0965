"""Every registered query against its DuckDB oracle (the driver's gate), at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tests.oracle_compare import compare


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["bucket_start", "bucket_end", "symbol", "scenario"]


NAMES = sorted(set(E.queries()) - set(E.LLM_QUERIES))


def test_every_query_has_an_oracle():
    assert set(E.oracle_sql()) - set(E.LLM_SQL) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    rec = compare(spark, SF001, [name], verbose=False, pandas=True)[name]
    assert "error" not in rec, rec.get("error")
    assert rec["rows"] == rec["oracle_rows"], rec
    assert rec["columns_match"], rec
    assert rec["values_match"], rec
    assert rec["pandas_match"], rec
