"""Each registered query of the engine against its SQL, on the smallest tables."""

import pytest
from compare import assert_same

from trovesift import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, data, name):
    assert_same(catalog.queries()[name](spark, data), catalog.oracle_sql()[name], data)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, data, name):
    out = catalog.queries()[name](spark, data)
    assert len(out.collect()) > 0 and out.columns


def test_coalescing_takes_all_events(spark, data):
    rows = catalog.queries()["coalesce_events"](spark, data).collect()
    assert sum(r.n_events for r in rows) == spark.read.parquet(f"{data}/events.parquet").count() and len({r.kind for r in rows}) == 4
