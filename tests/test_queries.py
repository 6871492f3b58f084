"""Every registered query of the library's own operators against its SQL in DuckDB, on the smallest tables."""

import pytest

from gapline.plans import catalog

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    said = []
    bad = compare(spark, SF, catalog.queries(), catalog.oracle_sql(), [name], lambda *x: said.append(x))
    assert not bad, said


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    """Those without SQL give rows, the same ones twice, and no key twice; their rules are held against plain walks in test_operators."""
    key = {"rise_rule_events": ["series", "start"], "hard_bursts": ["series", "start"], "adaptive_bins": ["event", "start"], "power_law_fits": ["series"], "temperature_fits": ["series"]}
    sf = "/root/testdata/sf0.01" if name == "hard_bursts" else SF  # the smallest table has none
    rows = [sorted(map(str, catalog.queries()[name](spark, sf).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]
    if name in key:
        df = catalog.queries()[name](spark, sf)
        assert df.groupBy(*key[name]).count().where("count > 1").isEmpty()


def test_sql_is_for_known_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
