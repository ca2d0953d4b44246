"""Every registered query of the engine against its DuckDB oracle."""

import pytest
from conftest import SF, rows_of

from voxtide.plans import catalog, extended


assert extended.register is catalog.register  # its queries are in the same table


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_rules_fire_on_some_lines(spark):
    lines = catalog.QUERIES["mask_pii"](spark, SF).count()
    for rule in ("length_band", "prefix_len", "or_keywords", "and_keywords", "keywords_len", "include_exclude"):
        assert 0 < catalog.QUERIES[rule](spark, SF).count() < lines


def test_verdicts(spark):
    counts = {r["verdict"]: r["count"] for r in catalog.dynamic_baseline(spark, SF).groupBy("verdict").count().collect()}
    assert counts == {"below_static": 1221, "below_dynamic": 1108, "alert": 196}
