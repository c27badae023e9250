"""Every query against its DuckDB counterpart, at the smallest scale."""

from __future__ import annotations

import pytest

from lodestone.plans import catalog
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sf, name):
    assert difference(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0
