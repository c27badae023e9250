"""The subpackage's queries against their DuckDB counterparts."""

from __future__ import annotations

import pytest

from lodestone.llm.queries import ORACLES, QUERIES
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, name):
    assert difference(spark, QUERIES[name], ORACLES[name], sf) is None
