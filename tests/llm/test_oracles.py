"""Queries of this package against their SQL counterparts."""

from __future__ import annotations

import pytest

from gleaner.llm import queries
from tests.compare import connect, difference


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    text, rows = difference(spark, connect(sf_dir), queries.queries()[name], queries.oracle_sql()[name], sf_dir)
    assert text == "" and rows > 0
