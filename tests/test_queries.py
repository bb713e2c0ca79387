"""Every registered query at the smallest scale, against its SQL where it has one."""

import pytest
from oracle import compare

from risklattice.plans import ORACLES, QUERIES

# Model fits take long; their properties are tested in test_models.py.
SLOW = ("M7", "M9", "M17", "M18", "M19", "M20")


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, key):
    assert compare(QUERIES[key](spark, sf), duck, ORACLES[key]) == ""


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if k not in ORACLES and not k.startswith(SLOW)))
def test_runs(spark, sf, key):
    df = QUERIES[key](spark, sf)
    assert df.columns and df.count() >= 0
