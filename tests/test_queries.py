"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from gridloom.queries import ORACLES, QUERIES


#: Of the runs on packed words a few; the others are compared with the rules' own evaluation in test_engine.
PACKED = [f"ca_{a}_{layout}_t2" for a, layout in (("critters", "planes"), ("forest_fire", "planes"), ("critters", "tiled"), ("traffic", "bit_array"), ("brian", "tiled"), ("cyclic", "bit_array"), ("wire", "blocked"), ("critters", "blocked"))]


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES and not (n.startswith("ca_") and n.endswith(("_planes_t2", "_tiled_t2", "_bit_array_t2", "_blocked_t2")) and n not in PACKED)])
def test_query_equals_its_sql(spark, sf_dir, duck, collected, name):
    assert collected(QUERIES[name](spark, sf_dir)) == duck(ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["x", "y", "s"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
