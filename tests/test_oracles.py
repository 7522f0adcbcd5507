"""Every registered query against its SQL on the small tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_oracle import compare, duck  # noqa: E402

from scoreloom.catalog.all import CATALOG  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_sql(spark, con, name):
    status, rows, _, note = compare(spark, con, CATALOG[name], SF)
    assert status in ("ok", "ok-EMPTY", "rows-only"), note
    assert "TYPES" not in note, note
    if status == "rows-only":
        assert rows > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 4
