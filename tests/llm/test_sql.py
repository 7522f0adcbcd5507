"""Queries that SQL can express, against it."""

import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check_oracle import compare, duck  # noqa: E402

from scoreloom.llm.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    status, rows, _, note = compare(spark, duck(SF), SimpleNamespace(run=QUERIES[name], sql=SQL[name]), SF)
    assert status == "ok" and rows == 200 and "TYPES" not in note, note


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
