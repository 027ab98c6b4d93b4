"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
import check

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")

# Fitting is covered on small rows in test_datasets.py.
NAMES = [n for n in entry_points.queries() if not n.startswith("student_")]


@pytest.fixture(scope="module")
def duck():
    return check.duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    line = check.compare(spark, duck, SF_DIR, name)
    assert not line.startswith("FAIL"), line


def test_entry(spark):
    assert entry_points.entry(spark).columns[0] == "task_id"


def test_sql_only_for_known_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
