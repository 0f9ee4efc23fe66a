"""Shared steps go to the folder that the session names, and are deleted on request."""

from pathlib import Path

import pytest

from foldloom.operators.periods import periods_and_gaps
from foldloom.scratch import cut, shared_folder, workspace

ROWS = [("P1", 1, 5), ("P1", 4, 9), ("P1", 12, 20), ("P2", 3, 3)]
FOUND = [("P1", "gap", 10, 11), ("P1", "period", 1, 9), ("P1", "period", 12, 20), ("P2", "period", 3, 3)]


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    kind = type(spark.conf)
    get = kind.get
    named = lambda self, key, *default: f"file://{tmp_path}" if key == "spark.checkpoint.dir" else get(self, key, *default)
    monkeypatch.setattr(kind, "get", named)  # a running session doesn't take another one
    return tmp_path


def _files(folder: Path) -> list[Path]:
    return list(folder.rglob("*.parquet"))


def test_steps_lie_in_the_named_folder(spark, shared):
    assert shared_folder(spark) == f"file://{shared}"
    df = spark.createDataFrame(ROWS, "id string, s bigint, e bigint")
    with workspace(spark):
        found = periods_and_gaps(df, "id", "s", "e")
        assert _files(shared)
        assert sorted(map(tuple, found.collect())) == FOUND
    assert not _files(shared)


def test_inner_workspaces_keep_the_tables_of_outer_ones(spark, shared):
    with workspace(spark):
        outer = cut(spark.range(3))
        with workspace(spark):
            assert cut(spark.range(2)).count() == 2
        assert outer.count() == 3
    assert not _files(shared)
