"""Schemas that widen from batch to batch: every row stays, misfits with their text, replays change nothing."""

import json
from pathlib import Path

import pytest

from tableops.sources import evolving as E
from tableops.workdir import work_dir


@pytest.fixture
def feed(spark):
    """(put lines into a new file, ingest what is new, table)."""
    src, table, state = (Path(work_dir(spark, n)) for n in ("lines", "evolving", "state"))
    src.mkdir(parents=True)
    count = iter(range(100))

    def put(*lines):
        (src / f"{next(count)}.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    return put, lambda checkpoint=str(state), **more: E.ingest_evolving(spark, str(src), str(table), checkpoint, **more), str(table)


def _rows(spark, table):
    return sorted((r.asDict() for r in E.read_evolving(spark, table).collect()), key=str)


def _schema(spark, table, version):
    return {r.field: r.type for r in E.schema_versions(spark, table).where(f"version = {version}").collect()}


def test_new_field_and_wider_type(spark, feed):
    put, ingest, table = feed
    put({"id": 1, "v": 7}, {"id": 2, "v": None, "w": None}, "")
    ingest()
    put({"id": 3, "v": 1.5, "name": "x"}, {"id": "four", "v": 2, "more": {"a": [1]}})
    ingest()
    put({"id": "5"})
    ingest()
    ingest()
    assert [r for r in _rows(spark, table)] == sorted(
        [
            {"id": "1", "v": 7.0, "more": None, "name": None, "_rescued": None},
            {"id": "2", "v": None, "more": None, "name": None, "_rescued": None},
            {"id": "3", "v": 1.5, "more": None, "name": "x", "_rescued": None},
            {"id": "four", "v": 2.0, "more": '{"a":[1]}', "name": None, "_rescued": None},
            {"id": "5", "v": None, "more": None, "name": None, "_rescued": None},
        ],
        key=str,
    )
    assert _schema(spark, table, 1) == {"id": "bigint", "v": "bigint"}
    assert _schema(spark, table, 2) == {"id": "string", "v": "double", "more": "string", "name": "string"} and not _schema(spark, table, 3)


def test_hints_and_rescue(spark, feed):
    put, ingest, table = feed
    lines = ['{"id": 1, "at": "2024-02-01", "d": 1.25}', '{"id": "x", "at": "2024-02-02"}', "no json", "[1]", '{"id": 2, "ID": 3}', '{"id": 3, "_rescued": "own"}']
    put(*lines)
    ingest(hints={"id": "int", "at": "date", "d": "decimal(10,2)"})
    got = {r["_rescued"] or r["id"]: r for r in _rows(spark, table)}
    assert set(got) == {1, *lines[1:]}
    assert str(got[1]["at"]) == "2024-02-01" and str(got[1]["d"]) == "1.25"
    assert got[lines[1]]["id"] is None and str(got[lines[1]]["at"]) == "2024-02-02"
    assert got[lines[5]]["id"] == 3


def test_empty_and_odd_batches(spark, feed):
    put, ingest, table = feed
    put("", "  ")
    ingest()
    assert _rows(spark, table) == []
    put("{}", {"a.b": True, "sp ace": "é"})
    ingest()
    assert len(_rows(spark, table)) == 2 and {"a.b": True, "sp ace": "é", "_rescued": None} in _rows(spark, table)


def test_replayed_batches_change_nothing(spark, feed):
    """A new checkpoint replays all files: batches write the same folders again."""
    put, ingest, table = feed
    put({"id": 1})
    put({"id": 2, "b": 1})
    ingest(max_files=1)
    before, versions = _rows(spark, table), sorted(map(tuple, E.schema_versions(spark, table).collect()))
    ingest(max_files=1, checkpoint=work_dir(spark, "again"))
    assert _rows(spark, table) == before and sorted(map(tuple, E.schema_versions(spark, table).collect())) == versions

