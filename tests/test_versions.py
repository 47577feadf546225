"""Versioned tables: changes against plain dictionaries, crashes, conflicts and readers of old versions."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import matching as M
from lodestar.sources.versions import Conflict, VersionedTable

SCHEMA = "id long, name string, extra string"


@pytest.fixture
def made(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=4)
    table.overwrite(spark.createDataFrame([(k, f"old{k}", '{"o":1}') for k in range(40)], SCHEMA), why="first")
    return table


def rows_of(table, version=None):
    return {r.id: (r.name, r.extra) for r in table.read(version).collect()}


def test_changes(spark, made):
    want = rows_of(made)
    new = [(k, f"new{k}", None if k % 2 else '{"n":1}') for k in range(0, 60, 7)] + [(None, "no id", "{}")]
    assert made.upsert(spark.createDataFrame(new, SCHEMA), ["extra"]) == 2
    want |= {k: (name, extra or want.get(k, (0, None))[1]) for k, name, extra in new}
    assert rows_of(made) == want and len(rows_of(made, 1)) == 40
    assert made.append(spark.createDataFrame([(1, "again", "x"), (100, "b", "x"), (100, "a", "x")], SCHEMA), "name") == 3
    want[100] = ("a", "x")
    assert rows_of(made) == want
    assert made.append(spark.createDataFrame([(100, "late", "x")], SCHEMA)) == 4 and rows_of(made) == want
    assert made.update(lambda rows: rows.where("id >= 20")) == 5
    assert rows_of(made) == {k: v for k, v in want.items() if k is not None and k >= 20}
    assert made.manifest(1)["notes"] == {"why": "first"}


def test_other_buckets_keep_their_files(spark, made):
    before = made.manifest()["buckets"]
    made.upsert(spark.createDataFrame([(3, "x", "y")], SCHEMA))
    after = made.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_children(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "c"), ["parent", "n"], ["parent"], 3)
    table.replace_children(spark.createDataFrame([(p, n) for p in range(6) for n in range(3)], "parent long, n long"))
    table.replace_children(spark.createDataFrame([(1, 9), (50, 0)], "parent long, n long"))
    got = sorted(map(tuple, table.read().collect()))
    assert got == sorted([(p, n) for p in (0, 2, 3, 4, 5) for n in range(3)] + [(1, 9), (50, 0)])
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "d"), ["a"], ["b"])


def test_a_crash_leaves_the_old_version(spark, made, monkeypatch):
    before, reader = rows_of(made), made.read()
    monkeypatch.setattr(made, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost before the commit")))
    with pytest.raises(RuntimeError):
        made.upsert(spark.createDataFrame([(k, "new", "") for k in range(40)], SCHEMA))
    monkeypatch.undo()
    assert made.version() == 1 and rows_of(made) == before
    # Nor does a task that fails while it writes.
    broken = spark.createDataFrame([(1, "x", "y")], SCHEMA).withColumn("name", F.raise_error(F.lit("lost while writing")).cast("string"))
    with pytest.raises(Exception, match="lost while writing"):
        made.upsert(broken)
    assert rows_of(made) == before
    made.upsert(spark.createDataFrame([(1, "after", "")], SCHEMA))
    assert rows_of(made)[1] == ("after", "") and {r.id: (r.name, r.extra) for r in reader.collect()} == before
    assert made.vacuum(1) >= 3 and rows_of(made)[1] == ("after", "") and made.version() == 2


def test_two_writers_one_conflict(spark, made, monkeypatch):
    other = VersionedTable(spark, made.root, ["id"], buckets=4)
    first = made._write

    def slow(rows):
        out = first(rows)
        monkeypatch.undo()
        other.upsert(spark.createDataFrame([(1, "other", "")], SCHEMA))
        return out

    monkeypatch.setattr(made, "_write", slow)
    with pytest.raises(Conflict):
        made.upsert(spark.createDataFrame([(1, "mine", "")], SCHEMA))
    assert made.version() == 2 and rows_of(made)[1] == ("other", "")
    assert made.upsert(spark.createDataFrame([(1, "mine", "")], SCHEMA)) == 3 and rows_of(made)[1] == ("mine", "")


def test_keys_are_unique(spark, made):
    twice = spark.createDataFrame([(1, "a", ""), (1, "b", "")], SCHEMA)
    for change in (made.upsert, made.overwrite):
        with pytest.raises(ValueError):
            change(twice)
    assert made.version() == 1


def test_empty(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "e"), ["id"])
    with pytest.raises(ValueError):
        table.read()
    table.overwrite(spark.createDataFrame([], SCHEMA))
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([], SCHEMA))
    assert table.version() == 2 and table.read().count() == 0


def test_snapshots_by_probe(spark, tmp_path):
    store, loads = VersionedTable(spark, str(tmp_path / "s"), ["id"]), []

    def load(name):
        loads.append(name)
        return spark.createDataFrame([(1, name, "")], SCHEMA)

    probe = lambda n: spark.createDataFrame([(n, None)], "n int, newest date")
    old = M.snapshot(store, probe(1), lambda: load("a"))
    assert M.snapshot(store, probe(1), lambda: load("b")).first()["name"] == "a"
    assert M.snapshot(store, probe(2), lambda: load("c")).first()["name"] == "c" and old.first()["name"] == "a" and loads == ["a", "c"]

    def beaten():
        VersionedTable(spark, store.root, ["id"]).overwrite(spark.createDataFrame([(1, "faster", "")], SCHEMA), probe=store_probe)
        return load("late")

    store_probe = probe(3).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]
    slow = VersionedTable(spark, store.root, ["id"])
    version = store.version()
    slow.version = lambda calls=[version, version]: calls.pop() if calls else VersionedTable(spark, store.root, ["id"]).version()
    assert M.snapshot(slow, probe(3), beaten).first()["name"] == "faster" and store.version() == version + 1
