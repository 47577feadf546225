"""Size-tiered compaction: whole rows, tiers, atomic versions and recovery."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.llm import sharding as sh
from lodestar.llm.queries import QUERIES


def rows(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.repeat(F.md5(F.col("id").cast("string")), 40)).alias("text"), F.lit("x").alias("shard"))


def test_append_compact_vacuum(spark, tmp_path):
    store = sh.ShardStore(spark, str(tmp_path / "s"), target=60_000, fanout=3, base=1_000)
    for k in range(5):
        assert store.append(rows(spark, 100 * k, 100 * k + 100).repartition(4)) == k + 1
    before = store.manifest()[1]
    assert len(before) == 5 and sum(r.files for r in before) == 20
    version = store.compact()
    after = store.manifest()[1]
    assert version > 5 and len(after) < 5 and sum(r.files for r in after) < 10 and sum(r.rows for r in after) == 500
    got = store.read()
    assert not store.due(after) and all(r.shard_bytes <= 1.5 * 60_000 for r in got.select("shard_bytes").distinct().collect())
    assert got.columns == ["doc_id", "text", "shard", "shard_bytes", "version"]
    want = rows(spark, 0, 500).select("doc_id", "text")
    assert got.select("doc_id", "text").exceptAll(want).count() == 0 == want.exceptAll(got.select("doc_id", "text")).count()
    assert got.select("shard").distinct().count() == sum(r.files for r in after)
    assert store.read(5).count() == 500  # the old version reads until vacuum
    (tmp_path / "s" / "data" / "m-lost").mkdir()
    (tmp_path / "s" / "data" / "m-lost" / "part.parquet").write_bytes(b"a failed attempt's")
    assert store.vacuum() >= 6
    assert store.read().count() == 500 and store.version() == version
    assert not (tmp_path / "s" / "data" / "m-lost").exists()


def test_tiers(spark, tmp_path):
    store = sh.ShardStore(spark, str(tmp_path / "s"), target=1000, fanout=2, base=10)
    run = lambda name, files, size: sh.Run(name, files, files, files * size)
    assert [store.tier(run("r", 3, size)) for size in (1, 19, 20, 79, 499, 500, 900)] == [0, 0, 1, 2, 5, -1, -1]
    assert store.due([run("a", 1, 15), run("b", 9, 25), run("c", 2, 800), run("d", 2, 900)]) == []
    assert [r.name for r in store.due([run("a", 1, 15), run("b", 9, 25), run("c", 2, 30), run("d", 9, 12)])] == ["a", "d"]


def test_conflict(spark, tmp_path):
    one = sh.ShardStore(spark, str(tmp_path / "s"))
    one.append(rows(spark, 0, 10))
    schema, runs = one.manifest()
    two = sh.ShardStore(spark, str(tmp_path / "s"))
    assert two.commit(1, schema, runs) == 2
    with pytest.raises(sh.Conflict):
        one.commit(1, schema, [])
    assert len(one.manifest()[1]) == len(runs) and one.version() == 2
    names = [p.name for p in (tmp_path / "s" / "_manifests").iterdir() if not p.name.startswith(".")]
    assert sorted(names) == ["v00000001.json", "v00000002.json"]
    assert json.loads((tmp_path / "s" / "_manifests" / "v00000002.json").read_text())["version"] == 2
    with pytest.raises(ValueError, match="columns"):
        one.append(spark.range(3))


@pytest.mark.parametrize("arrivals", [1, 3])
def test_shard_keeps_every_row(spark, arrivals):
    docs = rows(spark, 0, 50).unionAll(rows(spark, 0, 5)).unionAll(spark.createDataFrame([(None, "", None)], "doc_id long, text string, shard string"))
    got = sh.shard(docs, arrivals=arrivals, target=2_000, fanout=2)
    assert got.count() == 56
    a, b = got.select("doc_id", "text"), docs.select("doc_id", "text")
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    assert sh.shard(docs.limit(0), arrivals).collect() == []


@pytest.mark.parametrize("parts", [1, 6])
def test_query_merges_its_arrivals(spark, tmp_path, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op10_sharding"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    assert {r.version for r in got} == {sh.ARRIVALS + 1}
    assert len({r.shard for r in got}) == 1 and len({r.shard_bytes for r in got}) == 1
