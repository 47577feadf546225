"""Streaming variants against their batch operators."""

from pyspark.sql import functions as F

from lodestar.operators import coverage as V
from lodestar.streaming import operators as S

SF = "/root/testdata/sf0.001"


def drain(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def events(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("fingerprint"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), (F.col("value") > 50).alias("active"), F.concat(F.lit("http://h/"), (F.col("user_id") % 20).cast("string"), F.lit("/")).alias("url"), F.lit("failed").alias("status"))
    rows.orderBy("at", "seq").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_incidents(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    got = drain(S.incident_stream(stream.select("fingerprint", "at", "seq", "active")), "incidents", tmp_path)
    want = V.incidents(rows).select("fingerprint", "seq", "transition")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_sightings_and_windows(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    assert drain(S.first_sightings(stream), "sightings", tmp_path).count() == rows.select("url").distinct().count()
    got = drain(S.run_windows(stream.withColumnRenamed("fingerprint", "source_key")), "windows", tmp_path, "complete")
    assert got.agg(F.sum("n")).first()[0] == rows.count() and got.agg(F.sum("failed")).first()[0] == rows.count()


def test_ledger_sink(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    query = S.ledger_sink(stream.select("seq"), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
