"""Operators with map and value state and timers: any split into batches, restarts, bounded state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.operators import validity as V
from lodestar.streaming import operators as S

START = datetime(2026, 1, 1)
SIGHTING, OBSERVATION = "url string, at timestamp, seq long", "subject_id string, input_fingerprint string, observed timestamp, event_id long"


@pytest.fixture(autouse=True)
def store(spark):
    key, value = S.STORE
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, before)


def observations(n, seed):
    rng = random.Random(seed)
    return [(f"s{rng.randrange(4)}", rng.choice(["a", "b", "c", None]), START + timedelta(hours=rng.randrange(200)), i) for i in range(n)]


def run(spark, make, schema, parts, tmp_path, mode, restart=None):
    """What a stream gives of parts that arrive one after another, each in a batch; started anew before the batch restart. Also states held at the end."""
    source, out = tmp_path / "in", []
    source.mkdir(exist_ok=True)

    def start():
        stream = make(spark.readStream.schema(schema).parquet(str(source)))
        return stream.writeStream.outputMode(mode).foreachBatch(lambda df, k: out.extend((k, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()

    query = start()
    try:
        for k, part in enumerate(parts):
            if k == restart:
                query.stop()
                query = start()
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
        states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
    return out, states


@pytest.mark.parametrize("batches, restart", [(1, None), (4, 2)])
def test_exceptions_in_any_split(spark, tmp_path, batches, restart):
    rows = observations(60, 1)
    size = len(rows) // batches
    got, _ = run(spark, lambda s: S.exception_stream(s, late="30 days"), OBSERVATION, [rows[i : i + size] for i in range(0, len(rows), size)], tmp_path, "update", restart)
    last = {(r[1], r[2]): tuple(r[3:]) for r in sorted(got, key=lambda r: r[0])}
    want = V.observe(spark.createDataFrame(rows, OBSERVATION).where("input_fingerprint is not null"), ["subject_id"])
    assert last == {(r.subject_id, r.input_fingerprint): (r.detected, r.last_observed, r.n_observed, r.status) for r in want.collect()}


def test_silent_subjects_leave_no_state(spark, tmp_path):
    days = [[(f"s{d}", "a", START + timedelta(days=d), d)] for d in (0, 1, 40, 41)]
    got, states = run(spark, lambda s: S.exception_stream(s, late="1 hour", silent=10), OBSERVATION, days + [[("s0", "a", START + timedelta(days=60), 99)]], tmp_path, "update")
    again = [r for r in got if r[1] == "s0"][-1]
    assert again[3] == START + timedelta(days=60) and again[5] == 1 and again[6] == "open"  # a new exception
    # A subject is two rows of state; those of all but the last one are gone.
    rows = [p["numRowsTotal"] for p in states]
    assert max(rows) == 6 and rows[-1] == 2, rows


def passes(rows, days):
    out, until = set(), {}
    for url, at, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        if url not in until or at >= until[url]:
            out.add((url, at, seq))
            until[url] = at + timedelta(days=days)
    return out


@pytest.mark.parametrize("batches, restart", [(1, None), (3, 1)])
def test_renewed_sightings(spark, tmp_path, batches, restart):
    rng = random.Random(2)
    rows = sorted([(f"http://h/{rng.randrange(3)}", START + timedelta(days=rng.randrange(200)), i) for i in range(45)], key=lambda r: (r[1], r[2]))
    size = len(rows) // batches
    got, _ = run(spark, lambda s: S.renewed_sightings(s, 30), SIGHTING, [rows[i : i + size] for i in range(0, len(rows), size)], tmp_path, "append", restart)
    assert {tuple(r[1:]) for r in got} == passes(rows, 30) and len(got) == len(passes(rows, 30))
