"""Aggregates whose buffers stay bounded: percentiles and hashes of groups, with one hot key."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import plans
from lodestar.functions import ids as I
from lodestar.operators import metrics as M
from lodestar.registry import REGISTRY
from tests.oracle import assert_same

plans.load()


@pytest.mark.parametrize("bins", [2, 4096])
def test_percentiles(spark, monkeypatch, bins):
    monkeypatch.setattr(M, "BINS", bins)
    draw = random.Random(3)
    cases = [[draw.gauss(0, 10) for _ in range(60)] + [7.25] * 120, [1.0], [2.0, 2.0], [-1e300, 1e300, 0.0, 4.0], [draw.lognormvariate(0, 4) for _ in range(40)]]
    for values in cases[: 2 if bins == 2 else 5]:
        frame = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
        got = M.percentiles(frame, "x", [0.0, 0.5, 0.95, 1.0])
        assert np.allclose(got, np.quantile(values, [0.0, 0.5, 0.95, 1.0]), rtol=1e-12, atol=0)
    empty = spark.createDataFrame([(None,)], "x double")
    assert M.percentiles(empty, "x", [0.5]) == [None] and tuple(M.latencies(empty, "x").first()) == (None, None, None)


def plain_hash(documents, leaf):
    """Of (name, content): hashes by as many first digits as make leaf a row, then by fewer."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    counts = {}
    for name, content in documents:
        key = md5(f"{name}\x1f{content}")
        counts[key] = counts.get(key, 0) + 1
    depth = 0
    while 16**depth * leaf < len(counts):
        depth += 1
    level = {}
    for key, n in counts.items():
        level.setdefault(key[:depth], []).append(key if n == 1 else f"{key}x{n}")
    for digits in range(depth, 0, -1):
        above = {}
        for prefix, said in level.items():
            above.setdefault(prefix[: digits - 1], []).append(prefix + md5("|".join(sorted(said))))
        level = above
    return md5("|".join(sorted(level[""])))


def test_hashes_of_groups(spark, monkeypatch):
    monkeypatch.setattr(I, "LEAF", 3)
    rows = [("hot", k, f"text {k}") for k in range(300)] + [("hot", 5, "text 5")] * 40 + [("few", k, "t") for k in range(3)] + [(None, 1, "t")]
    frame = spark.createDataFrame(rows, "source string, name int, content string")
    want = {g: (plain_hash([(n, c) for s, n, c in rows if s == g], 3), sum(s == g for s, _, _ in rows)) for g in ("hot", "few", None)}
    for parts in (1, 40):
        got = I.documents_hash(frame.repartition(parts), ["source"], F.col("name"), F.col("content"))
        assert {r.source: (r.source_hash, r.n_documents) for r in got.collect()} == want
    assert I.documents_hash(frame.limit(0), ["source"], F.col("name"), F.col("content")).collect() == []


@pytest.mark.parametrize("streamed", [3, 256])
def test_hash_of_listed_documents(spark, monkeypatch, tmp_path, streamed):
    monkeypatch.setattr(I, "STREAMED", streamed)
    rows = [(k, "hot", f"text {k}") for k in range(1300)] + [(5, "hot", "text 5")] * 9000 + [(k, "few", "t") for k in range(3)] + [(1, None, "t"), (None, "few", "t"), (7, "few", None), (8, "none", None), (9, "hot", "")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(REGISTRY.queries["content_hash"](spark, str(tmp_path)), REGISTRY.oracles["content_hash"], str(tmp_path))
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert I.listed_hash(empty, ["source"], F.col("doc_id"), F.col("text")).collect() == []
