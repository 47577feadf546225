"""Affinities and excerpts by blocks against those of a row for each pair of chunks."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import matching as M


def tables(spark, entities):
    draw = random.Random(entities)
    vector = lambda: [float(draw.randint(-3, 3)) for _ in range(4)]
    company = [(k, vector(), draw.choice(["profile", "hyde"])) for k in range(45)] + [(45, [0.0] * 4, "profile"), (46, None, "profile"), (47, vector(), None)]
    chunks = [(draw.randrange(entities), k, vector()) for k in range(150)] + [(entities, 150, None), (entities, 151, [0.0] * 4), (entities + 1, 152, None), (None, 153, vector()), (0, 3, vector()), (0, 3, vector())]
    return spark.createDataFrame(company, "company_chunk long, vector array<float>, origin string"), spark.createDataFrame(chunks, "entity int, entity_chunk long, vector array<float>")


@pytest.mark.parametrize("entities, block, blocks", [(3, 1024, 32), (3, 8, 32), (60, 8, 2), (60, 40, 32)])
def test_blocks_give_what_pairs_give(spark, monkeypatch, entities, block, blocks):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "PROFILE_BLOCKS", blocks)
    company, chunks = tables(spark, entities)
    pairs = M.pair_scores(company, chunks)
    said = lambda df: sorted((r.entity is not None, r.entity or 0, r.affinity and round(r.affinity, 9), r.best) for r in df.collect())
    assert said(M.affinities(company, chunks)) == said(M.affinity(pairs))
    shown = lambda df: {(r.entity, r.place): tuple(r) for r in df.where("similarity is not null").collect()}
    assert shown(M.best_excerpts(company, chunks)) == shown(M.excerpts(pairs))
    rows = spark.range(entities).select(F.col("id").cast("int").alias("entity"), F.when(F.col("id") % 5 == 1, "closed").otherwise("active").alias("validity"), F.lit("elegivel").alias("status"), F.array(F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("sectors"))
    ranked = lambda df: [(r.entity, r.score, r.status) for r in df.collect()]
    assert ranked(M.funnel_of(rows, company, chunks, F.array(F.lit("a")), 0.1)) == ranked(M.funnel(rows, pairs, F.array(F.lit("a")), 0.1))


def test_no_row_for_each_pair(spark):
    company, chunks = tables(spark, 3)
    plan = M._blocks(company, chunks)
    assert plan.count() == 1 and M.affinities(company, chunks)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
