"""Jaccard edges of items with few different sets of tags: the SQL's rows, without a shuffle of every pair."""

import random

import pytest

from lodestar import plans
from lodestar.operators import graph as G
from lodestar.registry import REGISTRY
from tests.oracle import assert_same

plans.load()


def parts_of(spark, path, n, words, seed):
    draw = random.Random(seed)
    rows = [(k, " ".join(draw.choices(words, k=draw.randint(0, 3))), draw.choice(["", "STEEL", "Tin  a"])) for k in range(n)]
    rows += [(20 * n, None, "steel"), (None, "a", "a"), (20 * n + 20, "", "")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").repartition(3).write.parquet(f"{path}/part.parquet")


@pytest.mark.parametrize("tile, tag_rows", [(1024, 4096), (3, 2)])
def test_edges_are_those_of_the_sql(spark, monkeypatch, tmp_path, tile, tag_rows):
    monkeypatch.setattr(G, "TILE", tile)
    monkeypatch.setattr(G, "TAG_ROWS", tag_rows)
    parts_of(spark, tmp_path, 400, ["a", "b", "B", "c", "d"], tile)
    con_sql = REGISTRY.oracles["jaccard_edges"].replace("FROM part", "FROM (SELECT * FROM part WHERE p_name IS NOT NULL)")  # concat_ws takes a null name for none
    result = REGISTRY.queries["jaccard_edges"](spark, str(tmp_path)).where("src <> 8000 and dst <> 8000")
    assert_same(result, con_sql, str(tmp_path))


def test_pairs_of_items_are_made_after_all_aggregates(spark, tmp_path):
    spark.range(6000).selectExpr("id as p_partkey", "concat('word ', id % 5) as p_name", "'TYPE' as p_type").write.parquet(f"{tmp_path}/part.parquet")
    result = REGISTRY.queries["jaccard_edges"](spark, str(tmp_path))
    assert result.count() == 300 * 5700
    text = result._jdf.queryExecution().executedPlan().toString()
    assert text.index("explode(dsts") < text.index("Join") < text.index("HashAggregate")
