"""Physical plans: what is read, pushed down and shuffled."""

import re

import pytest

from lodestar import plans
from lodestar.registry import REGISTRY
from lodestar.session import few, small

plans.load()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_no_sort_of_all_rows(spark):
    text = plan(REGISTRY.queries["dense_topk"](spark, SF))
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text and "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,0)]" in text


@pytest.mark.parametrize("name, unread", [("channel_runs", "props"), ("catalog_list", "o_totalprice"), ("promote_gate", "props"), ("turn_stats", "text"), ("snapshot_latest", "text")])
def test_columns_are_pruned(spark, name, unread):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(REGISTRY.queries[name](spark, SF))):
        assert unread not in re.findall(r"(\w+):", schema)


@pytest.mark.parametrize("name", ["temporal_validity", "content_flags", "call_status", "section_class", "split_units", "pack_chunks", "url_identity", "html_plain_text", "theme_match", "search_tokens"])
def test_row_operators_do_not_shuffle(spark, name):
    text = plan(REGISTRY.queries[name](spark, SF))
    assert "Exchange" not in text and "Python" not in text and "Pandas" not in text


#: Queries that join without a key, each with a side of checked or fixed size: one query, one row of totals, a rule table, a profile.
SMALL_SIDES = {
    "bm25_topk": "query and totals", "rrf_hybrid": "query and totals", "hybrid_retrieve": "query and totals", "dense_topk": "query", "library_score": "query", "tag_neighbors": "anchor",
    "degree_centrality": "totals", "size_distribution": "totals", "freshness": "totals", "snapshot_equal": "totals", "eligibility_verdict": "rules", "eligibility_reasons": "rules", "eligibility_trail": "rules",
    "match_funnel": "profile", "maxsim_affinity": "profile", "maxsim_excerpts": "profile", "quote_resolve": "names of sources",
}


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_joins_without_a_key_have_a_small_side(spark, name):
    text = plan(REGISTRY.queries[name](spark, SF))
    assert "CartesianProduct" not in text and ("BroadcastNestedLoopJoin" in text) == (name in SMALL_SIDES)


def test_sides_are_counted(spark):
    assert "BroadcastExchange" in plan(spark.range(9).join(small(spark.range(5), 5), "id"))
    assert "BroadcastExchange" not in plan(spark.range(9).join(small(spark.range(6), 5), "id"))
    with pytest.raises(ValueError, match="at most"):
        few(spark.range(2))
