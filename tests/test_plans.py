"""The shape of physical plans: what reaches the scan, what is shuffled, and that no join multiplies rows."""

from __future__ import annotations

import re

import pytest

from skeinlake.plans.catalog import all_queries

QUERIES = all_queries()[0]


def plan(spark, name, folder):
    spark.catalog.clearCache()  # what other tests keep in memory would hide the scan
    return QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data_dir):
    p = plan(spark, "chapter_by_id_C01", data_dir)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(doc_id,42\)", p)
    assert "text" not in re.search(r"ReadSchema: (\S+)", p)[1]


@pytest.mark.parametrize("name", ["latest_per_key_W03", "upsert_relationship_B10", "edges_as_of_D14", "first_appearance_B03", "frozen_contracts_B12"])
def test_folds_aggregate_before_the_shuffle(spark, data_dir, name):
    p = plan(spark, name, data_dir)
    assert "partial_m" in p and "Window" not in p


@pytest.mark.parametrize("name", ["recent_changes_T04", "best_samples_T09", "api_debts_C25", "bm25_topk_R01", "vector_topk_R02"])
def test_top_k_keeps_k_rows_a_task(spark, data_dir, name):
    assert "TakeOrderedAndProject" in plan(spark, name, data_dir)


@pytest.mark.parametrize("name", ["drop_invalid_D07", "volume_of_chapter_D15", "graph_hop_D16", "entities_with_aliases_D04", "settled_contracts_D08", "term_candidates_D11", "names_in_text_D12", "pacing_K04", "strand_violations_K03"])
def test_no_join_pairs_everything(spark, data_dir, name):
    p = plan(spark, name, data_dir)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_a_global_order_is_only_taken_over_small_tables(spark, data_dir):
    p = plan(spark, "pacing_K04", data_dir)
    # Positions are read twice; each time only the table of the ranges' sizes goes to a single partition.
    assert p.count("SinglePartition") <= 2


@pytest.mark.parametrize("name", ["tokenize_F02", "cosine_F03", "strand_shares_E13", "streaks_and_gaps_W01_W02", "threads_K02", "rank_summaries_X02", "pay_L02", "keep_max_U02", "checklist_score_X10"])
def test_expressions_stay_in_the_jvm(spark, data_dir, name):
    assert not re.search(r"Python|Pandas|Arrow|MapIn", plan(spark, name, data_dir))
