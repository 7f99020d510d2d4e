"""Physical plans: no cross joins, pruned scans, early limits."""

import pytest

from gridmosaic.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "c07_filter_questions", "c16_context_rows", "c18_unify_by_path", "e01_classify_entities", "e08_dispose_tags", "l21_rescue_emblems",
    "p03_qa_prompts_tags", "p03_with_examples", "q01_explicit_questions", "q21_quotas", "q22_stratified_sample", "q23_split_prefix", "r11_scoreboard", "r19_unique_attributes",
])
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_is_used(spark):
    text = plan(QUERIES["l12_nearest_revision"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in text


def test_filter_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan(QUERIES["q08_definite_cells"](spark, SF))


def test_top_k_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["c16_context_rows"](spark, SF))


def test_sample_limits_strata_before_the_shuffle(spark):
    text = plan(QUERIES["q22_stratified_sample"](spark, SF))
    limit = text.index("WindowGroupLimit", text.index("WindowGroupLimit") + 1)
    assert "Exchange hashpartitioning(stratum" in text[:limit] and ", Partial" in text[limit: limit + 400]
