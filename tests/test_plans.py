"""What the plans of queries must and must not hold."""

import pytest

from sieveline.plans import registry

Q = registry.queries()
NATIVE = "bm25_topk doc_frequency dedupe_last tool_histogram rate_by_group audit_percentiles audit_uniqueness asof_latest first_link stratified_split mcnemar path_classify spec_normalise mask_pad name_resolution prefix_file_map char_tfidf similar_topk".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, sf, name):
    p = plan(Q[name](spark, sf))
    assert "CartesianProduct" not in p
    assert not any(x in p for x in ("Python", "Arrow", "Pandas"))


def test_columns_are_pruned_and_filters_pushed(spark, sf):
    p = plan(Q["asof_latest"](spark, sf))
    assert "props" not in p.split("ReadSchema", 1)[1] and "value" not in p.split("ReadSchema", 1)[1].split("\n")[0]
    assert "EqualTo(event_type,error)" in p and "EqualTo(event_type,view)" in p


def test_keep_last_combines_before_the_shuffle(spark, sf):
    p = plan(Q["dedupe_last"](spark, sf))
    assert "Window" not in p and p.count("SortAggregate") + p.count("ObjectHashAggregate") + p.count("HashAggregate") >= 2


def test_top_k_limits_groups_early(spark, sf):
    assert "WindowGroupLimit" in plan(Q["bm25_topk"](spark, sf))
