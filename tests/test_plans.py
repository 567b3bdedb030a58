"""What no plan may hold, and what some must."""

import pytest

from millrace.operators import knn
from millrace.plans import queries
from millrace.sources import tables

PLAIN = [
    "avg_city_2021", "dedup_rows", "fill_replace", "guarded_wages", "clip_rules", "keyword_flags", "body_parts",
    "cause_of_injury", "date_parts", "report_delay", "code_interactions", "text_normalize", "html_items",
    "word_rows", "wordlist_edit", "topk_by_task", "token_usage", "chat_history", "chat_transcript",
    "frequency_encode", "rare_level", "std_by_year", "min_impute", "glm_sscp", "class_levels", "glm_score",
    "target_encode", "abt_test", "knn_single", "rag_prompt", "extractive_summary",
]


def plan(spark, folder, name):
    return queries.REGISTRY[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_join_and_no_row_python(spark, folder, name):
    text = plan(spark, folder, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


@pytest.mark.parametrize("name", ["keyword_flags", "body_parts", "cause_of_injury", "text_normalize", "html_items"])
def test_row_work_does_not_shuffle(spark, folder, name):
    assert "Exchange" not in plan(spark, folder, name)


def test_groups_are_limited_before_the_shuffle(spark, folder):
    assert plan(spark, folder, "topk_by_task").count("WindowGroupLimit") == 2
    hits = knn.top_k_single(tables.table(spark, folder, "embeddings"), [1.0] * 64, 3)
    assert "TakeOrderedAndProject" in hits._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark, folder):
    text = plan(spark, folder, "keyword_flags")
    assert "ReadSchema: struct<o_orderkey:bigint>" in text
