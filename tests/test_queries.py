"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
CHECKED = ["A2_read_job_dataset", "A3_flatten_checkpoints", "A5_html_to_text", "A7_write_dataset", "A9_read_scope", "B4_fill_only_merge", "B7_relevance_level", "B12_ingest_versions", "B20_dedupe_interviews", "C12_classifier_input",
           "C16_hiring_cohorts", "C20_tokenize", "D1_admit_postings", "D5_assess_fit", "D8_prelabels", "D12_validate_terms", "E4_enrich_by_version", "E9_comparable_strata", "F3_salary_group_stats", "F6_cohort_salary",
           "F10_with_without", "F22_classification_metrics", "G1_influence_rank", "G4_bm25", "G8_cluster_representatives", "H1_even_sample", "H8_time_holdout", "I1_tfidf_keywords", "I8_topic_keywords", "J3_choose_threshold",
           "J4_nearest_reference", "K2_reusable_report", "K7_low_yield_window", "K8_repeated_page"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, con, name):
    diff = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert diff is None or diff.startswith("types"), diff


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_has_a_known_prefix():
    for name in entry.queries():
        assert name == "pipeline" or name[:2] == "op" or name[0] in "ABCDEFGHIJK" and name.split("_")[0][1:].isdigit()
