"""Registered queries against their DuckDB oracle on the smallest tables."""

import pytest

from tests.compare import compare, duck
from tests.conftest import SF001

KEYS = ["s1_corpus", "a1_dataset_stats", "a5_length_box", "x1_balanced_sample", "x7_stratified_split",
        "f1_truncate", "f3_few_shot_prompts", "f12_parse_conversations", "m6_grid", "a14_by_strategy",
        "a24_parameter_trend", "a20_compare_models", "x6_holdout_split", "x8_validation_split", "m5_isolation", "s1_landed_corpus",
        "p2_unmapped_labels", "l4_latest_results", "m12_report_models", "j6_resolved_backends", "f20_backend_names",
        "s3_csv_corpus", "s9_flat_documents", "s10_csv_report", "m2_row_options", "j5_backends", "a24_fitted_values",
        "a27_split_sizes", "a27_inventory", "f2_f5_prompts", "f10_classification_prompt"]


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E
    con = duck(SF001)
    assert compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF001)


def test_every_query_has_oracle_or_is_listed():
    import __spark_entry__ as E
    assert set(E._QUERIES) <= set(E.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "f1_score" in df.columns
