"""Registered queries against their SQL on the smallest tables, and the streaming form against its batch twin."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")

SAMPLE = """profile_table profile_recipe infer_table pat_sequential dq_overall dedup_subset outlier_iqr col_out_winsorize impute_interpolate bin_equal_freq
 enc_label enc_target feat_lag sel_f recipe_apply pipeline_clean ev_roc_auc ev_pr_auc drift_ks drift_psi kpi_roi fairness stream_drift
 split_train_test knn_join outlier_lof sc_quantile_uniform src_encoding_fallback res_autocorr as_independence
 stream_shares stream_drift_run stream_quality_run opt_count_text opt_downcast sel_mi_regression""".split()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 11
