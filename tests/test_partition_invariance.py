"""Same results at 1 and at N shuffle partitions."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["daily_split_report", "daily_gates", "price_features", "batch_summary", "daily_drift_ks",
         "document_tfidf", "batch_input"]


def _rows(spark, name, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = E.queries()[name](spark, SF)
        cols = sorted(df.columns)
        return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("name", NAMES)
def test_one_vs_many_partitions(spark, name):
    assert _rows(spark, name, 1) == _rows(spark, name, 7)
