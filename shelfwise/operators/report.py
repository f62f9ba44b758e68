"""Reporting aggregates, filters and top-k (A1, A4, V10, V12, T1, T2, F2-F4) and the metric rounding.

Each report is one aggregation: partial aggregates are combined map-side, so
even a group holding a third of the rows leaves every task with one partial
row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT_ORDER = {"train": 0, "val": 1, "test": 2}


def split_report(df: DataFrame, split_col: str = "split", date_col: str = "date",
                 key_col: str = "product_id", units_col: str = "units_sold") -> DataFrame:
    """V12 + V10: rows, dates and units per split, and the chronology check."""
    order = F.when(F.col(split_col) == "train", 0).when(F.col(split_col) == "val", 1).otherwise(2)
    g = (df.groupBy(split_col)
         .agg(F.count(F.lit(1)).alias("rows"),
              F.count_distinct(date_col).alias("dates"),
              F.min(date_col).alias("first_date"),
              F.max(date_col).alias("last_date"),
              F.count_distinct(key_col).alias("products"),
              F.sum(units_col).cast("long").alias("units_sold")))
    # three rows at most: an un-partitioned window here is bounded
    nxt = F.lead("first_date").over(Window.orderBy(order))
    return (g.withColumn("next_first_date", nxt)
            .withColumn("chronological", F.coalesce(F.col("last_date") < F.col("next_first_date"), F.lit(True))))


def frequency(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """A1: value frequencies, NULL excluded, the most frequent first (ties by value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.col(name).desc(), F.col(col).asc()))


def money_sum(c: Column) -> Column:
    """A4: exact money sum (decimal), 0 for an empty input."""
    return F.coalesce(F.sum(c.cast("decimal(38,2)")), F.lit(0).cast("decimal(38,2)")).cast("double")


METRIC_DIGITS = 6


def rounded(df: DataFrame, *columns: str, digits: int = METRIC_DIGITS) -> DataFrame:
    """Some statistics of a report to ``digits`` (for comparing it; operators return them as they are).

    Double sums depend on the summation order (partitioning) in their last
    bits; reporting at 1e-6 makes the figure reproducible across runs and
    engines without changing what is computed.
    """
    return df.withColumns({c: F.round(c, digits) for c in columns})


def top_k(df: DataFrame, by: str, k: int, tie: str, columns: list[str]) -> DataFrame:
    """The k rows with the largest ``by`` (ties by ``tie``); the limit is the feature.

    Planned as TakeOrderedAndProject: each task keeps k rows, the driver merges
    k x tasks rows.
    """
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc()).limit(k).select(*columns)


def result_filter(df: DataFrame, premium: bool = False, high_volume: bool = False,
                  high_revenue: bool = False) -> DataFrame:
    """F2-F4 on scored products: independently switchable, combined with AND."""
    from ..functions import rules as R

    out = df
    if premium:
        out = out.where(F.col("Recommended_Price") > R.PREMIUM_PRICE)
    if high_volume:
        out = out.where(F.col("Predicted_Units_Sold") > R.HIGH_VOLUME)
    if high_revenue:
        out = out.where(F.col("Predicted_Revenue") > R.HIGH_REVENUE)
    return out
