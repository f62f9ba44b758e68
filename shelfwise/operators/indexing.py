"""Positions in a total order without funnelling rows through one task.

``row_number() over (order by k)`` without a partition moves every row to a
single task. Here the rows are range-partitioned and sorted by Spark, each
partition numbers its own rows, and a table with one row per partition
(bounded by the partition count) supplies the offsets.

The partition ids are written down by a reliable checkpoint before the
offsets are computed: without it, the row branch and the count branch are two
executions whose partitions AQE may coalesce differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_PID, _MID, _N, _OFF = "__pid", "__mid", "__n", "__off"


def index_by_order(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """Append ``name`` = 0-based position of each row in ``order``.

    ``order`` must be a unique key for the numbering to be reproducible.
    """
    ranked = (df.orderBy(*order)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id()))
    # monotonically_increasing_id = partition index << 33 | row index within partition
    ranked = ranked.withColumn(_MID, F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33))
    checkpoint_dir(df.sparkSession)
    ranked = ranked.checkpoint(eager=True)
    counts = ranked.groupBy(_PID).agg(F.count(F.lit(1)).alias(_N))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_OFF))
    # one row per partition: a bounded broadcast
    out = ranked.join(F.broadcast(offsets), _PID)
    return out.withColumn(name, F.col(_OFF) + F.col(_MID)).drop(_PID, _MID, _OFF)


def fit_code(df: DataFrame, key: str, name: str):
    """code = position of a value among the sorted distinct values; returns ``apply(target)``.

    The distinct values are ranked by the ordered index and joined by key (AQE
    broadcasts them only when their measured size allows). Values never seen
    get NULL. No list of values reaches the driver.
    """
    values = df.select(key).where(F.col(key).isNotNull()).distinct()
    dim = index_by_order(values, [key], name).withColumn(name, F.col(name).cast("int"))
    return lambda target: target.join(dim, key, "left")


def dense_code(df: DataFrame, key: str, name: str) -> DataFrame:
    """Dimension ``(key, name)``: code = position of ``key`` among its sorted distinct values."""
    values = df.select(key).where(F.col(key).isNotNull()).distinct()
    return index_by_order(values, [key], name).withColumn(name, F.col(name).cast("int"))


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Append inclusive running sums of ``sums`` along ``order`` (a unique key).

    Each range partition sums its own rows in order (a window per partition id,
    so one task per partition); partition totals, one row per partition,
    supply the offsets.
    """
    ranked = (df.select("*", *[c.alias(f"__v_{n}") for n, c in sums.items()])
              .orderBy(*order)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id()))
    checkpoint_dir(df.sparkSession)
    ranked = ranked.checkpoint(eager=True)
    totals = ranked.groupBy(_PID).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PID, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}")
                                    for n in sums])
    within = Window.partitionBy(_PID).orderBy(_MID).rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.join(F.broadcast(offsets), _PID)
    for n in sums:
        out = out.withColumn(n, F.col(f"__o_{n}") + F.sum(f"__v_{n}").over(within))
    drop = [_PID, _MID] + [f"__{p}_{n}" for n in sums for p in ("v", "o")]
    return out.drop(*drop)
