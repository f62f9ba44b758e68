"""Train / validation / test splits.

The time split is fitted once (two cut-off dates) and then applied as a
per-row ``CASE``: no join of fact rows against a date list, no shuffle.
Random splits hash a key instead of drawing random numbers, so they are
stable under repartitioning, recomputation after executor loss, and portable
to SQL.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .indexing import index_by_order

# Fixed values of the time split: cut at int(n * 0.70) and int(n * 0.85) of the
# sorted distinct dates; whole dates stay together.
TRAIN_SHARE = 0.70
VAL_SHARE = 0.85


@dataclass(frozen=True)
class TimeCutoffs:
    first_val_date: dt.date | None
    first_test_date: dt.date | None
    n_dates: int

    def label(self, date_col: Column) -> Column:
        expr = None
        if self.first_val_date is not None:
            expr = F.when(date_col < F.lit(self.first_val_date), F.lit("train"))
        if self.first_test_date is not None:
            cond = date_col < F.lit(self.first_test_date)
            expr = F.when(cond, F.lit("val")) if expr is None else expr.when(cond, F.lit("val"))
        if expr is None:
            return F.lit("train")
        return expr.otherwise(F.lit("test" if self.first_test_date is not None else "val"))


def fit_time_split(df: DataFrame, date_col: str = "date", train_share: float = TRAIN_SHARE,
                   val_share: float = VAL_SHARE) -> TimeCutoffs:
    """The two cut-off dates among the sorted distinct dates.

    The dates are ranked by the ordered index; two of them reach the driver.
    """
    dates = df.select(date_col).where(F.col(date_col).isNotNull()).distinct()
    ranked = index_by_order(dates, [date_col], "_i")  # materialised by a checkpoint
    n = ranked.count()
    c1, c2 = int(n * train_share), int(n * val_share)
    found = {r["_i"]: r[date_col] for r in ranked.where(F.col("_i").isin(c1, c2)).collect()}
    if c1 >= n:
        return TimeCutoffs(None, None, n)
    return TimeCutoffs(found.get(c1), found.get(c2) if c2 < n else None, n)


def apply_time_split(df: DataFrame, cutoffs: TimeCutoffs, date_col: str = "date",
                     name: str = "split") -> DataFrame:
    """Semi-join of rows to the date sets, as a CASE on the contiguous ranges."""
    return df.withColumn(name, cutoffs.label(F.col(date_col)))


def hash_bucket(key: Column, seed: int) -> Column:
    """Four hex digits of md5(key|seed): a reproducible, uniform bucket per key."""
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 4)


def share_threshold(share: float) -> str:
    """The hex bucket below which a row falls with probability ~``share``."""
    return f"{int(share * 65536):04x}"


def hash_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42,
               name: str = "split") -> DataFrame:
    """~``test_share`` of rows to 'test', by hash of ``key`` (row-stable)."""
    is_test = hash_bucket(F.col(key), seed) < F.lit(share_threshold(test_share))
    return df.withColumn(name, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def stratified_hash_split(df: DataFrame, key: str, label: str, test_share: float = 0.2,
                          seed: int = 2, name: str = "split") -> DataFrame:
    """Stratified in expectation: every class is cut at the same hash threshold.

    An exact per-class share would need a rank inside each class, which puts
    a whole class (possibly a third of the data) into one window task.
    """
    k = F.concat_ws("|", F.col(label).cast("string"), F.col(key).cast("string"))
    is_test = hash_bucket(k, seed) < F.lit(share_threshold(test_share))
    return df.withColumn(name, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


MOST_CLASSES = 10_000      # classes that a stratified split takes at most: their quotas are made in the driver


def quotas(counts: dict, share: float) -> dict:
    """How many test rows of each class: ``ceil(share * rows)`` in all, dealt in proportion, the largest remainders first.

    Equal remainders go to the smaller class value; a missing class is the largest.
    """
    n = sum(counts.values())
    if not n:
        return {}
    wanted = math.ceil(Decimal(str(share)) * n)
    out = {c: wanted * k // n for c, k in counts.items()}
    order = sorted(counts, key=lambda c: (-(wanted * counts[c] % n), c is None, c if c is not None else 0))
    for c in order[:wanted - sum(out.values())]:
        out[c] += 1
    return out


def exact_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, label: str | None = None, name: str = "split") -> DataFrame:
    """E10, E11 with exact sizes: of each class the ``quotas`` rows with the smallest md5(key|seed) are 'test'.

    No class is ranked as a whole: rows are counted by the hash's first four hex
    digits, running sums find the digits in which a class' last test row lies,
    and only rows with these digits, a 65,536th of the class, are counted by the
    whole hash. Rows with one key can't be told apart: they go to one side, to
    'train' if they don't fit into the quota. ``key`` should be unique.
    """
    parts = [F.coalesce(F.col(label).cast("string"), F.lit("")), F.col(key).cast("string")] if label else [F.col(key).cast("string")]
    hashed = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    kind = F.col(label) if label else F.lit(0)
    rows = df.select(kind.alias("__class"), F.substring(hashed, 1, 4).alias("__digits"), hashed.alias("__hash"))
    counts = stored(rows.groupBy("__class", "__digits").agg(F.count(F.lit(1)).alias("n")), "split-counts")
    totals = counts.groupBy("__class").agg(F.sum("n").alias("n")).limit(MOST_CLASSES + 1).collect()
    if len(totals) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes in {label!r}")
    wanted = quotas({r["__class"]: r["n"] for r in totals}, test_share)
    if not wanted:
        return df.withColumn(name, F.lit("train"))
    classes = df.sparkSession.createDataFrame([(c, q) for c, q in wanted.items()], T.StructType([
        T.StructField("__kind", counts.schema["__class"].dataType), T.StructField("quota", T.LongType())]))
    same = F.col("__class").eqNullSafe(F.col("__kind"))
    by_digits = Window.partitionBy("__class").orderBy("__digits")             # at most 65,536 rows a class
    cut = (counts.withColumn("upto", F.sum("n").over(by_digits)).join(F.broadcast(classes), same)
           .where((F.col("upto") > F.col("quota")) & (F.col("upto") - F.col("n") <= F.col("quota")))
           .select("__kind", F.col("__digits").alias("cut"), (F.col("quota") - F.col("upto") + F.col("n")).alias("left")))
    near = rows.join(F.broadcast(cut), same & (F.col("__digits") == F.col("cut")))
    by_hash = Window.partitionBy("__class").orderBy("__hash")
    hashes = near.groupBy("__class", "__hash", "left").agg(F.count(F.lit(1)).alias("n"))
    last = (hashes.withColumn("upto", F.sum("n").over(by_hash)).where(F.col("upto") <= F.col("left"))
            .groupBy("__class").agg(F.max("__hash").alias("last")))
    # a class whose rows are all test has no cut; one whose quota ends between two digits ends before the cut's digits
    found = {r["__kind"]: r["last"] or r["cut"] for r in cut.join(last, same, "left").collect()}
    if label is None:
        return df.withColumn(name, F.when(hashed <= F.lit(found.get(0, "g")), F.lit("test")).otherwise(F.lit("train")))
    bounds = df.sparkSession.createDataFrame([(c, found.get(c, "g")) for c in wanted], T.StructType([
        T.StructField("__kind", counts.schema["__class"].dataType), T.StructField("__last", T.StringType())]))
    out = df.join(F.broadcast(bounds), kind.eqNullSafe(F.col("__kind")), "left")
    return out.withColumn(name, F.when(hashed <= F.col("__last"), F.lit("test")).otherwise(F.lit("train"))).drop("__kind", "__last")
