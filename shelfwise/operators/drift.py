"""Two-sample Kolmogorov-Smirnov drift check.

Spark ships a one-sample test only. Here: counts per distinct value and side
(partial aggregation), cumulative counts along the value order (partition
offsets, no single-task window), and the largest gap between the two
empirical CDFs. The p-value uses the asymptotic Kolmogorov series
``Q(l) = 2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 l^2)`` with
``l = sqrt(n1 n2 / (n1 + n2)) * D``, or, where both samples have at most
``exact_most`` values, the share of all orders of the two samples that have so
large a gap (``exact_p_value``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexing import running_sums

SERIES_TERMS = 100
SMALL_LAMBDA = 0.2      # below this Q(l) equals 1 to within 1e-8
EXACT_MOST = 10_000     # values a side up to which the daily job asks for the exact p-value


def exact_p_value(gap: int, n1: int, n2: int) -> float:
    """The share of lattice paths from (0, 0) to (n1, n2) that meet ``|i * n2 - j * n1| >= gap``.

    A path is an order of both samples put together: a step right is a value of
    the first, a step up one of the second, and the two CDFs at that place differ
    by ``|i / n1 - j / n2|``. Of the paths to (i, j), i in i + j come from
    (i - 1, j), so shares instead of counts go from one diagonal to the next;
    nothing is subtracted, and small p-values keep their digits. Work is n1 * n2.
    """
    shares, low = np.array([1.0 if gap <= 0 else 0.0]), 0
    for s in range(1, n1 + n2 + 1):
        i = np.arange(max(0, s - n2), min(n1, s) + 1, dtype=np.int64)
        j = s - i
        padded = np.concatenate([[0.0], shares, [0.0]])      # padded[k - low + 1] belongs to i = k
        shares = (i * padded[i - low] + j * padded[i - low + 1]) / s
        shares[np.abs(i * n2 - j * n1) >= gap] = 1.0
        low = int(i[0])
    return float(shares[0])


def kolmogorov_q(lam: F.Column) -> F.Column:
    terms = F.sequence(F.lit(1), F.lit(SERIES_TERMS))
    series = F.aggregate(
        terms, F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * (k * k).cast("double") * lam * lam))
    q = F.lit(2.0) * series
    return F.when(lam < SMALL_LAMBDA, F.lit(1.0)).otherwise(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))


def ks_two_sample(df: DataFrame, value: str, side: str, first, second, exact_most: int = 0) -> DataFrame:
    """One row: n1, n2, statistic D and p-value, ``side`` = first vs second.

    The p-value is exact if neither side has more than ``exact_most`` values,
    asymptotic else. Two jobs: the side totals (two numbers reach the driver),
    then the statistic over the per-value counts.
    """
    s = df.where(F.col(side).isin(first, second) & F.col(value).isNotNull())
    per_value = (s.groupBy(value)
                 .agg(F.count_if(F.col(side) == first).alias("c1"),
                      F.count_if(F.col(side) == second).alias("c2")))
    cum = running_sums(per_value, [value], {"cum1": F.col("c1"), "cum2": F.col("c2")})
    tot = cum.agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2")).first()
    n1, n2 = int(tot["n1"] or 0), int(tot["n2"] or 0)
    if n1 == 0 or n2 == 0:
        return cum.sparkSession.createDataFrame([(n1, n2, None, None)],
                                                "n1 long, n2 long, statistic double, p_value double")
    if max(n1, n2) <= exact_most:
        whole = F.abs(F.col("cum1") * F.lit(n2) - F.col("cum2") * F.lit(n1))
        found = cum.agg(F.max(whole).alias("gap")).first()["gap"]
        return cum.sparkSession.createDataFrame([(n1, n2, found / (n1 * n2), exact_p_value(int(found), n1, n2))],
                                                "n1 long, n2 long, statistic double, p_value double")
    gap = F.abs(F.col("cum1") / F.lit(float(n1)) - F.col("cum2") / F.lit(float(n2)))
    d = cum.agg(F.max(gap).alias("statistic"))
    lam = F.sqrt(F.lit(n1 * n2 / (n1 + n2))) * F.col("statistic")
    return d.select(F.lit(n1).cast("long").alias("n1"), F.lit(n2).cast("long").alias("n2"), "statistic",
                    kolmogorov_q(lam).alias("p_value"))
