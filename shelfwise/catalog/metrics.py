"""Model-quality metrics on stand-in predictions: A11, A12, A13, A14.

Statistics over doubles are reported to 1e-6 (``report.rounded``), so they do
not depend on summation order (and match the oracle).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.drift import EXACT_MOST, SERIES_TERMS, SMALL_LAMBDA, ks_two_sample
from ..operators.report import rounded
from ..plans import daily as DJ
from ..plans.pricing import regression_report
from . import daily as D
from . import products as PR
from .scoring import SQL_DEMAND, standin_demand


DRIFT_CATEGORY = "SMALL"


def standin_predictions(spark, sf_dir, *splits):
    """The stand-in forecast of some splits in the shape of ``daily.predictions``."""
    s = D.split_daily(spark, sf_dir).where(F.col("split").isin(*splits))
    return s.select("split", F.col("units_sold").alias("true_units"), standin_demand().alias("predicted_units"))


def q_daily_errors(spark, sf_dir):
    """MAE and RMSE of the (stand-in) demand forecast, per hold-out split."""
    return rounded(DJ.evaluate(standin_predictions(spark, sf_dir, "val", "test")).select("split", "rows", "mae", "rmse"), "mae", "rmse")


def q_daily_range_check(spark, sf_dir):
    """Prediction spread vs target spread on the test split."""
    return DJ.evaluate(standin_predictions(spark, sf_dir, "test")).select("pred_spread", "target_spread", "range_ratio", "range_status")


def q_daily_drift_ks(spark, sf_dir):
    """Two-sample KS, train target vs validation target."""
    return rounded(ks_two_sample(D.split_daily(spark, sf_dir), "units_sold", "split", "train", "val"), "p_value", digits=12)


def q_price_drift_ks(spark, sf_dir):
    """A14 with the exact p-value: original prices of training and test products of one material class."""
    p = PR.products_split(spark, sf_dir).where(F.col("category") == DRIFT_CATEGORY)
    return rounded(ks_two_sample(p, "original_price", "split", "train", "test", EXACT_MOST), "statistic", "p_value", digits=9)


def standin_eval_price():
    return F.col("original_price") * F.lit(0.93) + F.col("price_vs_competitor") * F.lit(10.0)


def q_price_holdout_eval(spark, sf_dir):
    """A12 + C8: RMSE and R^2 of the price and units predictions (clamped at 0) on hold-out."""
    feat = PR.q_price_features(spark, sf_dir).where(F.col("split") == "test")
    pp = F.greatest(standin_eval_price(), F.lit(0.0))
    up = F.greatest(F.lit(300.0) - pp * F.lit(0.2), F.lit(0.0))
    report = regression_report(feat, {"price": (F.col("current_price"), pp), "units": (F.col("units_sold"), up)})
    return rounded(report, "price_rmse", "price_r2", "units_rmse", "units_r2")


QUERIES = {
    "daily_errors": q_daily_errors,
    "daily_range_check": q_daily_range_check,
    "daily_drift_ks": q_daily_drift_ks,
    "price_drift_ks": q_price_drift_ks,
    "price_holdout_eval": q_price_holdout_eval,
}


def _m(expr: str) -> str:
    return f"round({expr}, 6)"


_ERR = f"(CAST(units_sold AS DOUBLE) - {SQL_DEMAND})"

_KS = f"""WITH {D.SPLIT},
pv AS (SELECT units_sold, count(*) FILTER (WHERE split = 'train') AS c1,
              count(*) FILTER (WHERE split = 'val') AS c2
       FROM split WHERE split IN ('train', 'val') AND units_sold IS NOT NULL GROUP BY units_sold),
cum AS (SELECT *, SUM(c1) OVER (ORDER BY units_sold) AS cum1, SUM(c2) OVER (ORDER BY units_sold) AS cum2,
               SUM(c1) OVER () AS n1, SUM(c2) OVER () AS n2 FROM pv),
st AS (SELECT CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2,
              max(abs(cum1 / CAST(n1 AS DOUBLE) - cum2 / CAST(n2 AS DOUBLE))) AS statistic FROM cum),
lam AS (SELECT *, sqrt(CAST(n1 * n2 AS DOUBLE) / CAST(n1 + n2 AS DOUBLE)) * statistic AS l FROM st)
SELECT n1, n2, statistic,
  round(CASE WHEN l < {SMALL_LAMBDA} THEN 1.0
        ELSE least(greatest(2.0 * list_reduce(list_transform(range(1, {SERIES_TERMS + 1}),
               lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * CAST(k * k AS DOUBLE) * l * l)),
               lambda a, b: a + b), 0.0), 1.0) END, 12) AS p_value
FROM lam"""

# The paths are followed diagonal by diagonal, as rows (s, i, share).
_KS_EXACT = f"""WITH RECURSIVE {PR.PRODUCTS},
pv AS (SELECT original_price AS v, count(*) FILTER (WHERE split = 'train') AS c1, count(*) FILTER (WHERE split = 'test') AS c2
       FROM products WHERE category = '{DRIFT_CATEGORY}' AND original_price IS NOT NULL GROUP BY v),
cum AS (SELECT sum(c1) OVER (ORDER BY v) AS cum1, sum(c2) OVER (ORDER BY v) AS cum2, sum(c1) OVER () AS n1, sum(c2) OVER () AS n2 FROM pv),
st AS MATERIALIZED (SELECT CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2, CAST(max(abs(cum1 * n2 - cum2 * n1)) AS BIGINT) AS gap FROM cum),
path AS (
  SELECT CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS i, CAST(CASE WHEN gap <= 0 THEN 1 ELSE 0 END AS DOUBLE) AS share FROM st
  UNION ALL
  SELECT s, i, CASE WHEN abs(i * n2 - (s - i) * n1) >= gap THEN 1.0 ELSE total / s END
  FROM (SELECT s, k AS i, sum(w * share) AS total
        FROM (SELECT s + 1 AS s, share, unnest([i, i + 1]) AS k, unnest([s + 1 - i, i + 1]) AS w FROM path) GROUP BY s, k) t, st
  WHERE i <= n1 AND s - i <= n2)
SELECT n1, n2, round(gap / CAST(n1 * n2 AS DOUBLE), 9) AS statistic, round(share, 9) AS p_value
FROM path, st WHERE i = n1 AND s = n1 + n2"""

_PRICE_FEAT = PR.SQL["price_features"]

SQL = {
    "daily_errors": f"""WITH {D.SPLIT}
SELECT split, count(*) AS rows, {_m(f'avg(abs({_ERR}))')} AS mae,
       {_m(f'sqrt(avg({_ERR} * {_ERR}))')} AS rmse
FROM split WHERE split IN ('val', 'test') GROUP BY split""",
    "daily_range_check": f"""WITH {D.SPLIT},
t AS (SELECT CAST(units_sold AS DOUBLE) AS y, {SQL_DEMAND} AS p FROM split WHERE split = 'test'),
g AS (SELECT max(p) - min(p) AS pred_spread, max(y) - min(y) AS target_spread FROM t),
r AS (SELECT *, CASE WHEN target_spread = 0 THEN 0.0 ELSE pred_spread / target_spread END AS range_ratio FROM g)
SELECT *, CASE WHEN range_ratio < 0.1 THEN 'WARNING' ELSE 'PASS' END AS range_status FROM r""",
    "daily_drift_ks": _KS,
    "price_drift_ks": _KS_EXACT,
    "price_holdout_eval": f"""WITH feat AS ({_PRICE_FEAT}),
t AS (SELECT current_price AS y1, p1, units_sold AS y2,
             greatest(CAST(300.0 AS DOUBLE) - p1 * CAST(0.2 AS DOUBLE), CAST(0.0 AS DOUBLE)) AS p2
      FROM (SELECT *, greatest(original_price * CAST(0.93 AS DOUBLE) + price_vs_competitor * CAST(10.0 AS DOUBLE),
                               CAST(0.0 AS DOUBLE)) AS p1 FROM feat WHERE split = 'test')),
g AS (SELECT count(*) AS rows,
        {_m('sqrt(avg((y1 - p1) * (y1 - p1)))')} AS price_rmse,
        {_m('1.0 - sum((y1 - p1) * (y1 - p1)) / (count(y1) * var_pop(y1))')} AS price_r2,
        {_m('sqrt(avg((y2 - p2) * (y2 - p2)))')} AS units_rmse,
        {_m('1.0 - sum((y2 - p2) * (y2 - p2)) / (count(y2) * var_pop(y2))')} AS units_r2
      FROM t)
SELECT * FROM g""",
}
