"""Daily demand fact: adapter, cleaning, gates, encoder, time split, features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators.indexing import dense_code
from ..operators.report import split_report
from ..operators.split import apply_time_split, fit_time_split
from ..plans.daily import model_matrix
from ..session import scratch_path, stored
from ..sources.adapters import daily_raw, daily_sales
from ..sources.readers import read_daily_raw
from . import adapter_sql as A

# ---------------------------------------------------------------- Spark side


def q_daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 itself: the typed daily fact."""
    return daily_sales(spark, sf_dir)


def q_daily_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1s / S2: the fact as strings with dirt."""
    return daily_raw(spark, sf_dir)


def split_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with its split; it is computed once and written, for the cut-offs and the result."""
    d = stored(daily_sales(spark, sf_dir), "daily-sales")
    return apply_time_split(d, fit_time_split(d))


def q_daily_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 + J3 + V10 + V12: the minimum end-to-end slice."""
    return split_report(split_daily(spark, sf_dir))


def q_daily_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C8 + K2: the cleaned and typed fact, from the dirty strings."""
    return Q.cleaned_daily(Q.parse_daily(daily_raw(spark, sf_dir)))


def q_daily_repair_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bracket repair log."""
    return Q.repair_log(Q.parse_daily(daily_raw(spark, sf_dir)))


def q_daily_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4-V8 + A16 (+ V5, V6, V7 counts) in one aggregate."""
    return Q.daily_gates(Q.parse_daily(daily_raw(spark, sf_dir)))


def q_daily_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 + A9 + A10 + T6: dense sorted codes vs the codes the fact carries."""
    d = stored(daily_sales(spark, sf_dir), "daily-sales")
    given = d.groupBy("product_id").agg(F.min("product_id_encoded").alias("given_code"),
                                        F.count(F.lit(1)).alias("rows"))
    dense = dense_code(d, "product_id", "dense_code")
    return (given.join(dense, "product_id")
            .withColumn("code_matches", F.col("given_code") == F.col("dense_code")))


def q_daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 + P7 + P8 keys: model matrix of the daily regressor, typed as the reference."""
    return model_matrix(split_daily(spark, sf_dir))


def q_daily_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL count per column of the cleaned fact."""
    return Q.null_counts(q_daily_cleaned(spark, sf_dir))


# Of the lines of the generated file, those whose hash begins below the first lose their last field, those below the second get one more.
FEW_BELOW, MANY_BELOW = "08", "10"


def daily_file(spark: SparkSession, sf_dir: str) -> str:
    """The dirty fact as a CSV of which some lines are malformed; returns its folder."""
    raw = daily_raw(spark, sf_dir)
    quoted = [F.when(F.col(c).rlike('[,"]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
              for c in Q.DAILY_COLUMNS]
    kind = F.substring(F.md5(F.concat_ws("|", F.coalesce("product_id", F.lit("")), F.coalesce("date", F.lit("")))), 1, 2)
    line = (F.when(kind < FEW_BELOW, F.concat_ws(",", *quoted[:-1])).when(kind < MANY_BELOW, F.concat_ws(",", *quoted, F.lit("more")))
            .otherwise(F.concat_ws(",", *quoted)))
    path = f"{scratch_path(spark, 'tables')}/daily-file-{uuid.uuid4().hex}"
    # a line is one value under the whole header, so every file begins with it; nothing is quoted again
    raw.select(line.alias(",".join(Q.DAILY_COLUMNS))).write.options(
        header="true", sep="\x01", quote="", escapeQuotes="false", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return path


def q_daily_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a generated file by what is wrong with their number of fields; whole ones go on to the gates."""
    parsed = stored(Q.parse_daily(read_daily_raw(spark, daily_file(spark, sf_dir))), "parsed")
    gates = Q.daily_gates(parsed)
    bad = Q.quarantined(parsed).groupBy("problem").agg(F.count(F.lit(1)).alias("lines"))
    return bad.unionByName(gates.select(F.lit("none").alias("problem"), F.col("rows").alias("lines"))).unionByName(
        gates.select(F.lit("any").alias("problem"), F.col("corrupt_rows").alias("lines")))


QUERIES = {
    "daily_sales": q_daily_sales,
    "daily_raw": q_daily_raw,
    "daily_split_report": q_daily_split_report,
    "daily_cleaned": q_daily_cleaned,
    "daily_repair_log": q_daily_repair_log,
    "daily_gates": q_daily_gates,
    "daily_product_codes": q_daily_product_codes,
    "daily_features": q_daily_features,
    "daily_null_counts": q_daily_null_counts,
    "daily_quarantine": q_daily_quarantine,
}

# ---------------------------------------------------------------- SQL oracle

NUM = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _rep(t: str) -> str:
    return rf"(coalesce(regexp_matches({t}, '^\s*[\[\(].*[\]\)]\s*$'), false) AND regexp_extract({t}, '{NUM}', 0) <> '')"


def _clean(col: str) -> str:
    t = _trim(col)
    unb = f"CASE WHEN {_rep(t)} THEN regexp_extract({t}, '{NUM}', 0) ELSE {t} END"
    cur = f"regexp_replace({unb}, '[$€£]', '', 'g')"
    sep = rf"CASE WHEN regexp_matches({cur}, '\d+[,.]\d+[,.]\d+') THEN replace({cur}, ',', '') ELSE {cur} END"
    tt = _trim(f"({sep})")
    return (rf"CASE WHEN regexp_matches({tt}, '^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$') "
            rf"THEN TRY_CAST({tt} AS DOUBLE) END")


_PARSED_COLS = ",\n    ".join(
    [f"{_trim(c)} AS {c}__trim, {_rep(_trim(c))} AS {c}__rep, {c} AS {c}__raw, {_clean(c)} AS {c}"
     for c in Q.DAILY_NUMERIC])

PARSED = A.DAILY_RAW + f""",
parsed AS (
  SELECT date AS date_raw, TRY_CAST(TRY_STRPTIME({_trim('date')}, '%Y-%m-%d') AS DATE) AS date, product_id,
    {_PARSED_COLS}
  FROM daily_raw)
"""

SPLIT = A.DAILY_SALES + """,
dd AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n
       FROM (SELECT DISTINCT date FROM daily_sales)),
split AS (
  SELECT s.*, CASE WHEN i < CAST(FLOOR(n * CAST(0.70 AS DOUBLE)) AS BIGINT) THEN 'train'
                   WHEN i < CAST(FLOOR(n * CAST(0.85 AS DOUBLE)) AS BIGINT) THEN 'val'
                   ELSE 'test' END AS split
  FROM daily_sales s JOIN dd USING (date))
"""

_CLEANED_SELECT = """
  SELECT date, product_id,
    CAST(TRUNC(CASE WHEN units_sold < 0 THEN 0.0 ELSE units_sold END) AS BIGINT) AS units_sold,
    CASE WHEN sale_price < 0 THEN 0.0 ELSE sale_price END AS sale_price,
    CAST(TRUNC(is_promo) AS INTEGER) AS is_promo,
    lag_7,
    CAST(TRUNC(product_id_encoded) AS INTEGER) AS product_id_encoded
  FROM parsed"""

_repairs = " UNION ALL ".join(
    f"SELECT product_id, date_raw AS date, '{c}' AS \"column\", {c}__trim AS original, "
    f"regexp_extract({c}__trim, '{NUM}', 0) AS repaired FROM parsed WHERE {c}__rep"
    for c in Q.DAILY_NUMERIC)

_gate_cols = ",\n    ".join(
    [f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_null, "
     f"count(*) FILTER (WHERE {c}__raw IS NOT NULL AND {c}__trim <> '' AND {c} IS NULL) AS {c}_lost" for c in Q.DAILY_NUMERIC])
_rep_sum = " + ".join(f"count(*) FILTER (WHERE {c}__rep)" for c in Q.DAILY_NUMERIC)

GATES = f"""
g AS (
  SELECT count(*) AS rows, count(*) FILTER (WHERE date IS NULL) AS bad_dates,
    {_gate_cols},
    {_rep_sum} AS repairs,
    count(*) FILTER (WHERE units_sold < 0) AS neg_units,
    count(*) FILTER (WHERE sale_price < 0) AS neg_price,
    count(*) FILTER (WHERE is_promo IS NULL OR is_promo NOT IN (0.0, 1.0)) AS promo_bad
  FROM parsed),
g2 AS (
  SELECT *, CAST(neg_units AS DOUBLE) / rows AS neg_units_share,
         CAST(neg_price AS DOUBLE) / rows AS neg_price_share FROM g),
g3 AS (
  SELECT *, concat_ws(',',
      CASE WHEN rows < {Q.MIN_DAILY_ROWS} THEN 'too_few_rows' END,
      CASE WHEN bad_dates > 0 THEN 'bad_dates' END,
      CASE WHEN neg_units_share >= {Q.NEGATIVE_SHARE_LIMIT} THEN 'negative_units' END,
      CASE WHEN neg_price_share >= {Q.NEGATIVE_SHARE_LIMIT} THEN 'negative_price' END,
      CASE WHEN promo_bad > 0 THEN 'is_promo_domain' END,
      CASE WHEN lag_7_null > 0 THEN 'lag_7_missing' END,
      CASE WHEN units_sold_null > 0 THEN 'units_sold_null' END,
      CASE WHEN product_id_encoded_null > 0 THEN 'code_null' END) AS reasons
  FROM g2)
SELECT *, CASE WHEN reasons = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM g3
"""

_NULLS = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in Q.DAILY_COLUMNS)

SQL = {
    "daily_sales": f"WITH {A.DAILY_SALES} SELECT * FROM daily_sales",
    "daily_raw": f"WITH {A.DAILY_RAW} SELECT * FROM daily_raw",
    "daily_split_report": f"""WITH {SPLIT},
rep AS (
  SELECT split, count(*) AS rows, count(DISTINCT date) AS dates, min(date) AS first_date,
         max(date) AS last_date, count(DISTINCT product_id) AS products,
         CAST(sum(units_sold) AS BIGINT) AS units_sold
  FROM split GROUP BY split),
rep2 AS (
  SELECT *, LEAD(first_date) OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END)
         AS next_first_date FROM rep)
SELECT *, coalesce(last_date < next_first_date, true) AS chronological FROM rep2""",
    "daily_cleaned": f"WITH {PARSED} {_CLEANED_SELECT}",
    "daily_repair_log": f"WITH {PARSED} {_repairs}",
    "daily_gates": f"WITH {PARSED}, {GATES}",
    "daily_product_codes": f"""WITH {A.DAILY_SALES}
SELECT g.product_id, g.given_code, g.rows, c.dense_code, g.given_code = c.dense_code AS code_matches
FROM (SELECT product_id, min(product_id_encoded) AS given_code, count(*) AS rows
      FROM daily_sales GROUP BY product_id) g
JOIN (SELECT product_id, CAST(ROW_NUMBER() OVER (ORDER BY product_id) - 1 AS INTEGER) AS dense_code
      FROM (SELECT DISTINCT product_id FROM daily_sales)) c USING (product_id)""",
    "daily_features": f"""WITH {SPLIT}
SELECT date, product_id, split, CAST(lag_7 AS FLOAT) AS lag_7, CAST(sale_price AS FLOAT) AS sale_price,
       CAST(is_promo AS TINYINT) AS is_promo, CAST(product_id_encoded AS INTEGER) AS product_id_encoded,
       CAST(units_sold AS FLOAT) AS target
FROM split""",
    "daily_quarantine": f"""WITH {A.DAILY_RAW},
kinds AS (SELECT CASE WHEN h < '{FEW_BELOW}' THEN 'too_few' WHEN h < '{MANY_BELOW}' THEN 'too_many' ELSE 'none' END AS problem
          FROM (SELECT substr(md5(coalesce(product_id, '') || '|' || coalesce(date, '')), 1, 2) AS h FROM daily_raw))
SELECT problem, count(*) AS lines FROM kinds GROUP BY problem UNION ALL SELECT 'any', count(*) FILTER (WHERE problem <> 'none') FROM kinds""",
    "daily_null_counts": f"WITH {PARSED}, cleaned AS ({_CLEANED_SELECT}) SELECT {_NULLS} FROM cleaned",
}
