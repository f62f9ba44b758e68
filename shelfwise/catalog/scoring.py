"""Scoring rules and reports on deterministic stand-in predictions.

The fitted models are checked separately (rows-only); here a fixed linear
formula stands in for each model so every rule, report and top-k has an
exact SQL oracle. ``standin_price`` / ``standin_units`` / ``standin_demand``
are those formulas, written once per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import quality as Q
from ..operators import report as REP
from ..plans import demand_scoring, price_batch
from ..plans.pricing import with_results
from ..session import stored
from ..sources.adapters import daily_sales, money_text
from . import adapter_sql as A
from .products import LUXURY_TESTDATA, PRODUCTS, _cols as BATCH_COLS, q_batch_input

# ---------------------------------------------------------------- stand-in models


def standin_price(df: DataFrame) -> F.Column:
    lux = F.col("brand").isin(*LUXURY_TESTDATA).cast("double")
    return ((F.col("original_price") - F.lit(880.0)) * F.lit(12.0) * (F.lit(1.0) - F.col("discount_percentage") / F.lit(100.0))
            + (F.col("competitor_price") - F.col("original_price")) * F.lit(0.25) + lux * F.lit(35.0))


def standin_units(price: F.Column) -> F.Column:
    return F.lit(260.0) - price * F.lit(0.15) + F.col("rating") * F.lit(5.0) - F.col("return_rate") * F.lit(100.0)


def standin_demand() -> F.Column:
    return (F.col("lag_7") * F.lit(0.8) + F.col("is_promo").cast("double") * F.lit(5.0)
            - F.col("sale_price") * F.lit(0.001) + F.lit(2.0))


SQL_PRICE = ("((original_price - CAST(880.0 AS DOUBLE)) * CAST(12.0 AS DOUBLE) * (CAST(1.0 AS DOUBLE) - discount_percentage / CAST(100.0 AS DOUBLE))"
             " + (competitor_price - original_price) * CAST(0.25 AS DOUBLE)"
             f" + CAST(brand IN ({', '.join(repr(b) for b in LUXURY_TESTDATA)}) AS DOUBLE) * CAST(35.0 AS DOUBLE))")
SQL_UNITS = ("(CAST(260.0 AS DOUBLE) - greatest(price_raw, CAST(0.0 AS DOUBLE)) * CAST(0.15 AS DOUBLE)"
             " + rating * CAST(5.0 AS DOUBLE) - return_rate * CAST(100.0 AS DOUBLE))")
SQL_DEMAND = ("(lag_7 * CAST(0.8 AS DOUBLE) + CAST(is_promo AS DOUBLE) * CAST(5.0 AS DOUBLE)"
              " - sale_price * CAST(0.001 AS DOUBLE) + CAST(2.0 AS DOUBLE))")

# ---------------------------------------------------------------- price batch


def score_batch(inp: DataFrame) -> DataFrame:
    """G4 shape: price -> clamp -> units (fed the clamped price) -> B1 -> P9."""
    price_raw = standin_price(inp)
    return with_results(inp, price_raw, standin_units(F.greatest(price_raw, F.lit(0.0))))


def q_batch_scored(spark, sf_dir):
    """G4 (stand-in) + B1 + P9: input columns plus the three result columns."""
    return score_batch(q_batch_input(spark, sf_dir))


def q_batch_summary(spark, sf_dir):
    """A3 + A4 + A5 + A6: batch totals, price distribution and average margin."""
    return price_batch.summary(q_batch_scored(spark, sf_dir))


TOP_COLUMNS = ["sku", "brand", "category", "Recommended_Price", "Predicted_Units_Sold", "Predicted_Revenue"]


def q_batch_top_revenue(spark, sf_dir):
    """Five highest predicted revenues (ties by sku)."""
    return REP.top_k(q_batch_scored(spark, sf_dir), "Predicted_Revenue", 5, "sku", TOP_COLUMNS)


def q_batch_top_units(spark, sf_dir):
    """Five highest predicted volumes (ties by sku)."""
    return REP.top_k(q_batch_scored(spark, sf_dir), "Predicted_Units_Sold", 5, "sku", TOP_COLUMNS)



def q_batch_filter_premium_revenue(spark, sf_dir):
    """F2 AND F4."""
    return REP.result_filter(q_batch_scored(spark, sf_dir), True, False, True).select(*TOP_COLUMNS)


def q_batch_filter_volume(spark, sf_dir):
    """F3."""
    return REP.result_filter(q_batch_scored(spark, sf_dir), False, True, False).select(*TOP_COLUMNS)


def q_price_insights(spark, sf_dir):
    """B8-B13 per scored product."""
    s = q_batch_scored(spark, sf_dir)
    p, u = F.col("Recommended_Price"), F.col("Predicted_Units_Sold")
    return s.select(
        "sku",
        R.margin_pct(p, F.col("original_price")).alias("margin_pct"),
        R.competitor_diff_pct(p, F.col("competitor_price")).alias("competitor_diff_pct"),
        R.market_position(p, F.col("competitor_price")).alias("market_position"),
        R.demand_tier(u).alias("demand_tier"),
        F.array_join(R.considerations(p, F.col("original_price"), u, F.col("stock_quantity"),
                                      F.col("return_rate"), F.col("cart_additions"),
                                      F.col("website_views")), ";").alias("considerations"),
        R.cart_conversion_pct(F.col("cart_additions"), F.col("website_views")).alias("cart_conversion_pct"),
    )

# ---------------------------------------------------------------- demand batch

UNKNOWN_EVERY = 11     # every 11th day the request names a product the encoder never saw


def demand_request(spark, sf_dir, fact: DataFrame | None = None) -> DataFrame:
    """A caller's CSV-like request: strings under the caller's own names."""
    d = daily_sales(spark, sf_dir) if fact is None else fact
    k = F.pmod(F.datediff("date", F.lit("1995-01-01")), F.lit(UNKNOWN_EVERY))
    pid = F.when(k == 0, F.concat(F.col("product_id"), F.lit("-NEW"))).otherwise(F.col("product_id"))
    return d.select("date", pid.alias("sku"),
                    F.col("lag_7").cast("long").cast("string").alias("units_last_week"),
                    money_text(F.col("sale_price")).alias("price"),
                    F.col("is_promo").cast("string").alias("promo"))


def demand_encoder(spark, sf_dir, fact: DataFrame | None = None) -> DataFrame:
    """The product encoder (E2) as a dimension table."""
    from ..operators.indexing import dense_code
    return dense_code(daily_sales(spark, sf_dir) if fact is None else fact, "product_id", "product_encoded")


def score_demand(req: DataFrame, encoder: DataFrame) -> DataFrame:
    """G6 (stand-in): map -> coerce -> left lookup -> score known -> round -> rules."""
    scored = demand_scoring.with_forecast(demand_scoring.prepare_requests(req, encoder, check=False), standin_demand())
    return scored.withColumn("price_text", R.price_text(F.col("sale_price")))                  # B6


def q_demand_batch_check(spark, sf_dir):
    """V9: non-numeric values per mapped column; any one rejects the batch."""
    req = demand_request(spark, sf_dir)
    return Q.non_numeric_batch(req, ["units_last_week", "price", "promo"])


def q_demand_batch(spark, sf_dir):
    """G6 (stand-in) + P4 + J1 + J5 + F1 + B2-B6; request and encoder read one written fact."""
    fact = stored(daily_sales(spark, sf_dir), "daily-sales")
    return score_demand(demand_request(spark, sf_dir, fact), demand_encoder(spark, sf_dir, fact))


def q_demand_texts(spark, sf_dir):
    """The three texts beside each forecast, counted."""
    fact = stored(daily_sales(spark, sf_dir), "daily-sales")
    scored = score_demand(demand_request(spark, sf_dir, fact), demand_encoder(spark, sf_dir, fact))
    texts = scored.select("price_text", R.promo_text(F.col("is_promo")).alias("promo_text"), R.confidence_text(F.col("confidence")).alias("confidence_text"))
    return texts.groupBy("price_text", "promo_text", "confidence_text").agg(F.count(F.lit(1)).alias("rows"))


def q_demand_batch_summary(spark, sf_dir):
    """A7 + A5 + F7: success counts and statistics of the valid forecasts."""
    return REP.rounded(demand_scoring.summary(q_demand_batch(spark, sf_dir)), "mean_forecast", "total_forecast")


QUERIES = {
    "batch_scored": q_batch_scored,
    "batch_summary": q_batch_summary,
    "batch_top_revenue": q_batch_top_revenue,
    "batch_top_units": q_batch_top_units,
    "batch_filter_premium_revenue": q_batch_filter_premium_revenue,
    "batch_filter_volume": q_batch_filter_volume,
    "price_insights": q_price_insights,
    "demand_batch_check": q_demand_batch_check,
    "demand_batch": q_demand_batch,
    "demand_texts": q_demand_texts,
    "demand_batch_summary": q_demand_batch_summary,
}

# ---------------------------------------------------------------- SQL oracle

BATCH = f"""{PRODUCTS},
req AS (SELECT product_id AS sku, category, subcategory, brand, color, size, season, original_price,
               competitor_price, discount_percentage, date, return_rate FROM products),
inp AS (SELECT {', '.join(BATCH_COLS)} FROM req),
raw AS (SELECT *, {SQL_PRICE} AS price_raw FROM inp),
raw2 AS (SELECT *, {SQL_UNITS} AS units_raw FROM raw),
scored AS (
  SELECT * EXCLUDE (price_raw, units_raw, ru),
         ru AS Predicted_Units_Sold, Recommended_Price * ru AS Predicted_Revenue
  FROM (SELECT *, round_even(greatest(price_raw, CAST(0.0 AS DOUBLE)), 2) AS Recommended_Price,
               CAST(round_even(greatest(units_raw, CAST(0.0 AS DOUBLE)), 0) AS BIGINT) AS ru FROM raw2))
"""

_TOPC = "sku, brand, category, Recommended_Price, Predicted_Units_Sold, Predicted_Revenue"

DEMAND = A.DAILY_SALES + f""",
dreq AS (
  SELECT date,
         CASE WHEN (date - DATE '1995-01-01') % {UNKNOWN_EVERY} = 0 THEN product_id || '-NEW' ELSE product_id END AS sku,
         CAST(CAST(lag_7 AS BIGINT) AS VARCHAR) AS units_last_week,
         CAST(CAST(ROUND(sale_price * 100) AS BIGINT) // 100 AS VARCHAR) || '.' ||
           LPAD(CAST(CAST(ROUND(sale_price * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS price, CAST(is_promo AS VARCHAR) AS promo
  FROM daily_sales),
enc AS (SELECT product_id, CAST(row_number() OVER (ORDER BY product_id) - 1 AS INTEGER) AS product_encoded
        FROM (SELECT DISTINCT product_id FROM daily_sales)),
typed AS (SELECT date, sku AS product_id, TRY_CAST(units_last_week AS DOUBLE) AS lag_7,
                 TRY_CAST(price AS DOUBLE) AS sale_price, CAST(TRY_CAST(promo AS DOUBLE) AS INTEGER) AS is_promo
          FROM dreq),
scored AS (
  SELECT t.*, e.product_encoded,
         CASE WHEN e.product_encoded IS NOT NULL THEN {SQL_DEMAND} END AS predicted_units_sold
  FROM typed t LEFT JOIN enc e USING (product_id)),
rounded AS (SELECT *, CAST(round_even(predicted_units_sold, 0) AS BIGINT) AS predicted_units_sold_rounded FROM scored)
"""

SQL = {
    "batch_scored": f"WITH {BATCH} SELECT * FROM scored",
    "batch_summary": f"""WITH {BATCH},
g AS (SELECT count(*) AS total_products,
             coalesce(CAST(sum(CAST(Predicted_Revenue AS DECIMAL(38,2))) AS DOUBLE), 0.0) AS total_revenue,
             CAST(coalesce(sum(Predicted_Units_Sold), 0) AS BIGINT) AS total_units,
             CAST(sum(CAST(Recommended_Price AS DECIMAL(38,2))) AS DOUBLE) / count(*) AS avg_price,
             min(Recommended_Price) AS min_price, median(Recommended_Price) AS median_price,
             max(Recommended_Price) AS max_price,
             CAST(sum(CAST(original_price AS DECIMAL(38,2))) AS DOUBLE) / count(*) AS avg_original
      FROM scored)
SELECT *, CASE WHEN avg_price > 0 THEN (avg_price - avg_original) / avg_price * 100 ELSE 0.0 END AS avg_margin FROM g""",
    "batch_top_revenue": f"WITH {BATCH} SELECT {_TOPC} FROM scored ORDER BY Predicted_Revenue DESC, sku LIMIT 5",
    "batch_top_units": f"WITH {BATCH} SELECT {_TOPC} FROM scored ORDER BY Predicted_Units_Sold DESC, sku LIMIT 5",
    "batch_filter_premium_revenue": f"WITH {BATCH} SELECT {_TOPC} FROM scored "
                                    f"WHERE Recommended_Price > {R.PREMIUM_PRICE} AND Predicted_Revenue > {R.HIGH_REVENUE}",
    "batch_filter_volume": f"WITH {BATCH} SELECT {_TOPC} FROM scored WHERE Predicted_Units_Sold > {R.HIGH_VOLUME}",
    "price_insights": f"""WITH {BATCH},
ins AS (
  SELECT sku,
    CASE WHEN Recommended_Price > 0 THEN (Recommended_Price - original_price) / Recommended_Price * 100 ELSE 0.0 END AS margin_pct,
    CASE WHEN competitor_price > 0 THEN (Recommended_Price - competitor_price) / competitor_price * 100 ELSE 0.0 END AS competitor_diff_pct,
    CASE WHEN Recommended_Price > competitor_price * CAST({R.MARKET_HIGH} AS DOUBLE) THEN 'higher'
         WHEN Recommended_Price < competitor_price * CAST({R.MARKET_LOW} AS DOUBLE) THEN 'lower' ELSE 'aligned' END AS market_position,
    CASE WHEN Predicted_Units_Sold < {R.LOW_DEMAND} THEN 'low' WHEN Predicted_Units_Sold > {R.HIGH_DEMAND} THEN 'high'
         ELSE 'moderate' END AS demand_tier,
    concat_ws(';',
      CASE WHEN Recommended_Price > original_price * {R.MARKUP_FACTOR} THEN 'high_markup' END,
      CASE WHEN Predicted_Units_Sold < {R.NICHE_UNITS} AND Recommended_Price > {R.NICHE_PRICE} THEN 'niche' END,
      CASE WHEN stock_quantity < Predicted_Units_Sold THEN 'inventory' END,
      CASE WHEN return_rate > CAST({R.HIGH_RETURN_RATE} AS DOUBLE) THEN 'high_returns' END,
      CASE WHEN website_views <> 0 AND cart_additions / website_views < CAST({R.LOW_CONVERSION} AS DOUBLE)
                AND website_views > {R.MIN_VIEWS} THEN 'low_conversion' END) AS c,
    CASE WHEN website_views > 0 THEN cart_additions / website_views * 100 ELSE 0.0 END AS cart_conversion_pct
  FROM scored)
SELECT * EXCLUDE (c), CASE WHEN c = '' THEN 'balanced' ELSE c END AS considerations FROM ins""",
    "demand_batch_check": f"""WITH {DEMAND.split(',' + chr(10) + 'enc AS')[0]},
chk AS (SELECT count(*) AS rows,
  {", ".join(f"count(*) FILTER (WHERE NOT coalesce(regexp_matches(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '^[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?$'), false)) AS {c}_bad" for c in ["units_last_week", "price", "promo"])},
FROM dreq)
SELECT *, units_last_week_bad + price_bad + promo_bad = 0 AS accepted FROM chk""",
    "demand_batch": f"""WITH {DEMAND}
SELECT *, predicted_units_sold_rounded * sale_price AS expected_revenue,
  CASE WHEN lag_7 > {R.HIGH_CONFIDENCE_LAG} THEN 'High' WHEN lag_7 > 0 THEN 'Medium' ELSE 'Low' END AS confidence,
  CASE WHEN predicted_units_sold_rounded < lag_7 * CAST({R.DECREASE_FACTOR} AS DOUBLE) THEN 'decrease'
       WHEN predicted_units_sold_rounded > lag_7 * CAST({R.INCREASE_FACTOR} AS DOUBLE) THEN 'increase' ELSE 'none' END AS trend,
  CASE WHEN sale_price > {R.TYPICAL_PRICE} THEN 'higher' ELSE 'lower' END AS price_text
FROM rounded""",
    "demand_texts": f"""WITH {DEMAND}
SELECT CASE WHEN sale_price > {R.TYPICAL_PRICE} THEN 'higher' ELSE 'lower' END AS price_text,
       CASE WHEN is_promo = 1 THEN '{R.PROMO_TEXT[1]}' ELSE '{R.PROMO_TEXT[0]}' END AS promo_text,
       CASE WHEN lag_7 > {R.HIGH_CONFIDENCE_LAG} THEN '{R.CONFIDENCE_TEXT["High"]}' WHEN lag_7 > 0 THEN '{R.CONFIDENCE_TEXT["Medium"]}'
            ELSE '{R.CONFIDENCE_TEXT["Low"]}' END AS confidence_text, count(*) AS rows
FROM rounded GROUP BY ALL""",
    "demand_batch_summary": f"""WITH {DEMAND}
SELECT count(*) AS total_rows, count(predicted_units_sold) AS successful,
       count(*) - count(predicted_units_sold) AS failed,
       count(predicted_units_sold) / count(*) * 100 AS success_rate,
       round(avg(predicted_units_sold), 6) AS mean_forecast,
       min(predicted_units_sold) AS min_forecast, max(predicted_units_sold) AS max_forecast,
       round(coalesce(sum(predicted_units_sold), 0.0), 6) AS total_forecast
FROM rounded""",
}
