"""The adapters written a second time, as DuckDB SQL CTEs, for the oracle.

Each constant is the body of a ``WITH`` list; queries append their own CTEs.
"""

DAILY_SALES = """
d1_day AS (
  SELECT p_brand AS product_id, CAST(l_shipdate AS DATE) AS date,
         SUM(l_quantity) AS qty,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS ext,
         MAX(CASE WHEN l_discount >= CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END) AS is_promo
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2),
d1_typed AS (
  SELECT product_id, date, CAST(qty AS BIGINT) AS units_sold, ext / qty AS sale_price,
         CAST(is_promo AS INTEGER) AS is_promo
  FROM d1_day),
d1_lagged AS (
  SELECT t.*, CAST(e.units_sold AS DOUBLE) AS lag_7
  FROM d1_typed t JOIN d1_typed e
    ON e.product_id = t.product_id AND CAST(e.date + INTERVAL 7 DAY AS DATE) = t.date),
d1_codes AS (
  SELECT product_id, CAST(ROW_NUMBER() OVER (ORDER BY product_id) - 1 AS INTEGER) AS product_id_encoded
  FROM (SELECT DISTINCT p_brand AS product_id FROM part)),
daily_sales AS (
  SELECT date, product_id, units_sold, sale_price, is_promo, lag_7, product_id_encoded
  FROM d1_lagged JOIN d1_codes USING (product_id))
"""

DAILY_RAW = DAILY_SALES + """,
d1s_k AS (
  SELECT *, ((date - DATE '1995-01-01') + product_id_encoded) % 13 AS k,
         CAST(ROUND(sale_price * 100) AS BIGINT) AS cents
  FROM daily_sales),
d1s_parts AS (
  SELECT *, cents // 100 AS dollars, LPAD(CAST(cents % 100 AS VARCHAR), 2, '0') AS cc FROM d1s_k),
d1s_fmt AS (
  SELECT *, CAST(dollars AS VARCHAR) || '.' || cc AS plain,
         CAST(dollars // 1000 AS VARCHAR) || ',' || LPAD(CAST(dollars % 1000 AS VARCHAR), 3, '0') AS thousands
  FROM d1s_parts),
daily_raw AS (
  SELECT CAST(date AS VARCHAR) AS date, product_id,
    CASE WHEN k = 0 THEN '[' || CAST(units_sold AS VARCHAR) || ', 3]'
         WHEN k = 1 THEN ' ' || CAST(units_sold AS VARCHAR) || chr(9)
         WHEN k = 2 THEN '(' || CAST(units_sold AS VARCHAR) || ')'
         ELSE CAST(units_sold AS VARCHAR) END AS units_sold,
    CASE WHEN k = 0 THEN '$' || CASE WHEN dollars >= 1000 THEN thousands || '.' || cc ELSE plain END
         WHEN k = 3 THEN '£ ' || plain
         WHEN k = 4 THEN CASE WHEN dollars >= 1000 THEN replace(thousands, ',', '.') || ',' || cc
                              ELSE CAST(dollars AS VARCHAR) || ',' || cc END
         WHEN k = 5 THEN ''
         WHEN k = 6 THEN '[' || plain || ']'
         WHEN k = 7 THEN '(abc)'
         WHEN k = 8 THEN ' ' || plain || ' '
         ELSE plain END AS sale_price,
    CASE WHEN k = 11 THEN ' ' || CAST(is_promo AS VARCHAR) || ' ' ELSE CAST(is_promo AS VARCHAR) END AS is_promo,
    CASE WHEN k = 9 THEN CAST(CAST(lag_7 AS BIGINT) AS VARCHAR) || '.0'
         WHEN k = 10 THEN ' ' || CAST(CAST(lag_7 AS BIGINT) AS VARCHAR)
         ELSE CAST(CAST(lag_7 AS BIGINT) AS VARCHAR) END AS lag_7,
    CASE WHEN k = 12 THEN '[' || CAST(product_id_encoded AS VARCHAR) || ']'
         ELSE CAST(product_id_encoded AS VARCHAR) END AS product_id_encoded
  FROM d1s_fmt)
"""

RETAIL_PRODUCTS = """
d2_sales AS (
  SELECT l_partkey, SUM(l_quantity) AS qty,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS ext,
         CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS disc,
         COUNT(*) AS lines, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returns,
         MAX(l_shipdate) AS last
  FROM lineitem GROUP BY l_partkey),
d2_type AS (
  SELECT p_type, CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS competitor_price
  FROM part GROUP BY p_type),
retail_products AS (
  SELECT 'P' || LPAD(CAST(p_partkey AS VARCHAR), 6, '0') AS product_id,
         p_type AS category,
         string_split(p_name, ' ')[2] AS subcategory,
         p_brand AS brand,
         string_split(p_name, ' ')[1] AS color,
         CAST(p_size AS VARCHAR) AS size,
         CASE WHEN month(CAST(last AS DATE)) IN (12, 1, 2) THEN 'Winter'
              WHEN month(CAST(last AS DATE)) IN (3, 4, 5) THEN 'Spring'
              WHEN month(CAST(last AS DATE)) IN (6, 7, 8) THEN 'Summer'
              WHEN month(CAST(last AS DATE)) IN (9, 10, 11) THEN 'Fall' END AS season,
         p_retailprice AS original_price,
         competitor_price,
         (disc / lines) * 100 AS discount_percentage,
         CAST(last AS DATE) AS date,
         CAST(returns AS DOUBLE) / lines AS return_rate,
         (ext / qty) * (CAST(1.0 AS DOUBLE) - disc / lines) AS current_price,
         CAST(qty AS BIGINT) AS units_sold
  FROM part LEFT JOIN d2_sales ON p_partkey = l_partkey JOIN d2_type USING (p_type))
"""
