"""Retail products: adapter, vocabulary, medians, prepared features, batch input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators.split import exact_split, hash_split, share_threshold
from ..session import stored
from ..sources.adapters import retail_products
from . import adapter_sql as A

# The luxury list is a parameter; for the supplied tables three brands that
# occur and one that does not (so the forced-member rule of U1 has work).
LUXURY_TESTDATA = ["Brand#1", "Brand#12", "Brand#23", "Brand#99"]
SPLIT_SEED = 42
TEST_SHARE = 0.2


def products_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 on D2."""
    return hash_split(retail_products(spark, sf_dir), "product_id", TEST_SHARE, SPLIT_SEED)


def products_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products_split(spark, sf_dir).where(F.col("split") == "train").drop("split")


def q_retail_products(spark, sf_dir):
    return products_split(spark, sf_dir)


def q_retail_split_exact(spark, sf_dir):
    """E10 with the exact size: the fifth of the products with the smallest hashes."""
    return exact_split(retail_products(spark, sf_dir), "product_id", TEST_SHARE, SPLIT_SEED).select("product_id", "split")


def q_price_vocabulary(spark, sf_dir):
    """A2 + U1 + E6 (fit): vocabulary with ids, all columns in one job."""
    return FE.vocabulary_frame(products_train(spark, sf_dir), LUXURY_TESTDATA)


def q_price_medians(spark, sf_dir):
    """A3: exact medians of the encoded training frame."""
    train = stored(products_train(spark, sf_dir), "products")      # the vocabulary and the medians read it
    state = FE.PriceFeatureState(LUXURY_TESTDATA)
    for r in FE.vocabulary_frame(train, LUXURY_TESTDATA).collect():
        state.vocab.setdefault(r["column"], {})[r["value"]] = r["id"]
    return FE.medians_frame(FE.encode(FE._pre_encode(train, LUXURY_TESTDATA), state.vocab))


def q_price_features(spark, sf_dir):
    """E1 + E3 + E5 + E6 + E8 = E9: prepared features of every product (fit on train)."""
    products = stored(products_split(spark, sf_dir), "products")   # fit and result read it
    state = FE.fit_price_features(products.where(F.col("split") == "train").drop("split"), LUXURY_TESTDATA)
    return FE.prepare(products, state)


def batch_request(spark, sf_dir) -> DataFrame:
    """What a caller uploads for bulk scoring: products without targets and ids."""
    return as_request(retail_products(spark, sf_dir))


def as_request(products: DataFrame) -> DataFrame:
    return products.select(F.col("product_id").alias("sku"), "category", "subcategory", "brand", "color",
                           "size", "season", "original_price", "competitor_price",
                           "discount_percentage", "date", "return_rate")


def q_batch_input(spark, sf_dir):
    """V2 + P5 + P11 + C9 + C10: batch page input preparation."""
    req = batch_request(spark, sf_dir)
    return FE.coerce_batch(FE.batch_ids(FE.add_defaults(req), ["sku"]))


def q_console_records(spark, sf_dir):
    """Products as hand-entered records (some with a blank subcategory)."""
    s = retail_products(spark, sf_dir)
    blank = F.substring(F.md5(F.col("product_id")), 1, 1).isin("0", "1", "2", "3")
    req = s.select(F.col("product_id").alias("sku"), "brand", "category",
                   F.col("original_price").cast("string").alias("original_price"),
                   F.when(blank, F.lit("  ")).otherwise(F.col("subcategory")).alias("subcategory"), "date")
    return FE.console_profile(req, today=False)


QUERIES = {
    "retail_products": q_retail_products,
    "retail_split_exact": q_retail_split_exact,
    "console_records": q_console_records,
    "price_vocabulary": q_price_vocabulary,
    "price_medians": q_price_medians,
    "price_features": q_price_features,
    "batch_input": q_batch_input,
}

# ---------------------------------------------------------------- SQL oracle

_LUX = ", ".join(f"'{b}'" for b in LUXURY_TESTDATA)
_T = share_threshold(TEST_SHARE)
_CATS = ["category", "subcategory", "brand", "color", "size", "season", "day_of_week"]
_NUMERIC = ["category", "subcategory", "brand", "color", "size", "season", "original_price",
            "competitor_price", "discount_percentage", "return_rate", "current_price", "units_sold",
            "month", "day_of_week", "is_luxury", "price_vs_competitor"]

PRODUCTS = A.RETAIL_PRODUCTS + f""",
products AS (
  SELECT *, CASE WHEN substr(md5(product_id || '|{SPLIT_SEED}'), 1, 4) < '{_T}' THEN 'test' ELSE 'train' END AS split
  FROM retail_products)
"""

SPLIT = PRODUCTS + f""",
pre AS (
  SELECT *, coalesce(month(date), 0) AS month, coalesce(dayname(date), 'Unknown') AS day_of_week,
         CAST(coalesce(brand IN ({_LUX}), false) AS INTEGER) AS is_luxury,
         current_price / (competitor_price + CAST(0.01 AS DOUBLE)) AS price_vs_competitor
  FROM products),
"""

_long = " UNION ALL ".join(
    f"SELECT '{c}' AS col, coalesce(CAST({c} AS VARCHAR), 'Unknown') AS value FROM pre WHERE split = 'train'"
    for c in _CATS)
_forced = ", ".join([f"('{c}', '{v}')" for c in _CATS for v in ("Unknown", "Other")]
                    + [f"('brand', '{b}')" for b in LUXURY_TESTDATA])

VOCAB = SPLIT + f"""
cnt AS (SELECT col, value, count(*) AS n FROM ({_long}) GROUP BY col, value),
topv AS (SELECT col, value FROM (
           SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS r FROM cnt)
         WHERE r <= {FE.TOP_VALUES}),
vocab AS (
  SELECT col, value, CAST(row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS INTEGER) AS id
  FROM (SELECT col, value FROM topv UNION SELECT * FROM (VALUES {_forced}) f(col, value)))
"""


def _enc(c: str) -> str:
    return (f"coalesce((SELECT id FROM vocab v WHERE v.col = '{c}' AND v.value = coalesce(CAST(p.{c} AS VARCHAR), 'Unknown')),"
            f" (SELECT id FROM vocab v WHERE v.col = '{c}' AND v.value = 'Other'))")


ENCODED = VOCAB + f""",
encoded AS (
  SELECT p.* REPLACE ({", ".join(f"{_enc(c)} AS {c}" for c in _CATS)})
  FROM pre p),
med AS (
  SELECT {", ".join(f"median(CAST({c} AS DOUBLE)) AS {c}" for c in _NUMERIC)}
  FROM encoded WHERE split = 'train')
"""

SQL = {
    "retail_products": f"WITH {PRODUCTS} SELECT * FROM products",
    "retail_split_exact": f"""WITH {A.RETAIL_PRODUCTS}
SELECT product_id, CASE WHEN row_number() OVER (ORDER BY md5(product_id || '|{SPLIT_SEED}')) <= ceil(count(*) OVER () / 5.0) THEN 'test' ELSE 'train' END AS split
FROM retail_products""",
    "price_vocabulary": f"WITH {VOCAB} SELECT col AS \"column\", value, id FROM vocab",
    "price_medians": f"WITH {ENCODED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS median FROM med" for c in _NUMERIC),
    "price_features": f"WITH {ENCODED} SELECT e.* REPLACE ("
    + ", ".join(f"coalesce(CAST(e.{c} AS DOUBLE), m.{c}) AS {c}" for c in _NUMERIC)
    + ") FROM encoded e, med m",
}

_BATCH_NUM_DEFAULTS = {c: (0.0 if c == "original_price" else float(FE.BATCH_DEFAULTS.get(c, 0.0)))
                       for c in FE.BATCH_NUMERIC}


def _num(src: str, name: str) -> str:
    t = rf"regexp_replace(CAST({src} AS VARCHAR), '^\s+|\s+$', '', 'g')"
    return (rf"coalesce(CASE WHEN regexp_matches({t}, '^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$') "
            rf"THEN TRY_CAST({t} AS DOUBLE) END, CAST({_BATCH_NUM_DEFAULTS[name]} AS DOUBLE))")


def _cat(c: str) -> str:
    return rf"regexp_replace(coalesce(CAST({c} AS VARCHAR), 'Unknown'), '^\s+|\s+$', '', 'g')"


_present = ["sku", "category", "subcategory", "brand", "color", "size", "season", "original_price",
            "competitor_price", "discount_percentage", "date", "return_rate"]


def _lit(v):
    if isinstance(v, str):
        return f"'{v}'"
    if isinstance(v, float):
        return f"CAST({v} AS DOUBLE)"
    return f"CAST({v} AS INTEGER)"


_added = [c for c in FE.BATCH_DEFAULTS if c not in _present and c != "product_id"]
_cols = []
for c in _present + ["product_id"] + _added:
    if c == "product_id":
        _cols.append("printf('BATCH_%04d', CAST(row_number() OVER (ORDER BY sku) - 1 AS BIGINT)) AS product_id")
    elif c in FE.BATCH_NUMERIC:
        src = c if c in _present else _lit(FE.BATCH_DEFAULTS[c])
        _cols.append(f"{_num(src, c)} AS {c}")
    elif c in FE.BATCH_CATEGORICAL:
        src = c if c in _present else _lit(FE.BATCH_DEFAULTS[c])
        _cols.append(f"{_cat(src)} AS {c}")
    elif c in _present:
        _cols.append(c)
    else:
        _cols.append(f"{_lit(FE.BATCH_DEFAULTS[c])} AS {c}")

SQL["batch_input"] = (f"WITH {PRODUCTS}, "
                      "req AS (SELECT product_id AS sku, category, subcategory, brand, color, size, season, "
                      "original_price, competitor_price, discount_percentage, date, return_rate "
                      "FROM products) "
                      f"SELECT {', '.join(_cols)} FROM req")


def _single_lit(c):
    return _lit(FE.SINGLE_DEFAULTS[c])


_console_cols = ["sku", "brand", "category", "date",
                 "coalesce(nullif(trim(subcategory), ''), 'General') AS subcategory",
                 r"CASE WHEN regexp_matches(regexp_replace(original_price, '^\s+|\s+$', '', 'g'), "
                 r"'^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$') "
                 r"THEN TRY_CAST(regexp_replace(original_price, '^\s+|\s+$', '', 'g') AS DOUBLE) END AS original_price"]
_console_cols += [f"{_single_lit(c)} AS {c}" for c in FE.SINGLE_DEFAULTS if c != "subcategory"]
SQL["console_records"] = (f"WITH {PRODUCTS}, "
                          "req AS (SELECT product_id AS sku, brand, category, CAST(original_price AS VARCHAR) AS original_price, "
                          "CASE WHEN substr(md5(product_id), 1, 1) IN ('0', '1', '2', '3') THEN '  ' ELSE subcategory END AS subcategory, "
                          "date FROM products), "
                          f"prof AS (SELECT {', '.join(_console_cols)} FROM req) "
                          "SELECT *, original_price IS NOT NULL AS price_ok FROM prof")
