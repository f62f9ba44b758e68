"""Feature operators (E1-E9, A2, A3, U1, P5, P11, C9, C10) and business rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import rules as R
from shelfwise.operators import features as FE


def test_vocabulary_top_k_ties_forced_members(spark):
    rows = [("x",), ("x",), ("y",), ("y",), ("z",), (None,)]
    df = spark.createDataFrame(rows, "brand string")
    voc = FE.fit_vocabulary(df, ["brand"], ["Rolex"], top=2)
    got = {r["value"]: r["id"] for r in voc.collect()}
    # top-2 by count: x, y (tie broken by value); z dropped; forced: Rolex, Unknown, Other
    assert set(got) == {"x", "y", "Rolex", "Unknown", "Other"}
    assert got == {v: i for i, v in enumerate(sorted(got))}


def test_encode_unseen_to_other_and_null_to_unknown(spark):
    vocab = {"brand": {"Other": 0, "Unknown": 1, "x": 2}}
    df = spark.createDataFrame([("x",), ("never",), (None,)], "brand string")
    assert [r["brand"] for r in FE.encode(df, vocab).collect()] == [2, 0, 1]


def test_exact_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,)], "v double")
    assert FE.fit_medians(df, ["v"]).first()["median"] == 3.0


def test_date_features_and_engineered(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 1), "Rolex", 100.0, 49.99), (None, None, 10.0, None)],
                               "date date, brand string, original_price double, competitor_price double")
    out = FE.engineered(FE.date_features(df), FE.LUXURY_BRANDS).collect()
    assert out[0]["month"] == 2 and out[0]["day_of_week"] == "Thursday" and out[0]["is_luxury"] == 1
    assert out[0]["price_vs_competitor"] == pytest.approx(100.0 / 50.0)
    assert out[1]["month"] == 0 and out[1]["day_of_week"] == "Unknown" and out[1]["is_luxury"] == 0
    assert out[1]["price_vs_competitor"] is None


def test_prepare_imputes_with_fitted_medians(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("b", 3.0, None), ("a", None, 30.0)],
                               "brand string, original_price double, current_price double")
    state = FE.fit_price_features(df, ["a"])
    out = FE.prepare(df, state).collect()
    assert out[1]["current_price"] == 20.0 and out[2]["original_price"] == 2.0


def test_batch_ids_only_when_whole_column_blank(spark):
    blank = spark.createDataFrame([("", "k2"), (None, "k1")], "product_id string, sku string")
    ids = {r["sku"]: r["product_id"] for r in FE.batch_ids(blank, ["sku"]).collect()}
    assert ids == {"k1": "BATCH_0000", "k2": "BATCH_0001"}
    mixed = spark.createDataFrame([("", "k2"), ("P1", "k1")], "product_id string, sku string")
    assert {r["product_id"] for r in FE.batch_ids(mixed, ["sku"]).collect()} == {"", "P1"}


def test_defaults_and_coercion(spark):
    df = spark.createDataFrame([(" Nike ", "12.5", None)], "brand string, original_price string, rating string")
    out = FE.coerce_batch(FE.add_defaults(df)).first()
    assert out["brand"] == "Nike" and out["original_price"] == 12.5
    assert out["rating"] == 4.0 and out["material"] == "Standard" and out["stock_quantity"] == 100.0


def test_half_even_rounding_and_revenue(spark):
    # exact binary ties: half-even keeps the even digit
    df = spark.createDataFrame([(2.5, 0.375, -3.0), (3.5, 0.125, 7.5)], "u double, p double, neg double")
    r = df.select(R.rounded_units(F.col("u")).alias("u"), R.recommended_price(F.col("p")).alias("p"),
                  R.recommended_price(F.col("neg")).alias("n")).collect()
    assert [x["u"] for x in r] == [2, 4]
    assert [x["p"] for x in r] == [0.38, 0.12]
    assert r[0]["n"] == 0.0


def test_considerations_and_zero_views(spark):
    df = spark.createDataFrame([(6000.0, 1000.0, 10, 5.0, 0.3, 1.0, 0.0),
                                (100.0, 90.0, 60, 500.0, 0.1, 20.0, 500.0)],
                               "p double, cost double, u long, stock double, rr double, carts double, views double")
    c = [x["c"] for x in df.select(R.considerations(F.col("p"), F.col("cost"), F.col("u"), F.col("stock"),
                                                    F.col("rr"), F.col("carts"), F.col("views")).alias("c")).collect()]
    assert c[0] == ["high_markup", "niche", "inventory", "high_returns"]
    assert c[1] == ["balanced"]


def test_confidence_trend_tiers(spark):
    df = spark.createDataFrame([(11.0, 4), (5.0, 10), (0.0, 0)], "lag double, u long")
    r = df.select(R.confidence(F.col("lag")).alias("c"), R.trend(F.col("u"), F.col("lag")).alias("t"),
                  R.demand_tier(F.col("u")).alias("d")).collect()
    assert [x["c"] for x in r] == ["High", "Medium", "Low"]
    assert [x["t"] for x in r] == ["decrease", "increase", "none"]
    assert [x["d"] for x in r] == ["low", "low", "low"]


def test_relabel_and_label(spark):
    df = spark.createDataFrame([(0,), (4,)], "t int")
    r = df.select(R.relabel(F.col("t")).alias("y")).select("y", R.sentiment_label(F.col("y")).alias("s")).collect()
    assert [(x["y"], x["s"]) for x in r] == [(0, "Negative"), (1, "Positive")]


def test_medians_match_python_at_any_partitioning(spark):
    import random
    import statistics
    rng = random.Random(1)
    rows = [(rng.choice([None, 0.5, 2.0, -1.0, 7.25]), rng.randint(0, 50), None) for _ in range(301)]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(5)
    got = {r["column"]: r["median"] for r in FE.fit_medians(df, ["a", "b", "c"]).collect()}
    assert got == {"a": statistics.median([x for x, _, _ in rows if x is not None]),
                   "b": statistics.median([y for _, y, _ in rows]), "c": None}
