"""Dirty-value cases of the daily fact (C1-C8) and the repair log."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import cleaning as C
from shelfwise.operators import quality as Q

CASES = [
    (" 12\t", 12.0, False),
    ("[12.5, 3]", 12.5, True),
    ("(abc)", None, False),
    ("$1,234.56", 1234.56, False),
    ("1.234,56", 1.23456, False),
    ("1,234", None, False),
    ("5f", None, False),
    ("1_000", None, False),
    ("", None, False),
    ("nan", None, False),
    ("abc", None, False),
    (None, None, False),
    ("€7", 7.0, False),
    ("(-3e2)", -300.0, True),
    ("  [ 4 ]  ", 4.0, True),
]


def parsed(spark, values):
    """The daily cleaner's columns for texts in ``units_sold``."""
    rows = [(f"P{i}", raw) for i, raw in enumerate(values)]
    raw = spark.createDataFrame(rows, "product_id string, units_sold string")
    return Q.parse_daily(raw.select(*[c if c in raw.columns else F.lit(None).cast("string").alias(c) for c in Q.DAILY_COLUMNS]))


def test_clean_number_cases(spark):
    got = {int(r["product_id"][1:]): (r["units_sold"], r["units_sold__rep"]) for r in parsed(spark, [raw for raw, _, _ in CASES]).collect()}
    for i, (raw, want, rep) in enumerate(CASES):
        v, r = got[i]
        assert (v is None and want is None) or v == pytest.approx(want), (raw, v, want)
        assert bool(r) == rep, (raw, r)


def test_strip_all_removes_tabs_and_newlines(spark):
    row = spark.createDataFrame([("\t\n x \r\n",)], "s string").select(C.strip_all(F.col("s")).alias("t")).first()
    assert row["t"] == "x"


def test_repair_log_and_gates(spark):
    raw = spark.createDataFrame([
        ("2024-01-01", "A", "[5, 3]", "$10.00", "1", "4", "0"),
        ("2024-01-02", "A", "-1", "10", "0", "(x)", "0"),
        ("bad-date", "B", "3", "1.234,56", "2", "", "[1]"),
    ], ",".join(f"{c} string" for c in Q.DAILY_COLUMNS))
    parsed = Q.parse_daily(raw)
    log = {(r["date"], r["column"]): (r["original"], r["repaired"]) for r in Q.repair_log(parsed).collect()}
    assert log == {("2024-01-01", "units_sold"): ("[5, 3]", "5"),
                   ("bad-date", "product_id_encoded"): ("[1]", "1")}
    g = Q.daily_gates(parsed).first()
    assert g["rows"] == 3 and g["bad_dates"] == 1 and g["neg_units"] == 1
    assert g["promo_bad"] == 1            # is_promo = 2
    assert g["lag_7_null"] == 2 and g["lag_7_lost"] == 1     # '(x)' present but lost; '' -> NULL
    assert g["repairs"] == 2 and g["status"] == "FAIL"
    assert "too_few_rows" in g["reasons"] and "bad_dates" in g["reasons"]
    cleaned = {r["product_id"] + str(r["date"]): r for r in Q.cleaned_daily(parsed).collect()}
    assert cleaned["A2024-01-02"]["units_sold"] == 0          # C8 clip
    assert cleaned["A2024-01-01"]["sale_price"] == 10.0


def test_exact_column_order_check(spark):
    good = spark.createDataFrame([], ",".join(f"{c} string" for c in Q.DAILY_COLUMNS))
    assert Q.check_exact_columns(good).ok
    swapped = good.select(*reversed(Q.DAILY_COLUMNS))
    chk = Q.check_exact_columns(swapped)
    assert not chk.ok and not chk.missing and not chk.extra


def test_leakage_columns():
    cols = ["date", "product_id", "units_sold", "sale_price", "Revenue_total", "units_log1p",
            "wholesale_cost", "x_per_stock", "ordersX", "forecast", "lag_7", "my_demand"]
    assert Q.leakage_columns(cols) == ["Revenue_total", "units_log1p", "wholesale_cost", "x_per_stock",
                                       "ordersX", "forecast"]


def test_non_numeric_batch_rejects(spark):
    df = spark.createDataFrame([("1", "2.5"), ("x", "3")], "a string, b string")
    r = Q.non_numeric_batch(df, ["a", "b"]).first()
    assert r["a_bad"] == 1 and r["b_bad"] == 0 and not r["accepted"]
