"""Batch demand scoring with a fitted daily model (G6, with P4, V9, J1, F1, B2-B6, A5, A7).

One pass: rows of unknown products get a placeholder code for the vector and
their prediction is then set to NULL, so no second scan or union is needed.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.cleaning import to_number
from ..operators import quality as Q
from .contract import FeatureContract
from .daily import filled

# The request's columns and what they mean here.
REQUEST_MAPPING = {"units_last_week": "lag_7", "price": "sale_price", "promo": "is_promo", "sku": "product_id"}


def map_columns(req: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Caller column -> canonical name; other columns travel along."""
    missing = [src for src in mapping if src not in req.columns]
    if missing:
        raise ValueError(f"mapped columns not in the request: {missing}")
    rest = [c for c in req.columns if c not in mapping]
    return req.select(*rest, *[F.col(src).alias(dst) for src, dst in mapping.items()])


def reject_non_numeric(req: DataFrame, columns: list[str]) -> None:
    """V9: one aggregate; any non-numeric or missing value rejects the whole batch."""
    row = Q.non_numeric_batch(req, columns).first()
    if not row["accepted"]:
        bad = {c: row[f"{c}_bad"] for c in columns if row[f"{c}_bad"]}
        raise Q.ValidationError(f"non-numeric values in batch: {bad}")


def prepare_requests(req: DataFrame, encoder: DataFrame, mapping: dict[str, str] | None = None,
                     check: bool = True) -> DataFrame:
    """Typed request columns under their canonical names, and the product's code if known."""
    mapping = mapping or REQUEST_MAPPING
    if check:
        reject_non_numeric(req, [s for s, d in mapping.items() if d != "product_id"])
    m = map_columns(req, mapping)
    typed = m.withColumns({"lag_7": to_number(F.col("lag_7")), "sale_price": to_number(F.col("sale_price")),
                           "is_promo": to_number(F.col("is_promo")).cast("int")})
    enc = encoder.select("product_id", F.col(encoder.columns[1]).alias("product_encoded"))
    return typed.join(enc, "product_id", "left")                                     # J1 / J5


def with_forecast(prepared: DataFrame, prediction: Column) -> DataFrame:
    """F1, B2-B5 on a prediction column: NULL for unknown products."""
    out = prepared.withColumn("predicted_units_sold", F.when(F.col("product_encoded").isNotNull(), prediction))
    out = out.withColumn("predicted_units_sold_rounded", R.rounded_forecast(F.col("predicted_units_sold")))  # B2
    return out.withColumns({
        "expected_revenue": F.col("predicted_units_sold_rounded") * F.col("sale_price"),   # B3
        "confidence": R.confidence(F.col("lag_7")),                                         # B4
        "trend": R.trend(F.col("predicted_units_sold_rounded"), F.col("lag_7")),            # B5
    })


def score_requests(model: PipelineModel, req: DataFrame, encoder: DataFrame,
                   mapping: dict[str, str] | None = None, check: bool = True, contract: FeatureContract | None = None) -> DataFrame:
    """The request's rows with the model's forecast.

    Features go to the model beside the typed columns, in the types of the
    fit if its contract is given; a missing one is missing to the model as well
    (``daily.filled``), not a 0.
    """
    prepared = prepare_requests(req, encoder, mapping, check)
    features = prepared.select(F.struct("*").alias("__row"), "lag_7", "sale_price", "is_promo",
                               F.col("product_encoded").alias("product_id_encoded"))
    if contract is not None:
        features = contract.cast(features)
        contract.check(features)
    scored = model.transform(filled(features))
    return with_forecast(scored.select("__row.*", F.col("prediction").alias("__p")), F.col("__p")).drop("__p")


def summary(scored: DataFrame) -> DataFrame:
    """A7 + A5: success counts and forecast statistics (NULLs skipped, F7)."""
    p = F.col("predicted_units_sold")
    n, ok = F.count(F.lit(1)), F.count(p)
    return scored.agg(n.alias("total_rows"), ok.alias("successful"), (n - ok).alias("failed"),
                      (ok / n * 100).alias("success_rate"), F.avg(p).alias("mean_forecast"),
                      F.min(p).alias("min_forecast"), F.max(p).alias("max_forecast"),
                      F.coalesce(F.sum(p), F.lit(0.0)).alias("total_forecast"))


def single_forecast(spark, model: PipelineModel, encoder: DataFrame, product_id: str,
                    lag_7: float, sale_price: float, is_promo: int) -> dict:
    """Single daily forecast (J5 + S7 + B2-B6): a one-row request through the batch path.

    An unknown product is rejected, as the single-forecast page does.
    """
    known = encoder.where(F.col("product_id") == product_id).limit(1).count() > 0     # J5
    if not known:
        raise Q.ValidationError(f"unknown product {product_id!r}")
    req = spark.createDataFrame([(product_id, str(lag_7), str(sale_price), str(is_promo))],
                                "sku string, units_last_week string, price string, promo string")
    row = score_requests(model, req, encoder, check=False).withColumns({
        "price_text": R.price_text(F.col("sale_price")),                                  # B6
        "promo_text": R.promo_text(F.col("is_promo")),
        "confidence_text": R.confidence_text(F.col("confidence")),
    }).first()
    return row.asDict()
