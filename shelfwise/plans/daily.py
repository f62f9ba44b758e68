"""Daily demand job (entry 3): validate -> clean -> split -> fit -> metrics -> artifacts.

Actions happen only where the reference has a decision or an artifact: the
gate aggregate, the time-split cut-offs, the model fit, the metric aggregate
and the writes. The cleaned fact is written once (K2) and read back, which
cuts the lineage before the iterative fit (executor loss then recomputes
from that table, not from the raw CSV).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import quality as Q
from ..operators.boosting import Boosted, BoostConfig, best_round, ensemble, fit_boosted, split_gains  # noqa: F401
from ..operators.drift import EXACT_MOST, ks_two_sample
from ..operators.indexing import dense_code
from ..operators.split import apply_time_split, fit_time_split
from ..session import stored
from ..sources import sinks
from .contract import FeatureContract

FEATURES = ["lag_7", "sale_price", "is_promo", "product_id_encoded"]
# Reference budget: squared error, depth 6, learning rate 0.1, up to 500 rounds.
REFERENCE_ROUNDS, REFERENCE_DEPTH, REFERENCE_STEP = 500, 6, 0.1


@dataclass
class DailyConfig:
    max_iter: int = REFERENCE_ROUNDS
    max_depth: int = REFERENCE_DEPTH
    step_size: float = REFERENCE_STEP
    patience: int = 50              # rounds without a better validation error before it stops
    block: int = 10                 # rounds between two writes of the running prediction
    seed: int = 42
    max_bins: int = 64


def model_matrix(df: DataFrame) -> DataFrame:
    """P3 + P7: the four features (float32 / int8 / int32 as the reference) and the target."""
    return df.select(
        "date", "product_id", "split",
        F.col("lag_7").cast("float").alias("lag_7"),
        F.col("sale_price").cast("float").alias("sale_price"),
        F.col("is_promo").cast("tinyint").alias("is_promo"),
        F.col("product_id_encoded").cast("int").alias("product_id_encoded"),
        F.col("units_sold").cast("float").alias("target"))


MISSING = -1.0      # below every feature's least value (they are clipped at 0)


def filled(df: DataFrame) -> DataFrame:
    """Features with a missing value as ``MISSING``: MLlib trees take no NULL, but can split it off.

    So a missing value has a branch of its own, as in a booster that learns
    where to send it, and no row is lost.
    """
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("float"), F.lit(MISSING)), F.lit(MISSING)) for c in FEATURES})


@dataclass
class DailyFit:
    model: PipelineModel
    boosted: Boosted


def fit_daily(matrix: DataFrame, cfg: DailyConfig) -> DailyFit:
    """G3 + G11: boost on train, judge each round on val, stop after ``patience`` rounds without a better one.

    Rows without a target can't be fitted.
    """
    data = filled(matrix.where(F.col("target").isNotNull()))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    part = lambda name: assembler.transform(data.where(F.col("split") == name))
    boosted = fit_boosted(part("train"), part("val"), "features", "target", BoostConfig(
        rounds=cfg.max_iter, depth=cfg.max_depth, step=cfg.step_size, patience=cfg.patience, block=cfg.block,
        max_bins=cfg.max_bins, seed=cfg.seed))
    return DailyFit(PipelineModel(stages=[assembler, boosted.model]), boosted)


def fit_daily_model(matrix: DataFrame, cfg: DailyConfig) -> PipelineModel:
    """The model of ``fit_daily`` alone."""
    return fit_daily(matrix, cfg).model


def first_rounds(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the mean and the first ``n`` trees."""
    if n + 1 >= model.getNumTrees:
        return model
    trees = list(model._java_obj.trees())[:n + 1]
    return ensemble(trees, model.treeWeights[:n + 1], model.numFeatures, model.getFeaturesCol(), model.getPredictionCol())


def importance(model: PipelineModel) -> list[dict]:
    """Normalised gain importance per feature."""
    imp = model.stages[-1].featureImportances
    return [{"feature": f, "importance": float(imp[i])} for i, f in enumerate(FEATURES)]


def predictions(model: PipelineModel, matrix: DataFrame, contract: FeatureContract | None = None) -> DataFrame:
    """P8 (+ B2): date, product_id, true and predicted units, rounded forecast.

    With the contract that was saved beside the model (K8), a table of other feature types is refused.
    """
    if contract is not None:
        contract.check(matrix)
    scored = model.transform(filled(matrix))
    return scored.select("date", "product_id", "split", F.col("target").alias("true_units"),
                         F.col("prediction").alias("predicted_units"),
                         R.rounded_forecast(F.col("prediction")).alias("predicted_units_rounded"))


def evaluate(pred: DataFrame) -> DataFrame:
    """A11 + A13 per split, one aggregate; rows without a true value count, but have no error."""
    y, p = F.col("true_units").cast("double"), F.col("predicted_units").cast("double")
    err = y - p
    return (pred.groupBy("split")
            .agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(err)).alias("mae"),
                 F.sqrt(F.avg(err * err)).alias("rmse"),
                 (F.max(p) - F.min(p)).alias("pred_spread"), (F.max(y) - F.min(y)).alias("target_spread"))
            .withColumn("range_ratio", F.when(F.col("target_spread") == 0, F.lit(0.0))
                        .otherwise(F.col("pred_spread") / F.col("target_spread")))
            .withColumn("range_status", F.when(F.col("range_ratio") < 0.1, F.lit("WARNING"))
                        .otherwise(F.lit("PASS"))))


def prepare_fact(raw: DataFrame) -> tuple[DataFrame, dict]:
    """Steps 0-3: V1, C1-C8, V4-V8 (one aggregate), P6. Raises on a failed gate."""
    check = Q.check_exact_columns(raw.drop(Q.CORRUPT))
    if not check.ok:
        raise Q.ValidationError(f"column mismatch: missing={sorted(check.missing)} extra={sorted(check.extra)}")
    parsed = stored(Q.parse_daily(raw), "parsed")       # the file is parsed once; gates, repairs and fact read this
    gates = Q.daily_gates(parsed).first().asDict()
    Q.assert_gates(gates)
    whole = Q.whole_rows(parsed)
    return Q.drop_leakage(Q.cleaned_daily(whole)), {"gates": gates, "repairs": Q.repair_log(whole), "quarantine": Q.quarantined(parsed)}


def save_model(model: PipelineModel, matrix: DataFrame, out_dir: str) -> None:
    """K8: the model, and beside it the names and types of the features it was fitted on."""
    model.write().overwrite().save(f"{out_dir}/model")
    FeatureContract.of(matrix, FEATURES).save(matrix.sparkSession, f"{out_dir}/features")


def load_model(spark: SparkSession, out_dir: str) -> tuple[PipelineModel, FeatureContract]:
    """S8 + S9: the model of a run and its feature contract; refuses one that doesn't fit the other."""
    model, contract = PipelineModel.load(f"{out_dir}/model"), FeatureContract.load(spark, f"{out_dir}/features")
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        raise TypeError("loaded model is not a fitted tree-ensemble regressor")
    if last.numFeatures != len(contract.fields) or model.stages[0].getInputCols() != contract.names:
        raise TypeError(f"the model reads {model.stages[0].getInputCols()}, its contract names {contract.names}")
    return model, contract


def run(spark: SparkSession, raw: DataFrame, out_dir: str, cfg: DailyConfig | None = None) -> dict:
    """The whole daily job; returns the run summary (also written as K7)."""
    cfg = cfg or DailyConfig()
    summary: dict = {"status": "FAIL", "config": asdict(cfg)}
    try:
        cleaned, info = prepare_fact(raw)
        summary["gates"] = info["gates"]
        sinks.write_if_rows(info["repairs"], f"{out_dir}/repairs")                      # K3
        sinks.write_if_rows(info["quarantine"], f"{out_dir}/quarantine")                # S2: malformed lines, as they are
        sinks.write_parquet(cleaned, f"{out_dir}/cleaned")                              # K2
        fact = spark.read.parquet(f"{out_dir}/cleaned")                                 # lineage cut
        codes = dense_code(fact, "product_id", "dense_code")                            # E2
        mism = (fact.groupBy("product_id").agg(F.min("product_id_encoded").alias("given"))
                .join(codes, "product_id").where(F.col("given") != F.col("dense_code")).count())  # A10
        summary["encoder_mismatches"] = mism
        sinks.write_json_rows(codes.orderBy("dense_code"), f"{out_dir}/label_encoder")  # K6 + T6
        cut = fit_time_split(fact)                                                      # E4
        # T4: files sorted by (product, date) within each task; no repartition by
        # product, which would put a hot product into a single task.
        split = apply_time_split(fact, cut).sortWithinPartitions("product_id", "date")
        sinks.write_parquet(split, f"{out_dir}/splits", ["split"])                      # K4
        matrix = model_matrix(spark.read.parquet(f"{out_dir}/splits"))
        chrono = (matrix.groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
                  .collect())                                                            # V10 + V12
        bounds = {r["split"]: (r["lo"], r["hi"]) for r in chrono}
        ordered = all(bounds[a][1] < bounds[b][0] for a, b in (("train", "val"), ("val", "test"))
                      if a in bounds and b in bounds)
        if not ordered:
            raise Q.ValidationError("time split is not chronological")
        fitted = fit_daily(matrix, cfg)                                                 # G3
        model, boosted = fitted.model, fitted.boosted
        save_model(model, matrix, out_dir)                                              # K8
        sinks.write_json_rows(boosted.history_frame(spark), f"{out_dir}/history")       # G11
        pred = predictions(model, matrix.where(F.col("split").isin("val", "test")))
        sinks.write_parquet(pred.where(F.col("split") == "test"), f"{out_dir}/predictions")  # K5
        metrics = {r["split"]: r.asDict() for r in evaluate(pred).collect()}            # A11, A13
        ks = ks_two_sample(matrix, "target", "split", "train", "val", EXACT_MOST).first().asDict()  # A14
        imp = importance(model)
        sinks.write_json_rows(spark.createDataFrame(imp, "feature string, importance double"),
                              f"{out_dir}/importance")                                  # K6
        summary.update({
            "status": "PASS", "metrics": metrics, "drift_ks": ks, "feature_names": FEATURES,
            "importance": imp,                                                          # G7
            "gains": [r.asDict() for r in split_gains(spark, model.stages[-1], FEATURES).collect()],
            "n_trees": boosted.best_round, "best_iteration": boosted.best_round,         # G11
            "best_score": boosted.best_error, "rounds_fitted": boosted.rounds_fitted,
            "split": {"n_dates": cut.n_dates, "first_val_date": str(cut.first_val_date),
                      "first_test_date": str(cut.first_test_date)},
        })
    except Exception as e:  # FAIL summary, then re-raise
        summary["error"] = f"{type(e).__name__}: {e}"
        raise
    finally:
        summary["config_sha256"] = config_hash(spark, summary["config"])                # B16
        sinks.write_summary(spark, summary, f"{out_dir}/summary")                       # K7
    return summary


def config_hash(spark: SparkSession, cfg: dict) -> str:
    """SHA-256 of the configuration's canonical JSON, computed by Spark."""
    doc = json.dumps(cfg, sort_keys=True)
    return spark.range(1).select(F.sha2(F.lit(doc), 256).alias("h")).first()["h"]
