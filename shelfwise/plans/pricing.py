"""Chained price -> units models (entries 1 and 2): G1, G2, G4, G5, G10, K8, S8, S9.

Fit: prepare (E9 fit) -> price GBT -> its *unclamped* prediction becomes a
feature -> units GBT; the trees are those of MLlib's GBTRegressor (``fit_sampled``). Score: prepare (E9 apply) -> price -> clamp -> units ->
clamp -> B1 rounding -> revenue, appended to the caller's own columns (P9).
Everything after the fit is one lazy projection chain: no shuffle.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import features as FE
from ..operators.boosting import SampledConfig, fit_sampled
from ..session import forget, stored

# Reference budgets (kept as named defaults; tests pass smaller ones).
PRICE_TREES, PRICE_DEPTH = 1000, 8
UNITS_TREES, UNITS_DEPTH = 1000, 7
LEARNING_RATE, SUBSAMPLE, SEED = 0.03, 0.8, 42
RESULT_COLUMNS = ["Recommended_Price", "Predicted_Units_Sold", "Predicted_Revenue"]
_KEEP = "__in_"   # prefix under which the caller's original columns travel through scoring


@dataclass
class PriceConfig:
    price_trees: int = PRICE_TREES
    price_depth: int = PRICE_DEPTH
    units_trees: int = UNITS_TREES
    units_depth: int = UNITS_DEPTH
    step_size: float = LEARNING_RATE
    subsample: float = SUBSAMPLE
    seed: int = SEED
    max_bins: int = 64          # >= largest vocabulary (50 + luxury + 2)


def regression_report(scored: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows, and RMSE and R^2 of each named (truth, prediction); one aggregate."""
    out = []
    for name, (y, p) in pairs.items():
        e = y - p
        out += [F.sqrt(F.avg(e * e)).alias(f"{name}_rmse"),
                (F.lit(1.0) - F.try_divide(F.sum(e * e), F.count(y) * F.var_pop(y))).alias(f"{name}_r2")]
    return scored.agg(F.count(F.lit(1)).alias("rows"), *out)


def with_results(df: DataFrame, price: Column, units: Column) -> DataFrame:
    """B1 + P9: rounded price and units of the two predictions, and the revenue."""
    out = df.withColumns({"Recommended_Price": R.recommended_price(price), "Predicted_Units_Sold": R.rounded_units(units)})
    return out.withColumn("Predicted_Revenue", R.revenue(F.col("Recommended_Price"), F.col("Predicted_Units_Sold")))


def _fitted(df: DataFrame, inputs: list[str], features: str, label: str, prediction: str, cfg: SampledConfig) -> PipelineModel:
    """Assembler and boosted trees fitted on ``df``, of which only the features and the label are written."""
    assembler = VectorAssembler(inputCols=inputs, outputCol=features)
    rows = stored(assembler.transform(df).select(features, label), "features")
    trees = fit_sampled(rows, features, label, cfg).setPredictionCol(prediction)
    forget(rows)
    return PipelineModel([assembler, trees])


class PriceUnitsModel:
    def __init__(self, state: FE.PriceFeatureState, price: PipelineModel, units: PipelineModel,
                 cfg: PriceConfig):
        self.state, self.price, self.units, self.cfg = state, price, units, cfg

    # ------------------------------------------------------------ fit
    @classmethod
    def fit(cls, train: DataFrame, luxury: list[str] = FE.LUXURY_BRANDS,
            cfg: PriceConfig | None = None) -> "PriceUnitsModel":
        cfg = cfg or PriceConfig()
        data = stored(FE.add_defaults(train, {k: v for k, v in FE.BATCH_DEFAULTS.items()
                                              if k not in ("product_id", "current_price", "units_sold")}), "products")
        state = FE.fit_price_features(data, luxury, keep=False)
        needed = dict.fromkeys(FE.PRICE_FEATURES + FE.UNITS_FEATURES + ["current_price", "units_sold"])
        prepared = stored(FE.prepare(data, state).select(*needed), "products")
        share = cfg.subsample      # of the rows for both models, of the columns for the price model only
        price = _fitted(prepared, FE.PRICE_FEATURES, "price_features", "current_price", "predicted_price",
                        SampledConfig(cfg.price_trees, cfg.price_depth, cfg.step_size, share, share, cfg.max_bins, cfg.seed))
        chained = price.transform(prepared)          # unclamped at fit time (G2)
        units = _fitted(chained, ["predicted_price"] + FE.UNITS_FEATURES, "units_features", "units_sold", "predicted_units",
                        SampledConfig(cfg.units_trees, cfg.units_depth, cfg.step_size, share, 1.0, cfg.max_bins, cfg.seed))
        forget(data)
        forget(prepared)
        return cls(state, price, units, cfg)

    # ------------------------------------------------------------ score
    def _raw_scores(self, df: DataFrame) -> DataFrame:
        kept = df.select(*[F.col(c).alias(_KEEP + c) for c in df.columns], *df.columns)
        # without a current price the original price is compared (E5); only the batch page adds one
        data = FE.add_defaults(kept, {k: v for k, v in FE.BATCH_DEFAULTS.items()
                                      if k not in ("product_id", "current_price", "units_sold")}, today=True)
        prepared = FE.prepare(data, self.state)
        p = self.price.transform(prepared)
        p = p.withColumn("predicted_price", F.greatest(F.col("predicted_price"), F.lit(0.0)))   # clamp (G2)
        u = self.units.transform(p)
        return u

    def predict_batch(self, df: DataFrame) -> DataFrame:
        """G4 + B1 + P9: caller's columns + Recommended_Price, Predicted_Units_Sold, Predicted_Revenue."""
        u = self._raw_scores(df)
        out = with_results(u.drop(*RESULT_COLUMNS), F.col("predicted_price"), F.col("predicted_units"))
        return out.select(*[F.col(_KEEP + c).alias(c) for c in df.columns], *RESULT_COLUMNS)

    def predict_single(self, spark: SparkSession, record: dict) -> dict:
        """A batch of one through the same path."""
        from ..sources.readers import one_record
        row = self.predict_batch(one_record(spark, record)).first()
        return {c: row[c] for c in RESULT_COLUMNS}

    def evaluate(self, test: DataFrame) -> DataFrame:
        """G10 + A12: RMSE and R^2 of both models on hold-out (targets imputed as at fit)."""
        return regression_report(self._raw_scores(test), {
            "price": (F.col("current_price"), F.col("predicted_price")),
            "units": (F.col("units_sold").cast("double"), F.greatest(F.col("predicted_units"), F.lit(0.0)))})

    # ------------------------------------------------------------ persistence
    def save(self, path: str) -> None:
        """K8: both pipelines via MLWriter, fitted parameters as JSON (no pickle)."""
        self.price.write().overwrite().save(f"{path}/price")
        self.units.write().overwrite().save(f"{path}/units")
        spark = SparkSession.getActiveSession()
        doc = json.dumps({"state": self.state.to_json(), "config": asdict(self.cfg)})
        spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PriceUnitsModel":
        """S8 + S9: load and check that both stages are fitted regressors."""
        doc = json.loads(spark.read.text(f"{path}/state").first()["value"])
        price, units = PipelineModel.load(f"{path}/price"), PipelineModel.load(f"{path}/units")
        for m in (price, units):
            if not hasattr(m.stages[-1], "featureImportances"):
                raise TypeError("loaded model is not a fitted tree-ensemble regressor")
        return cls(FE.PriceFeatureState.from_json(doc["state"]), price, units, PriceConfig(**doc["config"]))
