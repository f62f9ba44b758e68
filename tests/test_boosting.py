"""Boosting that stops inside the fit, its history, gains by split, and the feature contract."""

import datetime as dt
import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from shelfwise.operators import boosting as B
from shelfwise.plans import daily as DJ
from shelfwise.plans.contract import FeatureContract


def noisy(spark, n=240, seed=4):
    """A step function of one feature, much noise, and a feature that says nothing."""
    rng = random.Random(seed)
    rows = [(float(k % 8), float(rng.randint(0, 9)), (5.0 if k % 8 > 3 else 1.0) + rng.gauss(0, 2), "train" if k % 3 else "val") for k in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, y double, split string")
    return VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)


def parts(df):
    return df.where("split = 'train'"), df.where("split = 'val'")


def rmse(model, df):
    return model.transform(df).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0]


def test_the_fit_ends_by_itself_and_keeps_the_best_round(spark):
    train, val = parts(noisy(spark))
    found = B.fit_boosted(train, val, "x", "y", B.BoostConfig(rounds=300, depth=3, step=0.5, patience=4, block=3))
    assert found.stopped_early and found.rounds_fitted < 30                 # of 300 rounds
    errors = [e for _, e in found.history]
    assert found.best_error == min(errors) == errors[found.best_round]
    assert len(errors) == found.best_round + 4 + 1                          # it ended after patience rounds
    assert found.model.getNumTrees == found.best_round + 1                  # the mean, and the trees kept
    assert rmse(found.model, val) == pytest.approx(found.best_error, abs=1e-9)
    mean = train.agg(F.avg("y")).first()[0]
    assert errors[0] == pytest.approx(val.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.lit(mean), 2)))).first()[0], abs=1e-9)
    rows = found.history_frame(spark).orderBy("round").collect()
    assert [r["round"] for r in rows if r["best"]] == [found.best_round] and sum(r["kept"] for r in rows) == found.best_round + 1


def test_blocks_change_nothing_and_history_is_that_of_the_model(spark):
    train, val = parts(noisy(spark))
    cfg = dict(rounds=6, depth=2, step=0.3, patience=50)
    a, b = (B.fit_boosted(train, val, "x", "y", B.BoostConfig(block=k, **cfg)) for k in (1, 4))
    assert [e for _, e in a.history] == pytest.approx([e for _, e in b.history], abs=1e-9)
    assert not a.stopped_early and a.rounds_fitted == 6 and len(a.history) == 7
    whole = B.ensemble(list(a.model._java_obj.trees()), a.model.treeWeights, 2, "x")
    for k in range(a.best_round + 1):
        assert rmse(DJ.first_rounds(whole, k), val) == pytest.approx(a.history[k][1], abs=1e-9)


def test_without_validation_rows_all_rounds_are_kept(spark):
    train, val = parts(noisy(spark, 60))
    found = B.fit_boosted(train, val.limit(0), "x", "y", B.BoostConfig(rounds=3, depth=2, patience=1, block=2))
    assert found.best_round == found.rounds_fitted == 3 and found.history == [] and found.best_error is None
    none = B.fit_boosted(train, None, "x", "y", B.BoostConfig(rounds=0))
    assert none.model.getNumTrees == 1 and rmse(none.model, train) == pytest.approx(train.agg(F.stddev_pop("y")).first()[0])


def test_stopping_waits_and_ignores_what_comes_after():
    s = B.Stopping(2)
    for e in (5, 4, 4, 4.5, 1):
        s.see(e)
    assert (s.best, s.done, s.errors) == (1, True, [5, 4, 4, 4.5])
    with pytest.raises(ValueError):
        B.fit_boosted(None, None, "x", "y", B.BoostConfig(block=0))


def test_gains_are_those_of_the_model(spark, tmp_dir):
    train, val = parts(noisy(spark))
    model = B.fit_boosted(train, val, "x", "y", B.BoostConfig(rounds=5, depth=3, patience=50)).model
    rows = B.split_gains(spark, model, ["a", "b"]).collect()
    assert [r["feature"] for r in sorted(rows, key=lambda r: r["feature"])] == ["a", "b"]
    by = {r["feature"]: r for r in rows}
    assert [by["a"]["importance"], by["b"]["importance"]] == pytest.approx(list(model.featureImportances.toArray()), abs=1e-9)
    assert by["a"]["splits"] + by["b"]["splits"] == sum(t.numNodes // 2 for t in model.trees)
    for r in rows:
        assert r["average_gain"] == pytest.approx(r["total_gain"] / r["splits"] if r["splits"] else 0.0)
    model.write().overwrite().save(f"{tmp_dir}/m")
    assert {r["feature"]: r["splits"] for r in B.split_gains(spark, model, ["a", "b"], f"{tmp_dir}/m").collect()} == {k: v["splits"] for k, v in by.items()}


def matrix(spark, n=90):
    rows = [(dt.date(2024, 1, 1), "p", "train" if k % 4 else "val", float(k % 9), 5.0, k % 2, 1, float(k % 9)) for k in range(n)]
    return spark.createDataFrame(rows, "date date, product_id string, split string, lag_7 float, sale_price float, is_promo byte, product_id_encoded int, target float")


def test_a_table_of_other_types_is_refused(spark, tmp_dir):
    m = matrix(spark)
    model = DJ.fit_daily_model(m, DJ.DailyConfig(max_iter=2, max_depth=2))
    DJ.save_model(model, m, tmp_dir)
    again, contract = DJ.load_model(spark, tmp_dir)
    assert contract.fields == (("lag_7", "float"), ("sale_price", "float"), ("is_promo", "tinyint"), ("product_id_encoded", "int"))
    assert DJ.predictions(again, m, contract).count() == 90
    with pytest.raises(TypeError, match="lag_7 is string, not float"):
        DJ.predictions(again, m.withColumn("lag_7", F.col("lag_7").cast("string")), contract)
    with pytest.raises(TypeError, match="is_promo is missing"):
        DJ.predictions(again, m.drop("is_promo"), contract)
    casted = contract.cast(m.withColumn("lag_7", F.lit("x")).withColumn("is_promo", F.lit("1")))
    contract.check(casted)
    assert casted.first()["lag_7"] is None and casted.first()["is_promo"] == 1


def test_a_model_with_the_contract_of_another_is_refused(spark, tmp_dir):
    m = matrix(spark)
    DJ.save_model(DJ.fit_daily_model(m, DJ.DailyConfig(max_iter=1, max_depth=2)), m, tmp_dir)
    FeatureContract((("sale_price", "float"), ("lag_7", "float"), ("is_promo", "tinyint"), ("product_id_encoded", "int"))).save(spark, f"{tmp_dir}/features")
    with pytest.raises(TypeError, match="contract names"):
        DJ.load_model(spark, tmp_dir)


def test_running_predictions_are_deleted(spark):
    from shelfwise.session import scratch_path
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "tables"))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    train, val = parts(noisy(spark, 60))
    B.fit_boosted(train, val, "x", "y", B.BoostConfig(rounds=5, depth=2, block=2, patience=50))
    assert not [s for s in files.listStatus(folder) if s.getPath().getName().startswith("margins-")]


def test_errors_of_a_block_are_finite(spark):
    train, val = parts(noisy(spark, 60))
    found = B.fit_boosted(train, val, "x", "y", B.BoostConfig(rounds=4, depth=2, block=2, patience=50))
    assert all(math.isfinite(e) for _, e in found.history) and len(found.history) == 5


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_round_is_one_job_for_each_level(spark):
    train, val = parts(noisy(spark))
    jobs = [jobs_of(spark, f"rounds-{k}", lambda k=k: B.fit_boosted(train, val, "x", "y", B.BoostConfig(rounds=k, depth=2, block=9, patience=50))) for k in (2, 7)]
    assert jobs[1] - jobs[0] <= 5 * 2


def test_copies_of_rows_are_the_same_cells_and_trees(spark):
    train, val = parts(noisy(spark))
    copies = train.crossJoin(spark.range(20)).drop("id")
    cfg = B.BoostConfig(rounds=4, depth=3, patience=50)
    cuts = B.cut_points(train, "x", 2, 64)
    assert B.cells_of(copies, None, "x", "y", cuts).count() == B.cells_of(train, None, "x", "y", cuts).count() <= 80
    a, b = B.fit_boosted(train, val, "x", "y", cfg), B.fit_boosted(copies, val, "x", "y", cfg)
    assert [e for _, e in a.history] == pytest.approx([e for _, e in b.history], abs=1e-9)


def test_trees_are_those_of_mllib(spark):
    from pyspark.ml.regression import DecisionTreeRegressor
    train, _ = parts(noisy(spark, 300))
    base = train.agg(F.avg("y")).first()[0]
    found = B.fit_boosted(train, None, "x", "y", B.BoostConfig(rounds=2, depth=4, max_bins=6)).model.trees
    first = DecisionTreeRegressor(featuresCol="x", labelCol="r", maxDepth=4, maxBins=6).fit(train.withColumn("r", F.col("y") - base))
    second = DecisionTreeRegressor(featuresCol="x", labelCol="r", maxDepth=4, maxBins=6).fit(
        first.transform(train).withColumn("r", F.col("y") - base - 0.1 * F.col("prediction")).drop("prediction"))

    def shape(tree):
        return [x for x in tree.toDebugString.split("\n")[1:] if "If" in x]

    assert [shape(t) for t in found[1:]] == [shape(first), shape(second)]
    for t, m in zip(found[1:], (first, second)):
        row = m.transform(train.select("x")).withColumnRenamed("prediction", "a")
        assert t.transform(row).agg(F.max(F.abs(F.col("a") - F.col("prediction")))).first()[0] < 1e-9


def test_bounds_of_many_values_come_from_all_of_them(spark, monkeypatch):
    monkeypatch.setattr(B, "PIECES", 400)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(spark.range(3000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b")))
    many, few = B.cut_points(df, "x", 2, 16)
    assert few == [0.5, 1.5] and len(many) == 15
    assert all(abs(c - 3000 / 16 * (k + 1)) <= 3000 / 100 for k, c in enumerate(many))
