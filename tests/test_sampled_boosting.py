"""Boosted trees that draw rows and features: those of MLlib, in one job for each level; products are made once."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from shelfwise.operators import boosting as B
from shelfwise.session import stored
from shelfwise.sources import adapters as A


def noisy(spark, n=900, parts=3):
    rng = random.Random(7)
    rows = []
    for _ in range(n):
        x = [float(rng.randint(0, 9)), rng.random(), float(rng.randint(0, 2)), rng.gauss(0, 1), 5.0, float(rng.randint(0, 40))]
        rows.append((*x, 3 * x[0] + (4 if x[1] > 0.4 else 0) * x[2] - x[3] + 0.1 * x[5] + rng.gauss(0, 1)))
    names = [f"f{k}" for k in range(6)]
    df = VectorAssembler(inputCols=names, outputCol="x").transform(spark.createDataFrame(rows, [*names, "y"]))
    return stored(df.select("x", "y").repartition(parts), "rows")


def shape(tree):
    return [x.strip() for x in tree.toDebugString.split("\n")[1:] if "If" in x]


@pytest.mark.parametrize("rows,columns", [(0.8, 0.5), (1.0, 1.0)])
def test_trees_and_draws_are_those_of_mllib(spark, rows, columns):
    df = noisy(spark)
    cfg = B.SampledConfig(trees=8, depth=4, step=0.3, rows=rows, columns=columns, max_bins=16, seed=11, block=3)
    found = B.fit_sampled(df, "x", "y", cfg)
    mllib = GBTRegressor(featuresCol="x", labelCol="y", maxIter=8, maxDepth=4, stepSize=0.3, subsamplingRate=rows,
                         featureSubsetStrategy=str(columns) if columns < 1 else "all", seed=11, maxBins=16).fit(df)
    assert found.getNumTrees == 8 and list(found.treeWeights) == list(mllib.treeWeights)
    assert [shape(t) for t in found.trees] == [shape(t) for t in mllib.trees]
    both = mllib.transform(found.transform(df).withColumnRenamed("prediction", "a"))
    assert both.agg(F.max(F.abs(F.col("a") - F.col("prediction")))).first()[0] < 1e-9


def test_ties_of_features_that_split_the_same_rows_are_broken_as_mllib_breaks_them(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        month = rng.randint(1, 12)
        rows.append((float(rng.randint(0, 5)), float(month), float((month - 1) // 3), float(month > 6), 10 * rng.random() + month % 5))
    df = VectorAssembler(inputCols=["a", "month", "season", "half"], outputCol="x").transform(spark.createDataFrame(rows, ["a", "month", "season", "half", "y"]))
    df = stored(df.select("x", "y").coalesce(1), "rows")
    found = B.fit_sampled(df, "x", "y", B.SampledConfig(trees=8, depth=5, step=0.03, columns=0.8))
    mllib = GBTRegressor(featuresCol="x", labelCol="y", maxIter=8, maxDepth=5, stepSize=0.03, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42, maxBins=64).fit(df)
    assert [shape(t) for t in found.trees] == [shape(t) for t in mllib.trees]


def test_a_tree_costs_one_job_for_each_level_whatever_the_block(spark):
    df = noisy(spark, 300)

    def jobs(trees):
        group = f"sampled-{trees}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            B.fit_sampled(df, "x", "y", B.SampledConfig(trees=trees, depth=3, block=50))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(9) - jobs(4) <= 5 * 3


def test_draws_of_many_trees_and_blocks(spark):
    df = noisy(spark, 200)
    one, many = (B.fit_sampled(df, "x", "y", B.SampledConfig(trees=65, depth=1, step=0.1, block=k)) for k in (64, 7))
    assert [shape(t) for t in one.trees] == [shape(t) for t in many.trees] and one.getNumTrees == 65


def test_a_label_that_is_no_number_is_refused(spark):
    df = noisy(spark, 50)
    with pytest.raises(Exception, match="no number"):
        B.fit_sampled(df.withColumn("y", F.when(F.col("y") > 20, F.lit(None)).otherwise(F.col("y"))), "x", "y", B.SampledConfig(trees=1, depth=1))
    with pytest.raises(ValueError, match="no row"):
        B.fit_sampled(df.limit(0), "x", "y", B.SampledConfig(trees=1, depth=1))


def test_the_products_of_a_session_are_made_once(spark, monkeypatch, tmp_path):
    from shelfwise.catalog import models as M
    from shelfwise.catalog import products as PR
    from shelfwise.plans.pricing import PriceConfig
    made = []
    monkeypatch.setattr(PR, "retail_products", lambda s, d: made.append(d) or A.retail_products(s, d))
    monkeypatch.setattr(M, "PRICE_CFG", PriceConfig(price_trees=2, price_depth=2, units_trees=2, units_depth=2))
    sf = str(tmp_path)
    spark.sql("SELECT id AS p_partkey, concat('red ', id % 3) AS p_name, concat('Brand#', id % 4) AS p_brand, concat('T', id % 2) AS p_type, "
              "CAST(id % 5 AS INT) AS p_size, 100.0D + id AS p_retailprice FROM range(60)").write.parquet(f"{sf}/part.parquet")
    spark.sql("SELECT id % 60 AS l_partkey, CAST(id % 7 + 1 AS DOUBLE) AS l_quantity, 10.5D * (id % 11 + 1) AS l_extendedprice, 0.01D * (id % 9) AS l_discount, "
              "'R' AS l_returnflag, timestamp_ntz'1995-01-01 00:00:00' + make_interval(0, 0, 0, id % 300) AS l_shipdate FROM range(600)").write.parquet(f"{sf}/lineitem.parquet")
    assert M.q_price_model_scored(spark, sf).count() == 60
    assert M.q_price_model_eval(spark, sf).first()["rows"] + M.price_products(spark, sf).where("split = 'train'").count() == 60
    assert made == [sf]


def test_money_is_the_sum_of_decimals(spark):
    values = [0.1, 0.2, 19.99, -3.335, 1.005, 2.675, 1e9 + 0.01, 123456789012.345, None, 0.29, -0.0, 1 / 3, 8.125]
    df = spark.createDataFrame([(k % 4, v) for k, v in enumerate(values * 3)] + [(9, None)], "g int, v double")
    plain = F.sum(F.col("v").cast("decimal(18,2)")).cast("double")
    rows = df.groupBy("g").agg(A._money(F.col("v")).alias("a"), plain.alias("b")).collect()
    assert len(rows) == 5 and all(r["a"] == r["b"] for r in rows)
    whole = df.agg(A._money(F.col("v")).alias("a"), plain.alias("b")).first()
    assert whole["a"] == whole["b"]
