"""Fit/score invariants of the models and the end-to-end jobs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfwise.catalog import products as PR
from shelfwise.catalog.scoring import demand_encoder, demand_request
from shelfwise.plans import daily as DJ
from shelfwise.plans import sentiment as SJ
from shelfwise.plans.demand_scoring import score_requests, summary
from shelfwise.plans.pricing import PriceConfig, PriceUnitsModel
from shelfwise.sources import readers, sinks
from shelfwise.sources.adapters import daily_raw

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

SMALL = PriceConfig(price_trees=5, price_depth=3, units_trees=5, units_depth=3)


@pytest.fixture(scope="module")
def price_model(spark):
    return PriceUnitsModel.fit(PR.products_train(spark, SF_SMALL), PR.LUXURY_TESTDATA, SMALL)


def test_price_scores_invariants(spark, price_model):
    req = PR.batch_request(spark, SF_SMALL)
    out = price_model.predict_batch(req)
    assert out.columns == req.columns + ["Recommended_Price", "Predicted_Units_Sold", "Predicted_Revenue"]
    bad = out.where((F.col("Recommended_Price") < 0) | (F.col("Predicted_Units_Sold") < 0) |
                    (F.abs(F.col("Predicted_Revenue") - F.col("Recommended_Price") * F.col("Predicted_Units_Sold")) > 1e-6))
    assert bad.count() == 0 and out.count() == req.count()


def test_single_equals_batch_of_one_and_save_load(spark, price_model, tmp_dir):
    req = PR.batch_request(spark, SF_SMALL).orderBy("sku").limit(1)
    rec = req.first().asDict()
    single = price_model.predict_single(spark, rec)
    batch = price_model.predict_batch(req).first()
    assert single == {c: batch[c] for c in single}
    price_model.save(f"{tmp_dir}/price")
    again = PriceUnitsModel.load(spark, f"{tmp_dir}/price").predict_batch(req).first()
    assert again == batch


def test_csv_roundtrip_scoring(spark, price_model, tmp_dir):
    req = PR.batch_request(spark, SF_SMALL).drop("date")
    sinks.write_csv(req, f"{tmp_dir}/req")
    back = readers.read_products_csv(spark, f"{tmp_dir}/req")
    scored = price_model.predict_batch(back.withColumnRenamed("sku", "product_id"))
    path = sinks.write_csv(scored, sinks.timestamped(tmp_dir, "scored"))
    assert spark.read.option("header", True).csv(path).count() == req.count()


def test_daily_job_end_to_end(spark, tmp_dir):
    sinks.write_csv(daily_raw(spark, SF_MID), f"{tmp_dir}/raw")
    raw = readers.read_daily_raw(spark, f"{tmp_dir}/raw")
    out = f"{tmp_dir}/run"
    summ = DJ.run(spark, raw, out, DJ.DailyConfig(max_iter=8, max_depth=4))
    assert summ["status"] == "PASS" and summ["encoder_mismatches"] == 0
    assert set(summ["metrics"]) == {"val", "test"} and summ["n_trees"] >= 1
    assert len(summ["config_sha256"]) == 64
    for part in ("cleaned", "splits/split=train", "predictions", "model", "label_encoder", "repairs",
                 "importance"):
        assert os.path.exists(f"{out}/{part}"), part
    doc = json.loads(spark.read.text(f"{out}/summary").first()["value"])
    assert doc["status"] == "PASS"


def test_daily_job_rejects_order_only_mismatch(spark, tmp_dir):
    raw = daily_raw(spark, SF_SMALL)
    swapped = raw.select("product_id", *[c for c in raw.columns if c != "product_id"])
    with pytest.raises(ValueError):
        DJ.run(spark, swapped, f"{tmp_dir}/bad", DJ.DailyConfig(max_iter=2))
    doc = json.loads(spark.read.text(f"{tmp_dir}/bad/summary").first()["value"])
    assert doc["status"] == "FAIL" and "column mismatch" in doc["error"]


def test_demand_batch_unknown_products_null(spark):
    from shelfwise.catalog.daily import split_daily
    m = DJ.fit_daily_model(DJ.model_matrix(split_daily(spark, SF_SMALL)), DJ.DailyConfig(max_iter=3, max_depth=3))
    scored = score_requests(m, demand_request(spark, SF_SMALL), demand_encoder(spark, SF_SMALL))
    unknown = scored.where(F.col("product_id").endswith("-NEW"))
    assert unknown.count() > 0 and unknown.where(F.col("predicted_units_sold").isNotNull()).count() == 0
    s = summary(scored).first()
    assert s["failed"] == unknown.count() and s["successful"] + s["failed"] == s["total_rows"]


def test_demand_batch_rejects_non_numeric(spark):
    from shelfwise.operators.quality import ValidationError
    req = spark.createDataFrame([("A", "x", "1.0", "0")], "sku string, units_last_week string, price string, promo string")
    enc = spark.createDataFrame([("A", 0)], "product_id string, code int")
    with pytest.raises(ValidationError):
        score_requests(None, req, enc)


def test_sentiment_model_beats_nothing_and_roundtrips(spark, tmp_dir):
    from shelfwise.catalog.text import labelled
    data = SJ.prepare_text(labelled(spark, SF_MID))
    model = SJ.fit(data.where("split = 'train'"), max_iter=20)
    acc = {r["split"]: r["accuracy"] for r in SJ.accuracy(SJ.score(model, data), by="split").collect()}
    assert 0.0 <= acc["test"] <= 1.0 and acc["train"] >= 0.5
    model.save(f"{tmp_dir}/senti")
    again = SJ.SentimentModel.load(spark, f"{tmp_dir}/senti")
    a = SJ.score(model, data).select("doc_id", "prediction").orderBy("doc_id").collect()
    b = SJ.score(again, data).select("doc_id", "prediction").orderBy("doc_id").collect()
    assert a == b


def test_tweet_and_encoder_readers(spark, tmp_dir):
    p = f"{tmp_dir}/tweets.csv"
    with open(p, "w", encoding="latin-1") as f:
        f.write('4,1,"Mon Apr 06",NO_QUERY,u1,"caf\xe9 is great"\n0,2,"Mon Apr 06",NO_QUERY,u2,"bad"\n')
    t = readers.read_tweets(spark, p).orderBy("id").collect()
    assert t[0]["target"] == 4 and t[0]["text"] == "café is great"
    e = f"{tmp_dir}/enc.json"
    with open(e, "w") as f:
        json.dump({"PROD_001": 0, "PROD_002": 1}, f, indent=2)
    got = {r["product_id"]: r["product_id_encoded"] for r in readers.read_encoder_json(spark, e).collect()}
    assert got == {"PROD_001": 0, "PROD_002": 1}


def test_release_fits(spark):
    from shelfwise.catalog import models as M
    m = M.daily_matrix(spark, SF_SMALL)
    assert m is M.daily_matrix(spark, SF_SMALL)
    assert not (m.storageLevel.useMemory or m.storageLevel.useDisk)      # a written table, nothing cached
    M.release_fits(spark)
    assert not any(k[0] == spark.sparkContext.applicationId for k in M._FITS)
