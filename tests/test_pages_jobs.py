"""Page flows and job entries: batch pricing page, hand-entered record, single
forecast, review scoring, and the four job entries on CSV inputs."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from shelfwise.catalog import products as PR
from shelfwise.catalog.daily import split_daily
from shelfwise.catalog.scoring import demand_encoder
from shelfwise.operators import features as FE
from shelfwise.operators.quality import ValidationError
from shelfwise.plans import daily as DJ
from shelfwise.plans import jobs, price_batch
from shelfwise.plans import sentiment as SJ
from shelfwise.plans.demand_scoring import single_forecast
from shelfwise.plans.pricing import PriceConfig, PriceUnitsModel
from shelfwise.sources import sinks
from shelfwise.sources.adapters import daily_raw, reviews

SF = "/root/testdata/sf0.001"
SMALL = PriceConfig(price_trees=4, price_depth=3, units_trees=4, units_depth=3)


@pytest.fixture(scope="module")
def model(spark):
    return PriceUnitsModel.fit(PR.products_train(spark, SF), PR.LUXURY_TESTDATA, SMALL)


def test_batch_page(spark, model, tmp_dir):
    req = PR.batch_request(spark, SF).select("sku", "brand", "category", "original_price", "season")
    res = price_batch.run(spark, req, model, tmp_dir, ["sku"], premium=True)
    n = req.count()
    assert 0 <= res["filtered_rows"] <= n
    assert res["summary"]["total_products"] == n
    assert len(res["top_revenue"]) == min(5, n) and len(res["top_units"]) == min(5, n)
    ids = spark.read.option("header", True).csv(res["scored_path"]).select("product_id").collect()
    assert sorted(r[0] for r in ids) == [f"BATCH_{i:04d}" for i in range(n)]
    revs = [r["Predicted_Revenue"] for r in res["top_revenue"]]
    assert revs == sorted(revs, reverse=True)


def test_batch_page_gates(spark, model, tmp_dir):
    with pytest.raises(ValidationError):
        price_batch.run(spark, spark.createDataFrame([("x",)], "brand string"), model, tmp_dir, ["brand"])
    empty = spark.createDataFrame([], "brand string, category string, original_price double")
    with pytest.raises(ValidationError):
        price_batch.run(spark, empty, model, tmp_dir, ["brand"])


def test_hand_entered_record(spark, model):
    df = FE.hand_entered(spark, {"brand": "Brand#1", "category": "SMALL", "original_price": "950",
                                 "subcategory": "  "})
    r = df.first()
    assert r["subcategory"] == "General" and r["days_since_launch"] == 10 and r["date"] is not None
    out = model.predict_batch(df).first()
    assert out["Recommended_Price"] >= 0 and out["Predicted_Units_Sold"] >= 0
    with pytest.raises(ValueError):
        FE.hand_entered(spark, {"brand": "x", "category": "y", "original_price": "abc"})


def test_single_forecast(spark):
    m = DJ.fit_daily_model(DJ.model_matrix(split_daily(spark, SF)), DJ.DailyConfig(max_iter=3, max_depth=3))
    enc = demand_encoder(spark, SF)
    pid = enc.orderBy("product_id").first()["product_id"]
    r = single_forecast(spark, m, enc, pid, 12.0, 35.0, 1)
    assert r["confidence"] == "High" and r["price_text"] == "higher"
    assert r["promo_text"].startswith("Promotions") and r["predicted_units_sold_rounded"] is not None
    with pytest.raises(ValidationError):
        single_forecast(spark, m, enc, "nope", 1.0, 1.0, 0)


def _tweets_csv(spark, path):
    rows = reviews(spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()
    with open(path, "w", encoding="latin-1", newline="") as f:
        w = csv.writer(f)
        for r in rows:
            w.writerow([r["target"], r["doc_id"], "Mon Apr 06 22:19:45 PDT 2009", "NO_QUERY", "u",
                        r["text"].replace("\n", " ").encode("latin-1", "replace").decode("latin-1")])
    return len(rows)


def test_sentiment_job_and_review_page(spark, tmp_dir):
    n = _tweets_csv(spark, f"{tmp_dir}/tweets.csv")
    acc = jobs.train_sentiment(spark, f"{tmp_dir}/tweets.csv", f"{tmp_dir}/senti", max_iter=10)
    assert set(acc) == {"train", "test"}
    model = SJ.SentimentModel.load(spark, f"{tmp_dir}/senti")
    with open(f"{tmp_dir}/reviews.csv", "w", encoding="latin-1", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", "review"])
        w.writerows([[1, "great product, not bad at all"], [2, "terrible"], [3, ""]])
    res = SJ.score_file(spark, f"{tmp_dir}/reviews.csv", "review", model, tmp_dir)
    assert sum(res["counts"].values()) == 3 and 0.0 <= res["positive_pct"] <= 100.0
    assert n > 0


def test_price_jobs_from_csv(spark, tmp_dir):
    train = PR.products_split(spark, SF).drop("split")
    sinks.write_csv(train, f"{tmp_dir}/train")
    ev = jobs.train_price(spark, f"{tmp_dir}/train", f"{tmp_dir}/model", trees=3)
    assert ev["rows"] > 0
    sinks.write_csv(PR.batch_request(spark, SF).drop("date"), f"{tmp_dir}/req")
    res = jobs.score_price(spark, f"{tmp_dir}/req", f"{tmp_dir}/model", f"{tmp_dir}/out")
    assert res["summary"]["total_products"] > 0


def test_daily_job_entry(spark, tmp_dir):
    sinks.write_csv(daily_raw(spark, "/root/testdata/sf0.01"), f"{tmp_dir}/raw")
    out = jobs.run_daily(spark, f"{tmp_dir}/raw", f"{tmp_dir}/run", rounds=3)
    assert out["status"] == "PASS" and os.path.exists(f"{tmp_dir}/run/summary")


def test_batch_ids_follow_file_order(spark, tmp_dir):
    path = f"{tmp_dir}/req.csv"
    with open(path, "w") as f:
        f.write("brand,category,original_price\n")
        for i in range(50):
            f.write(f"B{(i * 7) % 50},C,{900 + i}\n")
    from shelfwise.sources.readers import read_products_csv
    out = price_batch.prepare_request(read_products_csv(spark, path))
    got = {r["product_id"]: r["original_price"] for r in out.collect()}
    assert got == {f"BATCH_{i:04d}": 900.0 + i for i in range(50)}
    top = price_batch.preview(out, 3, ["product_id"])
    assert [r["product_id"] for r in top] == ["BATCH_0000", "BATCH_0001", "BATCH_0002"]


def test_batch_ids_follow_files_and_rows(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/many")
    n = 0
    for k, size in enumerate((3, 400, 20)):        # Spark deals the largest file first
        with open(f"{tmp_dir}/many/{k}.csv", "w") as f:
            f.write("brand,category,original_price\n")
            for _ in range(size):
                f.write(f"B,C,{1000 + n}\n")
                n += 1
    from shelfwise.sources.readers import read_products_csv
    out = price_batch.prepare_request(read_products_csv(spark, f"{tmp_dir}/many"))
    assert {r["product_id"]: r["original_price"] for r in out.collect()} == {f"BATCH_{i:04d}": 1000.0 + i for i in range(n)}


def test_score_demand_and_record_commands(spark, model, tmp_dir):
    sinks.write_csv(daily_raw(spark, "/root/testdata/sf0.01"), f"{tmp_dir}/raw")
    jobs.run_daily(spark, f"{tmp_dir}/raw", f"{tmp_dir}/run", rounds=3)
    pid = spark.read.json(f"{tmp_dir}/run/label_encoder").first()["product_id"]
    with open(f"{tmp_dir}/req.csv", "w") as f:
        f.write(f'sku,units_last_week,price,promo,note\n{pid},12,35.5,1,"a ""quoted"" note"\nnope,3,10,0,x\n')
    res = jobs.score_demand(spark, f"{tmp_dir}/req.csv", f"{tmp_dir}/run", f"{tmp_dir}/out")
    assert (res["summary"]["successful"], res["summary"]["failed"]) == (1, 1)
    model.save(f"{tmp_dir}/price")
    rec = {"brand": "Brand#1", "category": "SMALL", "original_price": "950", "competitor_price": 0, "date": "2024-01-01"}
    assert jobs.score_record(spark, rec, f"{tmp_dir}/price")["Recommended_Price"] >= 0
