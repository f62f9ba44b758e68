"""Input contracts: the CSV dialect, headers, literal records, dates and spaces; scoring semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import cleaning as C
from shelfwise.functions.porter import stem
from shelfwise.operators import quality as Q
from shelfwise.operators import report as REP
from shelfwise.plans import daily as DJ
from shelfwise.plans import demand_scoring as DS
from shelfwise.plans import sentiment as SJ
from shelfwise.plans.pricing import PriceConfig, PriceUnitsModel
from shelfwise.sources import readers, sinks

HARD = 'he said ""hi, you"" ok\nand a second line'
PLAIN = 'he said "hi, you" ok\nand a second line'


def test_quotes_and_newlines_inside_quotes(spark, tmp_dir):
    p = f"{tmp_dir}/t.csv"
    with open(p, "w", encoding="latin-1") as f:
        f.write(f'4,1,d,q,u,"{HARD}"\n0,2,d,q,u,plain\n')
    assert [r["text"] for r in readers.read_tweets(spark, p).orderBy("id").collect()] == [PLAIN, "plain"]
    p = f"{tmp_dir}/r.csv"
    with open(p, "w", encoding="latin-1") as f:
        f.write(f'id,review\n1,"{HARD}"\n2,caf\xe9\n')
    assert [r["review"] for r in readers.read_text_csv(spark, p, "review").orderBy("id").collect()] == [PLAIN, "café"]


def test_written_quotes_are_doubled_and_come_back(spark, tmp_dir):
    df = spark.createDataFrame([(PLAIN, "x")], "a string, b string")
    path = sinks.write_csv(df, f"{tmp_dir}/out")
    assert readers.read_strings_csv(spark, path).collect() == df.collect()
    assert '""hi, you""' in "".join(r.value for r in spark.read.text(path).collect())


def test_exchanged_columns_in_a_second_file_are_refused(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/d")
    for name, header, row in (("a", "date,product_id", "2024-01-01,P1"), ("b", "product_id,date", "P1,2024-01-01")):
        with open(f"{tmp_dir}/d/{name}.csv", "w") as f:
            f.write(f"{header}\n{row}\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_daily_raw(spark, f"{tmp_dir}/d").collect()


def test_records_of_ints_and_texts(spark):
    r = readers.one_record(spark, {"brand": "x", "original_price": "950", "competitor_price": 0, "date": "2024-01-05 00:00:00",
                                   "stock_quantity": 7.0, "rating": None}).first()
    assert (r["original_price"], r["competitor_price"], r["date"], r["stock_quantity"], r["rating"]) == (950.0, 0.0, dt.date(2024, 1, 5), 7, None)


def test_dates_with_a_time_part_and_unicode_spaces(spark):
    df = spark.createDataFrame([("2024-01-05 00:00:00",), ("2024-01-05T10:00:00",), ("2024/01/05",), (" 2024-01-05 ",), ("junk",), (None,)], "d string")
    assert [r[0] for r in df.select(C.to_date_or_null(F.col("d"))).collect()] == [dt.date(2024, 1, 5)] * 4 + [None, None]
    assert spark.createDataFrame([("\u00a012.5\u00a0",)], "x string").select(C.to_number(F.col("x"))).first()[0] == 12.5


def test_a_missing_value_rejects_the_batch(spark):
    req = spark.createDataFrame([("A", "1", "1.0", "0"), ("B", None, "1.0", "0")], "sku string, units_last_week string, price string, promo string")
    assert not Q.non_numeric_batch(req, ["units_last_week"]).first()["accepted"]
    with pytest.raises(Q.ValidationError):
        DS.prepare_requests(req, spark.createDataFrame([("A", 0)], "product_id string, code int"))


class _Same:
    """A stand-in regressor: its prediction is one of its inputs."""

    def __init__(self, src, dst):
        self.src, self.dst = src, dst

    def transform(self, df):
        return df.withColumn(self.dst, F.col(self.src).cast("double"))


def test_bulk_scoring_without_a_current_price_compares_the_original(spark):
    from shelfwise.operators import features as FE
    state = FE.PriceFeatureState([], {}, {})
    m = PriceUnitsModel(state, _Same("original_price", "predicted_price"), _Same("price_vs_competitor", "predicted_units"), PriceConfig())
    req = spark.createDataFrame([("b", "c", 100.0, 9.99)], "brand string, category string, original_price double, competitor_price double")
    a = m.predict_batch(req).first()
    b = m.predict_batch(req.withColumn("current_price", F.lit(100.0))).first()
    assert a["Predicted_Units_Sold"] == b["Predicted_Units_Sold"] == 10
    assert m.predict_batch(req.withColumn("current_price", F.lit(0.0))).first()["Predicted_Units_Sold"] == 0


def test_rows_with_missing_features_are_fitted_and_scored(spark):
    rows = [(dt.date(2024, 1, 1), "p", "train" if k % 3 else "val", float(k % 7) if k % 4 else None, 5.0, k % 2, 1, float(k % 7) if k % 4 else 50.0)
            for k in range(120)]
    m = spark.createDataFrame(rows, "date date, product_id string, split string, lag_7 float, sale_price float, is_promo byte, product_id_encoded int, target float")
    model = DJ.fit_daily_model(m, DJ.DailyConfig(max_iter=12, max_depth=3, patience=3))
    pred = DJ.predictions(model, m)
    assert pred.count() == 120 and pred.where("predicted_units is null").count() == 0
    assert pred.where("true_units = 50").agg(F.min("predicted_units")).first()[0] > 25     # missing has its own branch


def test_best_round_waits(spark):
    assert DJ.best_round([5, 4, 3, 3.5, 3.4, 2.0], 2) == 2
    assert DJ.best_round([5, 4, 3, 3.5, 3.4, 2.0], 3) == 5
    assert DJ.best_round([1.0], 50) == 0


def test_first_rounds_is_the_start_of_the_model(spark, tmp_dir):
    rows = [(dt.date(2024, 1, 1), "p", "train", float(k % 9), 5.0, k % 2, 1, float(k % 9)) for k in range(90)]
    m = spark.createDataFrame(rows, "date date, product_id string, split string, lag_7 float, sale_price float, is_promo byte, product_id_encoded int, target float")
    short = DJ.fit_daily_model(m, DJ.DailyConfig(max_iter=3, max_depth=3))
    long = DJ.fit_daily_model(m, DJ.DailyConfig(max_iter=6, max_depth=3))
    cut = DJ.first_rounds(long.stages[-1], 3)
    x = long.stages[0].transform(DJ.filled(m))
    assert [r[0] for r in cut.transform(x).select("prediction").collect()] == [r[0] for r in short.stages[-1].transform(x).select("prediction").collect()]
    cut.write().overwrite().save(f"{tmp_dir}/cut")
    assert len(cut.featureImportances) == 4


def test_terms_of_raw_text(spark):
    from pyspark.ml.feature import RegexTokenizer
    t = RegexTokenizer(inputCol="x", outputCol="t", pattern=SJ.TERM_PATTERN, gaps=False)
    assert t.transform(spark.createDataFrame([("Great! stop, don't a café",)], "x string")).first()["t"] == ["great", "stop", "don", "café"]


def test_public_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
             "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "hopelessly": "hopelessli",
             "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr", "adjustment": "adjust", "probate": "probat", "controll": "control"}
    assert {w: stem(w) for w in pairs} == pairs


def test_frequencies_descend(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), ("b",)], "x string")
    assert [(r["x"], r["count"]) for r in REP.frequency(df, "x").collect()] == [("b", 3), ("a", 2), ("c", 1)]
