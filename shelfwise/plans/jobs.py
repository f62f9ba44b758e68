"""The job entries, callable from Python or ``python -m shelfwise.plans.jobs``.

    train-price   --train CSV --model DIR [--trees N]           (entry 1)
    score-price   --input CSV --model DIR --out DIR             (entry 2)
    daily         --input CSV --out DIR [--rounds N]            (entry 3)
    sentiment     --input CSV --model DIR [--iter N]            (entry 4, tweets: no header, latin-1)
    score-demand  --input CSV --run DIR --out DIR               (batch demand; DIR of a daily run)
    score-reviews --input CSV --column NAME --model DIR --out DIR
    score-record  --record JSON --model DIR                     (one product)

Paths must be on storage every executor can read (a shared file system or
object store); the session is taken from the environment (spark-submit).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.split import exact_split
from ..sources import readers, sinks
from . import daily, demand_scoring, price_batch, sentiment
from .pricing import PriceConfig, PriceUnitsModel


def train_price(spark, train_csv: str, model_dir: str, trees: int | None = None) -> dict:
    df = readers.read_products_csv(spark, train_csv)
    key = "product_id" if "product_id" in df.columns else df.columns[0]
    split = exact_split(df, key, 0.2, 42)                                                 # E10
    cfg = PriceConfig() if trees is None else PriceConfig(price_trees=trees, units_trees=trees)
    model = PriceUnitsModel.fit(split.where("split = 'train'").drop("split"), cfg=cfg)
    model.save(model_dir)
    return model.evaluate(split.where("split = 'test'").drop("split")).first().asDict()     # G10


def score_price(spark, input_csv: str, model_dir: str, out_dir: str) -> dict:
    model = PriceUnitsModel.load(spark, model_dir)
    df = readers.read_products_csv(spark, input_csv)
    return price_batch.run(spark, df, model, out_dir)          # ids in file order (P11)


def run_daily(spark, input_csv: str, out_dir: str, rounds: int | None = None) -> dict:
    cfg = daily.DailyConfig() if rounds is None else daily.DailyConfig(max_iter=rounds)
    return daily.run(spark, readers.read_daily_raw(spark, input_csv), out_dir, cfg)


def train_sentiment(spark, tweets_csv: str, model_dir: str, max_iter: int = sentiment.MAX_ITER) -> dict:
    df = readers.read_tweets(spark, tweets_csv).withColumn("target", R.relabel(F.col("target")))   # S3, B14
    data = sentiment.prepare_text(exact_split(df, "id", 0.2, 2, "target"))                        # E11
    model = sentiment.fit(data.where("split = 'train'"), max_iter=max_iter)
    model.save(model_dir)                                                                         # K8
    acc = sentiment.accuracy(sentiment.score(model, data), by="split").collect()                  # A15
    return {r["split"]: r["accuracy"] for r in acc}


def score_demand(spark, input_csv: str, run_dir: str, out_dir: str, mapping: dict[str, str] | None = None) -> dict:
    """A request file scored with the model and encoder of a daily run."""
    model, contract = daily.load_model(spark, run_dir)                                            # S8, S9
    encoder = spark.read.schema("product_id string, dense_code int").json(f"{run_dir}/label_encoder")
    scored = demand_scoring.score_requests(model, readers.read_strings_csv(spark, input_csv, multi_line=False), encoder, mapping,
                                            contract=contract)
    sinks.write_parquet(scored, f"{out_dir}/rows")
    rows = spark.read.parquet(f"{out_dir}/rows")
    path = sinks.write_csv(rows, sinks.timestamped(out_dir, "demand"))
    return {"path": path, "summary": demand_scoring.summary(rows).first().asDict()}


def score_reviews(spark, input_csv: str, column: str, model_dir: str, out_dir: str) -> dict:
    return sentiment.score_file(spark, input_csv, column, sentiment.SentimentModel.load(spark, model_dir), out_dir)


def score_record(spark, record: dict, model_dir: str) -> dict:
    return PriceUnitsModel.load(spark, model_dir).predict_single(spark, record)


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="shelfwise")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("train-price"); a.add_argument("--train"); a.add_argument("--model"); a.add_argument("--trees", type=int)
    b = sub.add_parser("score-price"); b.add_argument("--input"); b.add_argument("--model"); b.add_argument("--out")
    c = sub.add_parser("daily"); c.add_argument("--input"); c.add_argument("--out"); c.add_argument("--rounds", type=int)
    d = sub.add_parser("sentiment"); d.add_argument("--input"); d.add_argument("--model"); d.add_argument("--iter", type=int, default=sentiment.MAX_ITER)
    e = sub.add_parser("score-demand"); e.add_argument("--input"); e.add_argument("--run"); e.add_argument("--out")
    f = sub.add_parser("score-reviews"); f.add_argument("--input"); f.add_argument("--column"); f.add_argument("--model"); f.add_argument("--out")
    g = sub.add_parser("score-record"); g.add_argument("--record"); g.add_argument("--model")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"shelfwise-{args.cmd}").getOrCreate()
    if args.cmd == "train-price":
        out = train_price(spark, args.train, args.model, args.trees)
    elif args.cmd == "score-price":
        out = score_price(spark, args.input, args.model, args.out)
    elif args.cmd == "daily":
        out = run_daily(spark, args.input, args.out, args.rounds)
    elif args.cmd == "score-demand":
        out = score_demand(spark, args.input, args.run, args.out)
    elif args.cmd == "score-reviews":
        out = score_reviews(spark, args.input, args.column, args.model, args.out)
    elif args.cmd == "score-record":
        out = score_record(spark, json.loads(args.record), args.model)
    else:
        out = train_sentiment(spark, args.input, args.model, args.iter)
    print(json.dumps(out, default=str))


if __name__ == "__main__":
    main()
