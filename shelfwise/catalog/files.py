"""Files in and out: each query writes a table that Spark derives as the reference's kind of file and reads it with the library's reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators.indexing import dense_code
from ..plans import price_batch
from ..plans import sentiment as SJ
from ..session import scratch_path
from ..sources import readers, sinks
from ..sources.adapters import daily_raw, daily_sales, retail_products, reviews
from ..sources.tables import table
from . import adapter_sql as A
from . import daily as D
from . import products as PR
from . import scoring as S

# How texts are written so that every character that ISO-8859-1 has comes back.
AS_IT_IS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "encoding": readers.LATIN1}


def fresh(spark, kind: str) -> str:
    """A new folder below the shared one; it goes when the application ends."""
    path = f"{scratch_path(spark, 'tables')}/{kind}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def q_csv_products(spark, sf_dir):
    """S1 + S5 + K1: products written as CSV and read by name with their types."""
    return readers.read_products_csv(spark, sinks.write_csv(retail_products(spark, sf_dir), fresh(spark, "products")))


def q_csv_tweets(spark, sf_dir):
    """S3: reviews as headerless ISO-8859-1 tweets; texts may hold quotes, commas and newlines."""
    r = reviews(spark, sf_dir)
    path = fresh(spark, "tweets")
    rows = r.select("target", F.col("doc_id").alias("id"), F.lit("Mon Apr 06 22:19:45 PDT 2009"), F.lit("NO_QUERY"), F.lit("u"), F.coalesce("text", F.lit("")))
    rows.write.options(**AS_IT_IS).csv(path)
    return readers.read_tweets(spark, path).select("id", "target", "flag", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def q_csv_reviews(spark, sf_dir):
    """An ISO-8859-1 file with header whose text column the caller names."""
    path = fresh(spark, "reviews")
    r = reviews(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("review"))
    r.write.options(header="true", **AS_IT_IS).csv(path)
    return readers.read_text_csv(spark, path, "review").select("id", F.md5(F.coalesce("review", F.lit(""))).alias("text_md5"))


def q_encoder_json(spark, sf_dir):
    """The encoder as one JSON object (as the reference ships it) and back as a table; products are the catalogue's brands."""
    path = fresh(spark, "encoder")
    dense = dense_code(table(spark, sf_dir, "part", "p_brand"), "p_brand", "code")
    dense.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "code")))).alias("value")).write.text(path)
    return readers.read_encoder_json(spark, path)


def q_one_record(spark, sf_dir):
    """The first product as a record of texts, typed field by field."""
    fields = ["product_id", "brand", "original_price", "competitor_price", "date", "units_sold"]
    first = retail_products(spark, sf_dir).select(*fields).orderBy("product_id").first()
    return readers.one_record(spark, {k: None if first[k] is None else str(first[k]) for k in fields})


def q_daily_leakage_dropped(spark, sf_dir):
    """The fact with leaky columns beside it, which go by their names."""
    d = daily_sales(spark, sf_dir)
    leaky = d.withColumns({"revenue": F.col("units_sold") * F.col("sale_price"), "Sale_price_lag": F.col("sale_price"), "units_log1p": F.log1p("units_sold"),
                           "units_per_stock": F.lit(1.0), "demand_index": F.lit(2), "ORDERS": F.lit(3), "price_rank": F.lit(4)})
    return Q.drop_leakage(leaky)


def q_daily_splits_written(spark, sf_dir):
    """K2 + K4: the splits as partitioned parquet, read back by partition."""
    path = sinks.write_parquet(D.split_daily(spark, sf_dir), fresh(spark, "splits"), ["split"])
    return (spark.read.parquet(path).where(F.col("split") != "train").groupBy("split")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("units_sold").cast("long").alias("units_sold"), F.min("date").alias("first_date")))


def q_daily_repairs_written(spark, sf_dir):
    """K3: the repair log, written because it has rows; an empty one leaves no folder."""
    log = Q.repair_log(Q.parse_daily(daily_raw(spark, sf_dir)))
    path = fresh(spark, "repairs")
    wrote, none = sinks.write_if_rows(log, path), sinks.write_if_rows(log.limit(0), f"{path}-none")
    return spark.read.parquet(path).groupBy("column").agg(F.count(F.lit(1)).alias("repairs")).withColumns({"written": F.lit(wrote), "empty_written": F.lit(none)})


def q_daily_encoder_written(spark, sf_dir):
    """K6: the dense codes as JSON lines, and back."""
    path = sinks.write_json_rows(dense_code(daily_sales(spark, sf_dir), "product_id", "dense_code"), fresh(spark, "codes"))
    return spark.read.schema("product_id string, dense_code int").json(path)


def q_review_raw_terms(spark, sf_dir):
    """Terms of the reviews on the serving path, without stop-word removal and stemming."""
    return SJ.term_counts(SJ.prepare_text(reviews(spark, sf_dir), preprocess=False), "doc_id")


def q_batch_scored_csv(spark, sf_dir):
    """K1: the scored batch as CSV, its result columns read back with their types."""
    path = sinks.write_csv(S.q_batch_scored(spark, sf_dir), sinks.timestamped(fresh(spark, "scored"), "scored"))
    return readers.read_products_csv(spark, path).select("sku", "Recommended_Price", "Predicted_Units_Sold", "Predicted_Revenue")


def q_batch_preview(spark, sf_dir):
    """The first ten products of the request."""
    request = PR.batch_request(spark, sf_dir).select("sku", "brand", "original_price")
    return spark.createDataFrame(price_batch.preview(request, 10, ["sku"]), request.schema)


QUERIES = {
    "csv_products": q_csv_products,
    "csv_tweets": q_csv_tweets,
    "csv_reviews": q_csv_reviews,
    "encoder_json": q_encoder_json,
    "one_record": q_one_record,
    "daily_leakage_dropped": q_daily_leakage_dropped,
    "daily_splits_written": q_daily_splits_written,
    "daily_repairs_written": q_daily_repairs_written,
    "daily_encoder_written": q_daily_encoder_written,
    "review_raw_terms": q_review_raw_terms,
    "batch_scored_csv": q_batch_scored_csv,
    "batch_preview": q_batch_preview,
}

# ---------------------------------------------------------------- SQL oracle

# What ISO-8859-1 lacks is written as a question mark.
_LATIN = r"md5(regexp_replace(coalesce(text, ''), '[^\x{00}-\x{FF}]', '?', 'g'))"
# Word characters as Java's Unicode classes have them: letters, marks, decimal digits, letter numbers, connectors, joiners.
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]{2,}"

SQL = {
    "csv_products": f"WITH {A.RETAIL_PRODUCTS} SELECT * FROM retail_products",
    "csv_tweets": f"SELECT doc_id AS id, CAST(quality * 4 AS INTEGER) AS target, 'NO_QUERY' AS flag, {_LATIN} AS text_md5 FROM documents JOIN labels USING (doc_id)",
    "csv_reviews": f"SELECT CAST(doc_id AS VARCHAR) AS id, {_LATIN} AS text_md5 FROM documents JOIN labels USING (doc_id)",
    "encoder_json": "SELECT p_brand AS product_id, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS product_id_encoded FROM (SELECT DISTINCT p_brand FROM part)",
    "one_record": f"""WITH {A.RETAIL_PRODUCTS}
SELECT product_id, brand, original_price, competitor_price, date, units_sold FROM retail_products ORDER BY product_id LIMIT 1""",
    "daily_leakage_dropped": f"WITH {A.DAILY_SALES} SELECT *, 4 AS price_rank FROM daily_sales",
    "daily_splits_written": f"""WITH {D.SPLIT}
SELECT split, count(*) AS rows, CAST(sum(units_sold) AS BIGINT) AS units_sold, min(date) AS first_date FROM split WHERE split <> 'train' GROUP BY split""",
    "daily_repairs_written": f"WITH {D.PARSED}, r AS ({D._repairs}) SELECT \"column\", count(*) AS repairs, true AS written, false AS empty_written FROM r GROUP BY \"column\"",
    "daily_encoder_written": f"""WITH {A.DAILY_SALES}
SELECT product_id, CAST(row_number() OVER (ORDER BY product_id) - 1 AS INTEGER) AS dense_code FROM (SELECT DISTINCT product_id FROM daily_sales)""",
    "review_raw_terms": f"""SELECT doc_id, term, count(*) AS tf
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_WORD}')) AS term FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""",
    "batch_scored_csv": f"WITH {S.BATCH} SELECT sku, Recommended_Price, Predicted_Units_Sold, Predicted_Revenue FROM scored",
    "batch_preview": f"WITH {A.RETAIL_PRODUCTS} SELECT product_id AS sku, brand, original_price FROM retail_products ORDER BY sku LIMIT 10",
}
