"""The bulk price-scoring page as a batch job.

Input: any CSV of products (only ``brand, category, original_price`` are
required). Output: the scored rows as CSV, plus a one-row summary and the two
top-5 tables; the scored rows are written once as a table, which the CSV and
the reports read, so scoring runs once and no CSV is parsed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import quality as Q
from ..operators.report import money_sum, result_filter, top_k
from ..session import stored
from ..sources import sinks
from .pricing import PriceUnitsModel

TOP_COLUMNS = ["product_id", "brand", "category", "Recommended_Price", "Predicted_Units_Sold",
               "Predicted_Revenue"]


POSITION = ["__file", "__block", "__row"]


def with_file_position(df: DataFrame) -> DataFrame:
    """Row position in the input files, taken right after the scan: file, block of it, row.

    Spark deals files to tasks by size, so the file's name and the block's
    start come first; within a block the ids of one task rise. A DataFrame
    that doesn't come from files has its rows in the order of its partitions.
    """
    try:
        file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        return df.select("*", file.alias(POSITION[0]), block.alias(POSITION[1]), F.monotonically_increasing_id().alias(POSITION[2]))
    except AnalysisException:
        return df.select("*", F.lit("").alias(POSITION[0]), F.lit(0).alias(POSITION[1]), F.monotonically_increasing_id().alias(POSITION[2]))


def prepare_request(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """V2 -> V3 -> P5 -> P11 -> C9 -> C10; ids follow file order unless ``order`` is given."""
    missing = Q.missing_required(df)
    if missing:
        raise Q.ValidationError(f"missing required columns: {missing}")
    if Q.is_empty(df):
        raise Q.ValidationError("the uploaded file has no rows")
    if order is None:
        df, order = with_file_position(df), POSITION
    out = FE.coerce_batch(FE.batch_ids(FE.add_defaults(df, today=True), order))
    return out.drop(*POSITION)


def summary(scored: DataFrame) -> DataFrame:
    """Totals, price distribution and the ratio-of-means margin, in one row."""
    median = FE.fit_medians(scored, ["Recommended_Price"]).first()["median"]       # one number
    n = F.count(F.lit(1))
    g = scored.agg(n.alias("total_products"), money_sum(F.col("Predicted_Revenue")).alias("total_revenue"),
                   F.coalesce(F.sum("Predicted_Units_Sold"), F.lit(0)).cast("long").alias("total_units"),
                   (money_sum(F.col("Recommended_Price")) / n).alias("avg_price"),
                   F.min("Recommended_Price").alias("min_price"),
                   F.max("Recommended_Price").alias("max_price"),
                   (money_sum(F.col("original_price")) / n).alias("avg_original"))
    g = g.withColumn("median_price", F.lit(median).cast("double"))
    return g.withColumn("avg_margin", F.when(F.col("avg_price") > 0,
                                             (F.col("avg_price") - F.col("avg_original")) / F.col("avg_price") * 100)
                        .otherwise(F.lit(0.0)))



def preview(df: DataFrame, n: int, order: list[str]) -> list:
    """The first ``n`` rows in an explicit order (a bounded take)."""
    return df.orderBy(*order).limit(n).collect()


def run(spark: SparkSession, request: DataFrame, model: PriceUnitsModel, out_dir: str,
        order: list[str] | None = None, premium: bool = False, high_volume: bool = False,
        high_revenue: bool = False) -> dict:
    req = prepare_request(request, order)
    scored = stored(model.predict_batch(req), "scored")       # scored once; the CSV and the reports read this
    scored_path = sinks.write_csv(scored, sinks.timestamped(out_dir, "scored"))                    # K1
    summ = summary(scored).first().asDict()
    return {
        "scored_path": scored_path, "summary": summ,
        "top_revenue": [r.asDict() for r in top_k(scored, "Predicted_Revenue", 5, "product_id", TOP_COLUMNS).collect()],
        "top_units": [r.asDict() for r in top_k(scored, "Predicted_Units_Sold", 5, "product_id", TOP_COLUMNS).collect()],
        "filtered_rows": result_filter(scored, premium, high_volume, high_revenue).count(),     # F2-F4
    }
