"""Readers for the reference's file inputs (S1-S7), always with an explicit schema.

No ``inferSchema`` pass: a schema inference reads the data twice, and on a
cluster a wrong guess fails late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as C
from ..operators.quality import CORRUPT, DAILY_COLUMNS

# File contracts.
RESULT_FIELDS = [T.StructField("Recommended_Price", T.DoubleType()),
                 T.StructField("Predicted_Units_Sold", T.LongType()),
                 T.StructField("Predicted_Revenue", T.DoubleType())]
PRODUCT_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()), T.StructField("brand", T.StringType()),
    T.StructField("color", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("material", T.StringType()), T.StructField("season", T.StringType()),
    T.StructField("gender", T.StringType()), T.StructField("original_price", T.DoubleType()),
    T.StructField("competitor_price", T.DoubleType()), T.StructField("discount_percentage", T.DoubleType()),
    T.StructField("date", T.DateType()), T.StructField("day_of_week", T.StringType()),
    T.StructField("is_weekend", T.IntegerType()), T.StructField("is_holiday_season", T.IntegerType()),
    T.StructField("stock_quantity", T.LongType()), T.StructField("rating", T.DoubleType()),
    T.StructField("number_of_reviews", T.LongType()), T.StructField("website_views", T.LongType()),
    T.StructField("cart_additions", T.LongType()), T.StructField("return_rate", T.DoubleType()),
    T.StructField("days_since_launch", T.LongType()), T.StructField("current_price", T.DoubleType()),
    T.StructField("units_sold", T.LongType()),
])
DAILY_RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in DAILY_COLUMNS])
TWEET_SCHEMA = T.StructType([
    T.StructField("target", T.IntegerType()), T.StructField("id", T.LongType()),
    T.StructField("date", T.StringType()), T.StructField("flag", T.StringType()),
    T.StructField("user", T.StringType()), T.StructField("text", T.StringType()),
])
LATIN1 = "ISO-8859-1"
# The dialect of the files: a quote inside quotes is doubled. A quoted text may hold newlines; to read these
# a file is one task, so only files with a text column are read that way, and large ones of those should
# come as several files. All others are split by Spark.
# ``enforceSchema=false`` makes Spark check the header of every file, not of the first only.
CSV_DIALECT = {"quote": '"', "escape": '"'}


def dialect(multi_line: bool, **more) -> dict:
    return {**CSV_DIALECT, "multiLine": str(multi_line).lower(), **more}


def read_products_csv(spark: SparkSession, path: str, schema: T.StructType = PRODUCT_SCHEMA) -> DataFrame:
    """CSV with header, typed by the given schema (columns matched by name).

    Only the columns present in the file are kept, so the default-fill step
    can tell absent columns from empty ones.
    """
    header = header_of(spark, path)
    fields = {f.name: f for f in list(schema.fields) + RESULT_FIELDS}
    present = T.StructType([fields.get(c, T.StructField(c, T.StringType())) for c in header])
    return spark.read.options(**dialect(False, header="true", enforceSchema="false", mode="PERMISSIVE")).schema(present).csv(path)


def header_of(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = False) -> list[str]:
    """The column names of a CSV's first line, as Spark's reader takes them."""
    return spark.read.options(**dialect(multi_line, header="true", encoding=encoding)).csv(path).columns


def read_daily_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text so the dirt survives to the cleaner, and ``quality.CORRUPT`` for malformed lines.

    The file's own header order is kept (V1 checks it). A line with too few or
    too many fields keeps its text in the last column; what could be read of it
    is in the others, and the daily job sets it aside.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header_of(spark, path), CORRUPT]])
    options = dialect(False, header="true", enforceSchema="false", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return spark.read.options(**options).schema(schema).csv(path)


def read_strings_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """A CSV with header, every column as text; all files must have the same header.

    Without ``multi_line`` a value can't hold a newline, and Spark splits the files.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header_of(spark, path, encoding, multi_line)])
    return spark.read.options(**dialect(multi_line, header="true", enforceSchema="false", encoding=encoding)).schema(schema).csv(path)


def read_tweets(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S3: headerless tweets, ISO-8859-1, six named columns; ``multi_line=False`` for files whose texts hold no newline."""
    return spark.read.options(**dialect(multi_line, header="false", encoding=LATIN1)).schema(TWEET_SCHEMA).csv(path)


def read_text_csv(spark: SparkSession, path: str, text_column: str, multi_line: bool = True) -> DataFrame:
    """ISO-8859-1 CSV with header; the caller names the text column."""
    df = read_strings_csv(spark, path, LATIN1, multi_line)
    if text_column not in df.columns:
        raise ValueError(f"column {text_column!r} not in {df.columns}")
    return df


def read_encoder_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{product_id: code}`` as a table (product_id, product_id_encoded)."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.IntegerType()))
    return raw.select(F.explode(m).alias("product_id", "product_id_encoded"))


def one_record(spark: SparkSession, record: dict, schema: T.StructType = PRODUCT_SCHEMA) -> DataFrame:
    """One literal record -> one-row table with the fields it names, each as the field's type.

    Numbers and dates may come as text or as another kind of number; what does not convert is NULL.
    """
    fields = [f for f in schema.fields if f.name in record]
    text = spark.createDataFrame([tuple(None if record[f.name] is None else str(record[f.name]) for f in fields)],
                                 T.StructType([T.StructField(f.name, T.StringType()) for f in fields]))

    def typed(f: T.StructField):
        if isinstance(f.dataType, T.DateType):
            return C.to_date_or_null(F.col(f.name))
        if isinstance(f.dataType, T.StringType):
            return F.col(f.name)
        return C.to_number(F.col(f.name)).cast(f.dataType)

    return text.select(*[typed(f).alias(f.name) for f in fields])
