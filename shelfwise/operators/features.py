"""Product features for the chained price / units models.

Fit once, apply lazily: ``fit_price_features`` runs two aggregation jobs
(vocabularies, medians) and returns small, bounded parameters; applying them
is a single projection (map literals and ``coalesce``), so scoring adds no
join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as C

# ---------------------------------------------------------------- fixed values
# Luxury brands that are always kept in the brand vocabulary.
LUXURY_BRANDS = ["Rolex", "Gucci", "Prada", "Louis Vuitton", "Hermes",
                 "Burberry", "Moncler", "Jimmy Choo", "Tiffany", "Cartier"]
# Categorical columns that are integer-encoded (when present). These lists follow the
# column order of the product input file.
CATEGORICAL = ["category", "subcategory", "brand", "color", "size", "material", "season",
               "gender", "day_of_week"]
# Features of the price model and of the units model (which also gets predicted_price).
PRICE_FEATURES = ["original_price", "category", "subcategory", "brand", "material", "season",
                  "gender", "competitor_price", "days_since_launch", "is_holiday_season", "month",
                  "is_weekend", "stock_quantity", "is_luxury"]
UNITS_FEATURES = ["original_price", "discount_percentage", "category", "brand", "season", "rating",
                  "number_of_reviews", "stock_quantity", "website_views", "cart_additions",
                  "return_rate", "price_vs_competitor", "month", "day_of_week", "days_since_launch",
                  "is_luxury"]
TOP_VALUES = 50
UNKNOWN, OTHER = "Unknown", "Other"
COMPETITOR_EPSILON = 0.01

# Batch page defaults for absent columns (P5); '' marks "generate an id" (P11).
BATCH_DEFAULTS = {
    "product_id": "", "subcategory": "General", "color": "Standard", "size": "M",
    "material": "Standard", "season": "Spring", "gender": "Unisex",
    "competitor_price": 0.0, "discount_percentage": 0.0, "is_weekend": 0,
    "is_holiday_season": 0, "stock_quantity": 100, "rating": 4.0, "number_of_reviews": 50,
    "website_views": 500, "cart_additions": 20, "return_rate": 0.1, "days_since_launch": 30,
    "current_price": 0.0, "units_sold": 0,
}
# Defaults of a hand-entered single record.
SINGLE_DEFAULTS = {
    "subcategory": "General", "material": "Standard", "season": "Spring", "gender": "Unisex",
    "competitor_price": 0.0, "discount_percentage": 0.0, "is_weekend": 0,
    "is_holiday_season": 0, "stock_quantity": 100, "rating": 4.0, "number_of_reviews": 50,
    "website_views": 500, "cart_additions": 20, "return_rate": 0.1, "days_since_launch": 10,
}
# Numeric columns coerced with a default on the batch page (C9), and the categoricals.
BATCH_NUMERIC = ["original_price", "competitor_price", "discount_percentage", "stock_quantity",
                 "rating", "number_of_reviews", "website_views", "cart_additions", "return_rate",
                 "days_since_launch"]
BATCH_CATEGORICAL = ["category", "subcategory", "brand", "color", "size", "material", "season",
                     "gender"]
BATCH_ID_FORMAT = "BATCH_%04d"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


# ---------------------------------------------------------------- E1, E3, E5


def date_features(df: DataFrame) -> DataFrame:
    """``month`` (0 when unknown) and the English ``day_of_week`` (overwritten)."""
    if "date" not in df.columns:
        return df
    d = F.col("date")
    if not isinstance(df.schema["date"].dataType, T.DateType):
        d = C.to_date_or_null(F.col("date"))
    return (df.withColumn("date", d)
            .withColumn("month", F.coalesce(F.month("date"), F.lit(0)))
            .withColumn("day_of_week", F.coalesce(F.date_format("date", "EEEE"), F.lit(UNKNOWN))))


def engineered(df: DataFrame, luxury: list[str]) -> DataFrame:
    """E3 + E5: luxury flag and price relative to the competitor.

    E7 deviation: a NULL brand counts as 'Unknown' (not the text 'nan').
    """
    out = df.withColumn("is_luxury", F.coalesce(F.col("brand").cast("string").isin(*luxury), F.lit(False)).cast("int"))
    ref = F.col("current_price") if "current_price" in df.columns else F.col("original_price")
    if "competitor_price" in df.columns:
        ratio = F.try_divide(ref.cast("double"), F.col("competitor_price").cast("double") + F.lit(COMPETITOR_EPSILON))
    else:
        ratio = F.lit(1.0)
    return out.withColumn("price_vs_competitor", ratio)


def category_text(c: str) -> Column:
    """E6 input: NULL -> 'Unknown', as text."""
    return F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))


# ---------------------------------------------------------------- A2 + U1: vocabulary


def fit_vocabulary(df: DataFrame, columns: list[str], luxury: list[str],
                   top: int = TOP_VALUES) -> DataFrame:
    """A2 + U1: per column, the ``top`` most frequent values (ties: smaller value
    first), plus the luxury brands (brand only) and 'Unknown'/'Other'; id = rank
    of the value inside its column.

    One job for all columns: unpivot, count with map-side combine, and a
    rank-limited window that Spark plans as a partial top-k before the shuffle.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), category_text(c).alias("value")) for c in columns])).alias("kv")
    ).select("kv.column", "kv.value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    topv = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select("column", "value")
    forced = [(c, v) for c in columns for v in (UNKNOWN, OTHER)]
    if "brand" in columns:
        forced += [("brand", b) for b in luxury]
    spark = df.sparkSession
    extra = spark.createDataFrame(forced, "column string, value string")
    vocab = topv.unionByName(extra).distinct()
    # bounded: at most top + len(luxury) + 2 values per column
    wid = Window.partitionBy("column").orderBy("value")
    return vocab.withColumn("id", (F.row_number().over(wid) - 1).cast("int"))


def encode(df: DataFrame, vocab: dict[str, dict[str, int]]) -> DataFrame:
    """Value -> id through a map literal; unseen -> id of 'Other'."""
    out = df
    for c, mapping in vocab.items():
        if c not in df.columns:
            continue
        m = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.lit(v))])
        out = out.withColumn(c, F.coalesce(F.try_element_at(m, category_text(c)), F.lit(mapping[OTHER])))
    return out


# ---------------------------------------------------------------- A3 + E8: medians


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def fit_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """A3: exact median of every column (NULL skipped), in long form, at any size.

    All columns go into one long table that is counted per value (partial sums
    on the map side); running counts along (column, value) then tell which
    values hold the middle positions. No task sees all values of a column.
    """
    from .indexing import running_sums

    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("kv")
    ).select("kv.column", "kv.value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counts, ["column", "value"], {"upto": F.col("n")})
    totals = ranked.groupBy("column").agg(F.sum("n").alias("rows"), F.max("upto").alias("last"))
    # one row per column of the schema: a bounded broadcast
    placed = ranked.join(F.broadcast(totals), "column")
    after = F.col("upto") - (F.col("last") - F.col("rows"))
    before = after - F.col("n")

    def at(position):
        return F.max(F.when((before <= position) & (after > position), F.col("value")))

    middle = placed.groupBy("column").agg(at(F.floor((F.col("rows") - 1) / 2)).alias("lo"), at(F.floor(F.col("rows") / 2)).alias("hi"))
    median = middle.select("column", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(0.5)).alias("median"))
    return names.join(median, "column", "left")


def impute(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Fill NULLs with the fitted medians (targets included, as the reference).

    Imputed columns become DOUBLE: a median can fall between two integers.
    """
    out = df
    for c, m in medians.items():
        if c in df.columns:
            filled = F.col(c).cast("double")
            if m is not None:
                filled = F.coalesce(filled, F.lit(float(m)))
            out = out.withColumn(c, filled)
    return out


# ---------------------------------------------------------------- E9: prepare


@dataclass
class PriceFeatureState:
    luxury: list[str]
    vocab: dict[str, dict[str, int]] = field(default_factory=dict)
    medians: dict[str, float | None] = field(default_factory=dict)

    def to_json(self) -> dict:
        return {"luxury": self.luxury, "vocab": self.vocab, "medians": self.medians}

    @classmethod
    def from_json(cls, d: dict) -> "PriceFeatureState":
        return cls(d["luxury"], d["vocab"], d["medians"])


def _pre_encode(df: DataFrame, luxury: list[str]) -> DataFrame:
    return engineered(date_features(df), luxury)


def vocabulary_frame(df: DataFrame, luxury: list[str]) -> DataFrame:
    pre = _pre_encode(df, luxury)
    return fit_vocabulary(pre, [c for c in CATEGORICAL if c in pre.columns], luxury)


def medians_frame(encoded: DataFrame) -> DataFrame:
    return fit_medians(encoded, numeric_columns(encoded))


def fit_price_features(df: DataFrame, luxury: list[str] = LUXURY_BRANDS, keep: bool = True) -> PriceFeatureState:
    """E9 (fit): vocabularies, then medians of the encoded frame.

    Two jobs; what reaches the driver is bounded by (columns x (top + luxury + 2))
    and one number per numeric column. ``keep=False``: ``df`` is a written table, read twice.
    """
    state = PriceFeatureState(list(luxury))
    cached = not keep or df.storageLevel.useMemory or df.storageLevel.useDisk
    data = df if cached else df.persist()      # two passes over the same input
    try:
        for r in vocabulary_frame(data, luxury).collect():
            state.vocab.setdefault(r["column"], {})[r["value"]] = r["id"]
        encoded = encode(_pre_encode(data, luxury), state.vocab)
        state.medians = {r["column"]: r["median"] for r in medians_frame(encoded).collect()}
    finally:
        if not cached:
            data.unpersist()
    return state


def prepare(df: DataFrame, state: PriceFeatureState) -> DataFrame:
    """E9 (apply): date features -> luxury/price ratio -> encode -> impute."""
    return impute(encode(_pre_encode(df, state.luxury), state.vocab), state.medians)


# ---------------------------------------------------------------- batch page input


def add_defaults(df: DataFrame, defaults: dict = BATCH_DEFAULTS, today: bool = False) -> DataFrame:
    """P5: add every absent column with its constant default.

    B15: with ``today`` an absent ``date`` becomes the current date.
    """
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    if today and "date" not in df.columns:
        missing["date"] = F.current_date()
    return df.withColumns(missing) if missing else df


def batch_ids(df: DataFrame, order: list[str], col: str = "product_id") -> DataFrame:
    """When the whole id column is NULL or '', number rows as BATCH_%04d, from 0.

    The whole-column test is one aggregate; numbering uses ordered indexing
    (partition offsets), never a single-task window.
    """
    from .indexing import index_by_order

    blank = F.col(col).isNull() | (F.col(col).cast("string") == "")
    all_blank = df.agg(F.coalesce(F.min(blank.cast("int")), F.lit(1)).alias("b")).first()["b"] == 1
    if not all_blank:
        return df
    numbered = index_by_order(df, order, "_row")
    return numbered.withColumn(col, F.format_string(BATCH_ID_FORMAT, F.col("_row"))).drop("_row")


def coerce_batch(df: DataFrame) -> DataFrame:
    """C9 + C10: numeric coercion with defaults, categorical clean-up."""
    out = df
    for c in BATCH_NUMERIC:
        if c in df.columns:
            default = 0.0 if c == "original_price" else float(BATCH_DEFAULTS.get(c, 0.0))
            out = out.withColumn(c, C.numeric_or_default(F.col(c), default))
    for c in BATCH_CATEGORICAL:
        if c in df.columns:
            out = out.withColumn(c, C.category_or_unknown(F.col(c)))
    return out


def console_profile(df: DataFrame, today: bool = True) -> DataFrame:
    """P5b on a table: the hand-entered profile's defaults (days_since_launch 10,
    not 30), blank subcategory -> 'General', and ``price_ok`` (a non-numeric
    price is rejected by the caller)."""
    out = add_defaults(df, SINGLE_DEFAULTS, today=today)
    sub = F.coalesce(F.nullif(F.trim(F.col("subcategory").cast("string")), F.lit("")), F.lit("General"))
    price = C.to_number(F.col("original_price").cast("string"))
    return out.withColumns({"subcategory": sub, "original_price": price,
                            "price_ok": price.isNotNull()})


def hand_entered(spark, record: dict) -> DataFrame:
    """A hand-entered product as a one-row table with the console profile."""
    from ..sources.readers import one_record

    price = record.get("original_price")
    try:
        float(price)
    except (TypeError, ValueError):
        raise ValueError(f"original_price must be a number, got {price!r}") from None
    rec = {**record, "original_price": float(price)}
    return console_profile(one_record(spark, rec)).drop("price_ok")
