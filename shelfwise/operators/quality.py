"""Validation gates and the daily-fact cleaner.

All data gates of a run are one aggregation job over the parsed rows; column
gates (V1, V2, P6) only look at the schema.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C

# Fixed values of the daily fact contract.
DAILY_COLUMNS = ["date", "product_id", "units_sold", "sale_price", "is_promo", "lag_7",
                 "product_id_encoded"]
DAILY_NUMERIC = ["units_sold", "sale_price", "lag_7", "product_id_encoded", "is_promo"]
MIN_DAILY_ROWS = 500
NEGATIVE_SHARE_LIMIT = 0.001
# A line that has too few or too many fields, as the reader keeps it (S2); up to this share of them a run goes on.
CORRUPT = "_corrupt_record"
CORRUPT_SHARE_LIMIT = 0.01
# Leakage rule: these column names are kept whatever they look like.
LEAKAGE_KEEP = ["units_sold", "sale_price", "date", "product_id"]
# Leakage pattern (prefix-anchored match, case-insensitive).
LEAKAGE_PATTERN = r"(?i).*sale.*|.*_log.*|.*_log1p.*|.*_per_stock.*|revenue|forecast|demand|orders|units_ordered"
REQUIRED_PRODUCT_COLUMNS = ["brand", "category", "original_price"]


class ValidationError(ValueError):
    pass


@dataclass(frozen=True)
class ColumnCheck:
    ok: bool
    missing: frozenset
    extra: frozenset


def check_exact_columns(df: DataFrame, expected: list[str] = DAILY_COLUMNS) -> ColumnCheck:
    """V1: exact column list *and order*; an order-only difference still fails."""
    have = list(df.columns)
    return ColumnCheck(have == list(expected), frozenset(expected) - frozenset(have),
                       frozenset(have) - frozenset(expected))


def missing_required(df: DataFrame, required: list[str] = REQUIRED_PRODUCT_COLUMNS) -> list[str]:
    """Required columns that are absent, in the order they were required."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def is_empty(df: DataFrame) -> bool:
    """V3: empty-input guard (reads at most one row)."""
    return df.isEmpty()


def leakage_columns(columns: list[str], pattern: str = LEAKAGE_PATTERN,
                    keep: list[str] = LEAKAGE_KEEP) -> list[str]:
    """Columns whose name matches the leakage rule (anchored at the start)."""
    rx = re.compile(pattern)
    return [c for c in columns if c not in keep and rx.match(c)]


def drop_leakage(df: DataFrame) -> DataFrame:
    """Drop leaky columns; metadata only, no data is touched."""
    cols = leakage_columns(df.columns)
    return df.drop(*cols) if cols else df


def parse_daily(raw: DataFrame) -> DataFrame:
    """C1-C7 over the string fact, keeping what the repair log and gates need.

    Adds for every numeric column ``c``: ``c`` (parsed double), ``c__raw``,
    ``c__trim`` (trimmed text) and ``c__rep`` (bracket repair happened);
    ``date`` becomes a DATE (NULL when unparseable), ``date_raw`` keeps the text.

    Each cleaning step is its own projection over the previous step's
    columns, so a step that reads its input several times (the bracket rule
    reads the trimmed text three times) refers to a computed column rather
    than repeating the expression.
    """
    n = DAILY_NUMERIC
    corrupt = [CORRUPT] if CORRUPT in raw.columns else []       # only what the file reader gave
    df = raw.select(F.col("date").alias("date_raw"), C.to_date_or_null(F.col("date")).alias("date"),
                    F.col("product_id"), *corrupt, *[F.col(c).alias(f"{c}__raw") for c in n])
    df = df.select("*", *[C.strip_all(F.col(f"{c}__raw")).alias(f"{c}__trim") for c in n])
    df = df.select("*", *[C.bracket_number(F.col(f"{c}__trim")).alias(f"{c}__num") for c in n])
    df = df.select("*", *[(C.is_bracketed(F.col(f"{c}__trim")) & (F.col(f"{c}__num") != ""))
                          .alias(f"{c}__rep") for c in n])
    df = df.select("*", *[C.drop_currency(F.when(F.col(f"{c}__rep"), F.col(f"{c}__num"))
                                          .otherwise(F.col(f"{c}__trim"))).alias(f"{c}__cur") for c in n])
    df = df.select("*", *[C.strip_all(C.fix_separators(F.col(f"{c}__cur"))).alias(f"{c}__sep") for c in n])
    parsed = [F.when(F.col(f"{c}__sep").rlike(C.NUMERIC_PATTERN), F.col(f"{c}__sep").try_cast("double"))
              .alias(c) for c in n]
    keep = [x for c in n for x in (f"{c}__raw", f"{c}__trim", f"{c}__rep")]
    return df.select("date_raw", "date", "product_id", *corrupt, *keep, *parsed)


def whole_rows(parsed: DataFrame) -> DataFrame:
    """The rows whose line had the right number of fields."""
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if CORRUPT in parsed.columns else parsed


def quarantined(parsed: DataFrame) -> DataFrame:
    """The malformed lines as they stand in the file, and whether they have too few or too many fields."""
    if CORRUPT not in parsed.columns:
        return parsed.limit(0).select(F.lit("").alias("line"), F.lit("").alias("problem"))
    few = F.col(f"{DAILY_COLUMNS[-1]}__raw").isNull()
    return (parsed.where(F.col(CORRUPT).isNotNull())
            .select(F.col(CORRUPT).alias("line"), F.when(few, F.lit("too_few")).otherwise(F.lit("too_many")).alias("problem")))


def cleaned_daily(parsed: DataFrame) -> DataFrame:
    """Typed fact after the sanity step: negatives clipped (C8), integers truncated.

    Clipping is only legal when the negative share is under the limit; the
    gate job (``daily_gates``) decides whether the run may use this table.
    """
    return parsed.select(
        "date", "product_id",
        C.clip_at_zero(F.col("units_sold")).cast("long").alias("units_sold"),
        C.clip_at_zero(F.col("sale_price")).alias("sale_price"),
        F.col("is_promo").cast("int").alias("is_promo"),
        F.col("lag_7"),
        F.col("product_id_encoded").cast("int").alias("product_id_encoded"),
    )


def repair_log(parsed: DataFrame) -> DataFrame:
    """One row per bracket repair; ``original`` is the trimmed text.

    Rows are identified by their business key (product_id, date text), not by
    position.
    """
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__trim").alias("original"),
                 C.bracket_number(F.col(f"{c}__trim")).alias("repaired"),
                 F.col(f"{c}__rep").alias("rep"))
        for c in DAILY_NUMERIC])
    return (parsed.select(F.col("product_id"), F.col("date_raw").alias("date"), F.inline(entries))
            .where(F.col("rep")).drop("rep"))


def daily_gates(parsed: DataFrame) -> DataFrame:
    """V4-V8 and A16 as one aggregate; one row with counts and a status.

    ``*_null`` counts every NULL after coercion (what the reference reports),
    ``*_lost`` only values that were present (not NULL, not blank) but did not parse.
    Malformed lines (S2) are in ``corrupt_rows`` and in no other count; a fact that
    didn't come from a file has no such column.
    """
    malformed = CORRUPT in parsed.columns
    whole = F.col(CORRUPT).isNull() if malformed else F.lit(True)

    def of_whole(condition):
        return F.count_if(whole & condition)

    aggs = [of_whole(F.lit(True)).alias("rows"), of_whole(F.col("date").isNull()).alias("bad_dates")]
    for c in DAILY_NUMERIC:
        aggs.append(of_whole(F.col(c).isNull()).alias(f"{c}_null"))
        present = F.col(f"{c}__raw").isNotNull() & (F.col(f"{c}__trim") != "")
        aggs.append(of_whole(present & F.col(c).isNull()).alias(f"{c}_lost"))
    aggs += [
        sum_expr([of_whole(F.col(f"{c}__rep")) for c in DAILY_NUMERIC]).alias("repairs"),
        of_whole(F.col("units_sold") < 0).alias("neg_units"),
        of_whole(F.col("sale_price") < 0).alias("neg_price"),
        of_whole(F.col("is_promo").isNull() | ~F.col("is_promo").isin(0.0, 1.0)).alias("promo_bad"),
    ]
    if malformed:
        aggs.append(F.count_if(~whole).alias("corrupt_rows"))
    g = parsed.agg(*aggs)
    share_c = F.try_divide(F.col("corrupt_rows").cast("double"), F.col("rows") + F.col("corrupt_rows")) if malformed else F.lit(0.0)
    share_u = F.try_divide(F.col("neg_units").cast("double"), F.col("rows"))
    share_p = F.try_divide(F.col("neg_price").cast("double"), F.col("rows"))
    reasons = F.concat_ws(",",
                          F.when(F.col("rows") < MIN_DAILY_ROWS, F.lit("too_few_rows")),
                          F.when(share_c >= CORRUPT_SHARE_LIMIT, F.lit("corrupt_rows")),
                          F.when(F.col("bad_dates") > 0, F.lit("bad_dates")),
                          F.when(share_u >= NEGATIVE_SHARE_LIMIT, F.lit("negative_units")),
                          F.when(share_p >= NEGATIVE_SHARE_LIMIT, F.lit("negative_price")),
                          F.when(F.col("promo_bad") > 0, F.lit("is_promo_domain")),
                          F.when(F.col("lag_7_null") > 0, F.lit("lag_7_missing")),
                          F.when(F.col("units_sold_null") > 0, F.lit("units_sold_null")),
                          F.when(F.col("product_id_encoded_null") > 0, F.lit("code_null")))
    return (g.withColumn("neg_units_share", share_u).withColumn("neg_price_share", share_p)
            .withColumn("reasons", reasons)
            .withColumn("status", F.when(F.col("reasons") == "", F.lit("PASS")).otherwise(F.lit("FAIL"))))


def sum_expr(cols):
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def assert_gates(gates_row) -> None:
    if gates_row["status"] != "PASS":
        raise ValidationError(f"daily fact failed validation: {gates_row['reasons']}")


def non_numeric_batch(df: DataFrame, columns: list[str]) -> DataFrame:
    """V9: per mapped column, how many values are no number after coercion; a missing value is none.

    One aggregate; any count > 0 rejects the whole batch.
    """
    aggs = [F.count_if(C.to_number(F.col(c).cast("string")).isNull()).alias(f"{c}_bad")
            for c in columns]
    g = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    bad = sum_expr([F.col(f"{c}_bad") for c in columns])
    return g.withColumn("accepted", bad == 0)


def null_counts(df: DataFrame) -> DataFrame:
    """NULL count of every column in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
