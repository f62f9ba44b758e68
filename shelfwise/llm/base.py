"""What the operators share: input columns, shared scratch tables, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, stored  # noqa: F401

#: Characters that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """Only the columns an operator needs, under its own names, so other columns can't clash.

    A null text is an empty one; a null id stays null. ``more`` maps a new name to a column.
    """
    ship_package(df.sparkSession)
    return df.select(F.col(doc_id).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                     *[(c if not isinstance(c, str) else F.col(c)).alias(n) for n, c in more.items()])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sub_batches(lengths, limit: int):
    """Slices of consecutive rows whose lengths add up to about ``limit``; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))
