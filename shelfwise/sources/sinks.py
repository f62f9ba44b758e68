"""Writers for the reference's outputs (K1-K8).

Every write goes to a caller-given directory (on a cluster: a shared file
system), never to a machine-local temporary folder.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


def timestamped(base: str, stem: str) -> str:
    """K1 naming: ``<stem>_<UTC timestamp>``."""
    return f"{base.rstrip('/')}/{stem}_{datetime.now(timezone.utc).strftime('%Y%m%d_%H%M%S')}"


def write_csv(df: DataFrame, path: str) -> str:
    """K1: scored batch as CSV with header; a quote inside quotes is doubled."""
    df.write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """K2/K3/K5 (and K4 with ``partition_by=['split']``, which enables partition pruning)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_if_rows(df: DataFrame, path: str) -> bool:
    """K3: write only when there is at least one row."""
    if df.isEmpty():
        return False
    write_parquet(df, path)
    return True


def write_json_rows(df: DataFrame, path: str) -> str:
    """K6: a dimension or report table as JSON lines, a file for each task (the encoder grows with the catalogue)."""
    df.write.mode("overwrite").json(path)
    return path


def write_summary(spark: SparkSession, summary: dict, path: str) -> str:
    """K7: run summary as one JSON document (nested structs and maps)."""
    doc = json.dumps(summary, default=str, sort_keys=True)
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
