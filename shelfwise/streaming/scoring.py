"""Structured Streaming use of the fitted, stateless transforms.

The reference has no streaming code. Its scoring and cleaning steps are
per-row projections (plus a lookup against a static table), so the very same
functions apply to a ``readStream`` source; the sink writes through a
checkpoint in the shared folder, which makes restarts after executor or
driver loss resume exactly where they stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path


def stream_source(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """A file stream with a fixed schema (no inference on streams)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def start(df: DataFrame, transform: Callable[[DataFrame], DataFrame], out_path: str,
          name: str, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Apply ``transform`` to the stream and append the result as parquet."""
    spark = df.sparkSession
    ckpt = checkpoint or scratch_path(spark, f"stream-{name}")
    w = (transform(df).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", ckpt).option("path", out_path).queryName(name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
