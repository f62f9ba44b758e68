"""Names and types of a model's features, saved beside it and checked before it is used."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureContract:
    fields: tuple[tuple[str, str], ...]     # (name, Spark's name of the type), in the model's order

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    @classmethod
    def of(cls, df: DataFrame, names: list[str]) -> "FeatureContract":
        types = dict(df.dtypes)
        return cls(tuple((n, types[n]) for n in names))

    def check(self, df: DataFrame) -> None:
        """Refuse a table that lacks a feature or has one of another type; only the schema is read."""
        types = dict(df.dtypes)
        missing = [n for n in self.names if n not in types]
        other = [f"{n} is {types[n]}, not {t}" for n, t in self.fields if n in types and types[n] != t]
        if missing or other:
            raise TypeError("; ".join([*(f"{n} is missing" for n in missing), *other]))

    def cast(self, df: DataFrame) -> DataFrame:
        """The features of a request in the types of the fit; a value that doesn't convert is missing."""
        return df.withColumns({n: F.col(n).try_cast(t) for n, t in self.fields})

    def save(self, spark: SparkSession, path: str) -> None:
        doc = json.dumps([{"name": n, "type": t} for n, t in self.fields])
        spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureContract":
        return cls(tuple((f["name"], f["type"]) for f in json.loads(spark.read.text(path).first()["value"])))
