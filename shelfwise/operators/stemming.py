"""Stemming by vocabulary (X3): Python sees each distinct token of the corpus once.

Rows are taken in units of a few thousand. A unit has a list of its distinct
tokens, and its rows hold places in that list. The lists' distinct tokens are
stemmed once and written as a dictionary, by which each list gets its stems; the
lists then go to their units' rows. So a token is shuffled once a unit, however
often it stands there, and a token in every row is a row for each unit only.

``porter.stem_text`` does the same where the texts are. Which of the two is
faster is in the README, with figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.porter import stem
from ..session import ship_package, stored

#: Rows of a unit, at most.
UNIT = 2048


def vocabulary(df: DataFrame, tokens: str) -> DataFrame:
    """token, n: how often each token stands in the arrays of ``tokens``."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def stem_dictionary(df: DataFrame, tokens: str) -> DataFrame:
    """token, n, stem: every distinct token stemmed once; a written table."""
    ship_package(df.sparkSession)

    def stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("token")
            yield pa.RecordBatch.from_arrays([words, b.column("n"), pa.array([None if w is None else stem(w) for w in words.to_pylist()], pa.string())], ["token", "n", "stem"])

    return stored(vocabulary(df, tokens).mapInArrow(stemmed, "token string, n long, stem string"), "stems")


def coded(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """Rows in units of up to ``UNIT``, each with a list of its distinct tokens; a written table.

    (unit, key, codes, null) for each row, codes being places in the unit's list; (unit, null, null, words) for each unit.
    """
    at_most = UNIT

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, at_most) for k in range(0, len(whole), at_most)):
                lists, units = b.column("tokens"), b.column("unit")
                found = pc.list_flatten(lists).dictionary_encode()
                ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
                codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.indices)
                names = ["unit", "key", "codes", "words"]
                yield pa.RecordBatch.from_arrays([pa.array([units[0].as_py()] * len(b), pa.int64()), b.column("key"), codes, pa.nulls(len(b), pa.list_(pa.string()))], names)
                yield pa.RecordBatch.from_arrays([pa.array([units[0].as_py()], pa.int64()), pa.nulls(1, b.column("key").type), pa.nulls(1, codes.type),
                                                  pa.array([found.dictionary.to_pylist()], pa.list_(pa.string()))], names)

    rows = df.select(F.monotonically_increasing_id().alias("unit"), F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    return stored(rows.mapInArrow(numbered, f"unit long, key {df.schema[key].dataType.simpleString()}, codes array<int>, words array<string>"), "coded")


def stemmed_content(df: DataFrame, key: str, tokens: str, name: str = "content") -> DataFrame:
    """(key, name): the stems of each row's tokens in their order, joined by blanks.

    A row without tokens has an empty text. Rows of one key have the same text, of the tokens of all of them by place.
    """
    table = coded(df, key, tokens)
    kind = table.schema["key"].dataType.simpleString()
    lists = table.where(F.col("words").isNotNull()).select("unit", "words")
    words = stem_dictionary(lists, "words").select("token", "stem")
    found = lists.select("unit", F.posexplode("words").alias("code", "token")).join(words, "token").select("unit", "code", "stem")

    def decoded(rows: pa.Table, stems: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        codes = rows.column("codes").combine_chunks() if len(rows) else pa.array([], pa.list_(pa.int32()))
        by_code = pa.array(stems.sort_by("code").column("stem").to_pylist(), pa.string())
        texts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))), pa.int32()), by_code.take(codes.flatten()))
        return pa.table({"key": rows.column("key"), "stems": texts})

    parts = table.where(F.col("words").isNull()).select(F.col("unit").alias("of"), "key", "codes").groupBy("of").cogroup(found.groupBy("unit")).applyInArrow(decoded, f"key {kind}, stems array<string>")
    by_key = parts.groupBy(F.col("key").alias(key)).agg(F.collect_list("stems").alias("l"))
    longest = F.array_max(F.transform("l", F.size))
    merged = F.flatten(F.transform(F.sequence(F.lit(0), longest - 1), lambda p: F.array_sort(F.transform("l", lambda one: F.get(one, p)))))
    text = F.when(F.size("l") == 1, F.array_join(F.col("l")[0], " ")).when(longest > 0, F.array_join(merged, " ")).otherwise("")
    texts = by_key.select(key, text.alias(name))
    return df.select(key).join(texts, key, "left").select(key, F.coalesce(name, F.lit("")).alias(name))
