"""Smoothed TF-IDF (X5) as relational Spark jobs.

tf = raw count of a term in a document; idf fitted on the training
documents: ``ln((1 + n) / (1 + df)) + 1``; each document's vector L2-
normalised; terms unseen at fit are dropped.

Plan: terms are counted within their row, rows are taken in units of up to
``UNIT``, each with a list of its distinct terms and of how many of its training
rows have them, and a row holds places in that list. Document frequencies come
from the lists; so does the join with the idf: a term is shuffled once a unit, not
once a document. The lists then go to their units' rows, where weights and norms are
made. Only rows whose key comes again are counted, joined and normalised as
(doc, term) rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

MIN_TERM_LENGTH = 2
#: Rows of a unit, at most.
UNIT = 1024


def fit_idf(tf: DataFrame, doc_key: str, n_docs: int) -> DataFrame:
    """(term, df, idf) from the training documents' term counts."""
    return with_idf(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_docs)


def with_idf(found: DataFrame, n_docs: int) -> DataFrame:
    return found.withColumn("idf", F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def apply_idf(tf: DataFrame, idf: DataFrame, doc_key: str) -> DataFrame:
    """(doc, term, tf, weight) with L2-normalised weights; unseen terms dropped."""
    w = tf.join(idf.select("term", "idf"), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc_key)))
    return w.withColumn("weight", F.col("raw") / norm).drop("raw", "idf")


def counted(docs: DataFrame, doc_key: str, terms: Column, split_col: str, train_value: str) -> DataFrame:
    """Rows in units, a written table: (unit, key, split, codes, tfs) for each row, codes being places in the unit's list of
    distinct terms; (unit, words, seen) for each unit, ``seen`` being the training rows with the term."""
    at_most, shortest = UNIT, MIN_TERM_LENGTH
    ints, longs, strings = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, at_most) for k in range(0, len(whole), at_most)):
                lists = b.column("terms")
                row = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                flat = pc.list_flatten(lists)
                long = pc.fill_null(pc.greater_equal(pc.utf8_length(flat), shortest), False)
                found = flat.filter(long).dictionary_encode()
                words = found.dictionary.cast(pa.string())
                row = row[long.to_numpy(zero_copy_only=False)]
                pairs, tfs = np.unique(row * max(1, len(words)) + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
                at, codes = np.divmod(pairs, max(1, len(words)))
                train = pc.fill_null(pc.equal(b.column("split"), train_value), False).to_numpy(zero_copy_only=False)
                seen = np.bincount(codes[train[at]], minlength=len(words))
                ends = pa.array(np.append(0, np.cumsum(np.bincount(at, minlength=len(b)))), pa.int32())
                unit, key, split = b.column("unit"), b.column("key"), b.column("split")
                names = ["unit", "key", "split", "codes", "tfs", "words", "seen"]
                yield pa.RecordBatch.from_arrays([pa.array([unit[0].as_py()] * len(b), pa.int64()), key, split, pa.ListArray.from_arrays(ends, pa.array(codes, pa.int32())),
                                                  pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())), pa.nulls(len(b), strings), pa.nulls(len(b), longs)], names)
                whole_list = pa.array([0, len(words)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([unit[0].as_py()], pa.int64()), pa.nulls(1, key.type), pa.nulls(1, split.type), pa.nulls(1, ints), pa.nulls(1, longs),
                                                  pa.ListArray.from_arrays(whole_list, words), pa.ListArray.from_arrays(whole_list, pa.array(seen, pa.int64()))], names)

    rows = docs.select(F.monotonically_increasing_id().alias("unit"), F.col(doc_key).alias("key"), F.col(split_col).cast("string").alias("split"), terms.alias("terms"))
    kind = docs.schema[doc_key].dataType.simpleString()
    return stored(rows.mapInArrow(numbered, f"unit long, key {kind}, split string, codes array<int>, tfs array<long>, words array<string>, seen array<long>"), "term-counts")


def seen_in_training(table: DataFrame) -> DataFrame:
    """(term, seen): the training rows with the term, a row for each term and unit of ``counted``."""
    zipped = table.where(F.col("words").isNotNull()).select(F.explode(F.arrays_zip("words", "seen")).alias("w"))
    return zipped.select(F.col("w.words").alias("term"), F.col("w.seen").alias("seen")).where(F.col("seen") > 0)


def by_unit(table: DataFrame, terms: DataFrame, make: Callable[..., pa.Table], schema: str) -> DataFrame:
    """What ``make`` makes of a unit's rows and of the rows of ``terms`` (term, idf and more) for the terms in them.

    ``make`` gets the unit's rows of ``counted``, the rows of ``terms`` that it needs, and arrays with an entry for each
    row's distinct term that ``terms`` has: the place in the latter, the row, its tf, tf * idf; and the norm of each row.
    """
    lists = table.where(F.col("words").isNotNull())
    found = lists.select("unit", F.posexplode("words").alias("code", "term")).join(terms, "term").select("unit", "code", *terms.columns)

    def made(rows: pa.Table, words: pa.Table) -> pa.Table:
        codes, tfs = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("codes", "tfs"))
        at = np.repeat(np.arange(len(rows)), pc.list_value_length(rows.column("codes")).to_numpy())
        code = words.column("code").to_numpy()
        place = np.full(max(codes.max(initial=-1), code.max(initial=-1)) + 1, -1)
        place[code] = np.arange(len(code))
        place = place[codes]
        known = place >= 0
        place, at, tf = place[known], at[known], tfs[known]
        raw = tf * words.column("idf").to_numpy()[place]
        norm = np.sqrt(np.bincount(at, weights=raw * raw, minlength=len(rows)))
        return make(rows, words, place, at, tf, raw, norm)

    rows = table.where(F.col("words").isNull()).select(F.col("unit").alias("of"), "key", "split", "codes", "tfs")
    return rows.groupBy("of").cogroup(found.groupBy("unit")).applyInArrow(made, schema)


def weighed(table: DataFrame, idf: DataFrame, doc_key: str, split_col: str) -> DataFrame:
    """(term, doc, split, tf, weight) of the rows of ``counted``, each a document of its own."""
    kind = table.schema["key"].dataType.simpleString()

    def weights(rows: pa.Table, words: pa.Table, place, at, tf, raw, norm) -> pa.Table:
        return pa.table({"term": words.column("term").take(pa.array(place)), "key": rows.column("key").take(pa.array(at)), "split": rows.column("split").take(pa.array(at)),
                         "tf": pa.array(tf, pa.int64()), "weight": pa.array(raw / norm[at], pa.float64())})

    out = by_unit(table, idf.select("term", "idf"), weights, f"term string, key {kind}, split string, tf long, weight double")
    return out.select("term", F.col("key").alias(doc_key), F.col("split").alias(split_col), "tf", "weight")


def tfidf(docs: DataFrame, doc_key: str, terms: Column, split_col: str = "split",
          train_value: str = "train") -> DataFrame:
    """Fit on the training documents and apply to all; rows of one key are one document.

    The texts are read once, or twice if a key comes again: rows of such keys
    become (doc, term, tf) rows, written to the shared folder. A document without
    terms is a row there too, so it counts as a document.
    """
    again = docs.groupBy(doc_key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select(F.col(doc_key).alias("__again"))
    repeated = None if again.isEmpty() else stored(again, "repeated-keys")
    same = None if repeated is None else docs[doc_key].eqNullSafe(repeated["__again"])
    table = counted(docs if repeated is None else docs.join(repeated, same, "left_anti"), doc_key, terms, split_col, train_value)
    n_docs = table.where(F.col("words").isNull()).where(F.col("split") == train_value).count()
    df = seen_in_training(table)
    if repeated is not None:
        exploded = docs.join(repeated, same, "left_semi").select(doc_key, split_col, F.explode_outer(terms).alias("term"))
        exploded = exploded.withColumn("term", F.when(F.length("term") >= MIN_TERM_LENGTH, F.col("term")))
        every = stored(exploded.groupBy(doc_key, split_col, "term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
        train = every.where(F.col(split_col) == train_value)
        n_docs += train.select(doc_key).distinct().count()
        df = df.unionByName(train.where(F.col("term").isNotNull()).select("term", F.lit(1).cast("long").alias("seen")))
    idf = with_idf(df.groupBy("term").agg(F.sum("seen").alias("df")), n_docs)
    out = weighed(table, idf, doc_key, split_col)
    if repeated is None:
        return out
    return out.unionByName(apply_idf(every.where(F.col("term").isNotNull()), idf, doc_key))
