"""Sentiment model (entry 4): G8, G9, A15, X5, X7, K8.

Text preparation (X1-X4) is shared by training and scoring, so scoring sees
the same tokens the model was fitted on; ``preprocess=False`` reproduces the
reference's serving path, which skips stemming and stop-word removal (X7).

The model is a table: a row for each term with its idf and coefficient. No list
of terms reaches the driver. Fitting counts terms within their row, ranks them by
the ordered index, and makes each document's entries in its unit of rows (see
``operators.tfidf``): a term is shuffled once a unit, not once a document. The
weights are those of the relational X5 operator; ``operators.logistic`` fits the
regression on these. Scoring joins a unit's terms with the table and sums up.
No vector of the model's size reaches the driver either.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..functions.porter import stem_text
from ..operators.indexing import index_by_order
from ..operators.logistic import fit_logistic
from ..operators.tfidf import by_unit, counted, fit_idf, seen_in_training, with_idf  # noqa: F401
from ..session import forget, ship_package, stored

MAX_ITER = 1000           # reference budget
# A fit has converged when no entry of the gradient of the mean loss is larger; the reference's solver stops there.
GRADIENT_TOLERANCE = 1e-4
# A term is two or more word characters in a row, whatever stands around it.
TERM_PATTERN = r"(?U)\b\w\w+\b"
_ROW = "__row"


def prepare_text(df: DataFrame, text_col: str = "text", preprocess: bool = True,
                 stem: bool = True) -> DataFrame:
    """X1-X4 (+X6): ``content`` = cleaned, optionally stemmed text."""
    if not preprocess:
        return df.withColumn("content", X.as_text(F.col(text_col)))
    kept = X.remove_stop_words(df.withColumn("__raw_tokens", X.letter_tokens(F.col(text_col))),
                               "__raw_tokens", "__tokens")
    content = X.join_tokens(F.col("__tokens"))
    if stem:
        ship_package(df.sparkSession)      # the stemmer runs in Python workers
        content = stem_text(content)
    return kept.withColumn("content", content).drop("__raw_tokens", "__tokens")


def raw_terms() -> Column:
    """The terms of ``content``."""
    return F.regexp_extract_all(F.lower("content"), F.lit(TERM_PATTERN), F.lit(0))


def term_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) of ``content``; rows of one key are one text."""
    return df.select(key, F.explode(raw_terms()).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class FitReport:
    """How the fit went: one row of figures, and (iteration, objective, gradient_max, gradient_norm) of each iteration."""

    documents: int
    vocabulary: int
    iterations: int
    max_iter: int
    objective: float
    gradient_max: float
    gradient_norm: float
    converged: bool
    history: tuple[tuple[int, float, float, float], ...] = ()


class SentimentModel:
    """terms: (term, idf, coefficient), a written table; and an intercept."""

    def __init__(self, terms: DataFrame, intercept: float, report: FitReport):
        self.terms, self.intercept, self.report = terms, intercept, report

    def save(self, path: str) -> None:
        """K8: the table of terms as parquet, the rest as one JSON document."""
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        doc = json.dumps({"intercept": repr(self.intercept), "report": asdict(self.report)})
        self.terms.sparkSession.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SentimentModel":
        """S8 + S9: refuses a folder whose table isn't one of terms and weights."""
        doc = json.loads(spark.read.text(f"{path}/model").first()["value"])
        terms = spark.read.parquet(f"{path}/terms")
        if terms.dtypes != [("term", "string"), ("idf", "double"), ("coefficient", "double")]:
            raise TypeError(f"not a sentiment model: {terms.dtypes}")
        report = doc["report"] | {"history": tuple(map(tuple, doc["report"]["history"]))}
        return cls(terms, float(doc["intercept"]), FitReport(**report))

    def history_frame(self) -> DataFrame:
        """iteration, objective, gradient_max, gradient_norm: a row for each iteration of the fit (at most its budget)."""
        return self.terms.sparkSession.createDataFrame(list(self.report.history), "iteration int, objective double, gradient_max double, gradient_norm double")

    def report_frame(self) -> DataFrame:
        """The fit's figures as one row."""
        row = asdict(self.report) | {"tolerance": GRADIENT_TOLERANCE}
        row.pop("history")
        kinds = "documents long, vocabulary long, iterations int, max_iter int, objective double, gradient_max double, gradient_norm double, converged boolean, tolerance double"
        return self.terms.sparkSession.createDataFrame([tuple(row.values())], kinds)


def weigh(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(row, at, weight): L2-normalised tf * idf under the terms' numbers; terms that the fit didn't see are dropped."""
    raw = counts.join(vocabulary, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(_ROW)))
    return raw.select(_ROW, F.col("at").cast("int").alias("at"), (F.col("raw") / norm).alias("weight"))


def vectors(rows: DataFrame, weights: DataFrame, label: str) -> DataFrame:
    """(row, label, indices, values): each row's entries in the order of the terms' numbers; a row without terms has none."""
    entries = weights.groupBy(_ROW).agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("e"))
    part = lambda name, kind: F.coalesce(F.transform("e", lambda x: x[name]), F.array().cast(f"array<{kind}>"))
    return (rows.select(_ROW, F.col(label).cast("double").alias("label")).join(entries, _ROW, "left")
            .select(_ROW, "label", part("at", "int").alias("indices"), part("weight", "double").alias("values")))


def unit_vectors(table: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(label, indices, values) of the rows of ``tfidf.counted``, whose key is the label: the entries of ``weigh`` and ``vectors``."""
    def entries(rows: pa.Table, words: pa.Table, place, at, tf, raw, norm) -> pa.Table:
        number = words.column("at").to_numpy()[place]
        order = np.lexsort((number, at))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(at, minlength=len(rows)))), pa.int32())
        return pa.table({"label": rows.column("key"), "indices": pa.ListArray.from_arrays(ends, pa.array(number[order], pa.int32())),
                         "values": pa.ListArray.from_arrays(ends, pa.array((raw / norm[at])[order], pa.float64()))})

    numbered = vocabulary.select("term", "idf", F.col("at").cast("int").alias("at"))
    return by_unit(table, numbered, entries, "label double, indices array<int>, values array<double>")


def fit(train: DataFrame, label: str = "target", max_iter: int = MAX_ITER,
        reg_param: float | None = None) -> SentimentModel:
    """TF-IDF + logistic regression (L2, C = 1 -> regParam = 1 / n), until it has converged or ``max_iter`` is used up.

    Rows without a label cannot be fitted and are skipped.
    """
    rows = train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), F.lit("train").alias("split"), "content")
    counts = counted(rows, "label", raw_terms(), "split", "train")
    n = counts.where(F.col("words").isNull()).count()
    if not n:
        raise ValueError("no rows with a label")
    seen = stored(seen_in_training(counts).groupBy("term").agg(F.sum("seen").alias("df")), "document-frequencies")
    vocabulary = stored(index_by_order(with_idf(seen, n).select("term", "idf"), ["term"], "at"), "vocabulary")
    size = vocabulary.count()
    data = stored(unit_vectors(counts, vocabulary), "vectors")
    reg = reg_param if reg_param is not None else 1.0 / n
    fitted = fit_logistic(data, size, reg, GRADIENT_TOLERANCE, max_iter)
    iteration, objective, largest, norm = fitted.history[-1]
    report = FitReport(n, size, iteration, max_iter, objective, largest, norm, fitted.converged, tuple(fitted.history))
    terms = with_coefficients(vocabulary, fitted.weights)
    kept = stored(terms.select("term", "idf", "coefficient"), "terms")
    for table in (counts, seen, vocabulary, data):
        forget(table)
    return SentimentModel(kept, fitted.intercept, report)


def with_coefficients(vocabulary: DataFrame, weights: DataFrame) -> DataFrame:
    """(term, idf, at, coefficient): the fitted coefficients, numbers by place, joined with the terms."""
    return vocabulary.withColumn("at", F.col("at").cast("long")).join(weights, "at")


def margins(model: SentimentModel, rows: DataFrame, key: str, may_repeat: bool) -> DataFrame:
    """(key, margin) without the intercept, of the keys with a known term; rows of one key are one text.

    Terms are joined with the model once a unit of rows; only rows whose key comes again are counted as (key, term) rows.
    """
    weights = model.terms.select("term", "idf", "coefficient")
    rows = rows.where(F.col(key).isNotNull()).select(key, F.lit("train").alias("split"), "content")
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key) if may_repeat else None
    repeated = None if again is None or again.isEmpty() else stored(again, "repeated-keys")
    kind = rows.schema[key].dataType.simpleString()

    def summed(rows: pa.Table, words: pa.Table, place, at, tf, raw, norm) -> pa.Table:
        known = np.flatnonzero(norm > 0)
        margin = np.bincount(at, weights=raw * words.column("coefficient").to_numpy()[place], minlength=len(rows))[known] / norm[known]
        return pa.table({"key": rows.column("key").take(pa.array(known)), "margin": pa.array(margin, pa.float64())})

    once = rows if repeated is None else rows.join(repeated, key, "left_anti")
    sums = by_unit(counted(once, key, raw_terms(), "split", "train"), weights, summed, f"key {kind}, margin double").withColumnRenamed("key", key)
    if repeated is None:
        return sums
    raw = term_counts(rows.join(repeated, key, "left_semi"), key).join(weights, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    return sums.unionByName(raw.groupBy(key).agg((F.sum(F.col("raw") * F.col("coefficient")) / F.sqrt(F.sum(F.col("raw") * F.col("raw")))).alias("margin")))


def score(model: SentimentModel, df: DataFrame, key: str | None = None) -> DataFrame:
    """G9 + B7: the rows with margin, probability, predicted class and its label text.

    Rows are told apart by ``key``, which must be unique, or else by a number
    that is written down with them.
    """
    rows = df if key is not None else stored(df.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    own = key or _ROW
    sums = margins(model, rows, own, key is not None)
    out = rows.join(sums, own, "left").withColumn("margin", F.coalesce("margin", F.lit(0.0)) + F.lit(model.intercept))
    out = out.withColumns({"probability": F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin"))), "prediction": (F.col("margin") > 0).cast("double")})
    out = out.withColumn("sentiment", R.sentiment_label(F.col("prediction")))
    return out if key is not None else out.drop(_ROW)


def accuracy(scored: DataFrame, label: str = "target", by: str | None = None) -> DataFrame:
    """A15 (per split when ``by`` is given) and A8 positive share."""
    acc = F.avg((F.col(label).cast("double") == F.col("prediction")).cast("double")).alias("accuracy")
    pos = (F.avg((F.col("prediction") == 1).cast("double")) * 100).alias("positive_pct")
    n = F.count(F.lit(1)).alias("rows")
    return scored.groupBy(by).agg(n, acc, pos) if by else scored.agg(n, acc, pos)


def score_file(spark, path: str, text_column: str, model: SentimentModel, out_dir: str,
               preprocess: bool = False) -> dict:
    """The review-scoring page: S4 -> V3 -> X6/X7 -> G9 -> B7 -> A1/A8 -> K1.

    ``preprocess=False`` is the reference's serving path (no stemming or
    stop-word removal); ``True`` scores the same tokens the model was fitted on.
    The scored rows are written once; the CSV and the reports read that table.
    """
    from ..operators import quality as Q
    from ..sources import readers, sinks

    df = readers.read_text_csv(spark, path, text_column)
    if Q.is_empty(df):
        raise Q.ValidationError("the uploaded file has no rows")
    scored = stored(score(model, prepare_text(df, text_column, preprocess=preprocess)).select(*df.columns, "sentiment"), "scored")
    written = sinks.write_csv(scored, sinks.timestamped(out_dir, "sentiment"))
    counts = {r["sentiment"]: r["count"] for r in scored.groupBy("sentiment").count().collect()}   # A1
    total = sum(counts.values())
    return {"path": written, "counts": counts,
            "positive_pct": (100.0 * counts.get("Positive", 0) / total) if total else 0.0}      # A8
