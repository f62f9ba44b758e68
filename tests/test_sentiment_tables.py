"""The text model as a table: its features, its fit, what it scores; stemming by vocabulary."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text as X
from shelfwise.functions.porter import stem, stem_text
from shelfwise.operators import logistic as LG
from shelfwise.operators import tfidf as TF
from shelfwise.operators.stemming import stem_dictionary, stemmed_content
from shelfwise.operators.tfidf import tfidf
from shelfwise.plans import sentiment as SJ

TEXTS = ["good good movie", "bad movie plot", "good plot twist", "awful bad bad end", "", "x", None, "good end, good day", "bad day", "movie"]


def data(spark):
    rows = [(k, t, k % 2 if k % 5 else None) for k, t in enumerate(TEXTS)] + [(100 + k, t, int("good" in (t or ""))) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, content string, target int")


def margins(model, df):
    return {r["id"]: r["margin"] for r in SJ.score(model, df, "id").collect()}


def test_features_are_those_of_the_relational_tfidf(spark):
    docs = data(spark).withColumn("split", F.lit("train"))
    want = {(r["id"], r["term"]): r["weight"] for r in tfidf(docs.withColumn("content", F.coalesce("content", F.lit(""))), "id", F.split(F.regexp_replace("content", ",", ""), " ")).collect()}
    rows = docs.select(F.col("id").alias(SJ._ROW), "target", "content")
    counts = SJ.term_counts(rows, SJ._ROW)
    vocabulary = SJ.index_by_order(SJ.fit_idf(counts, SJ._ROW, rows.count()).select("term", "idf"), ["term"], "at")
    terms = {r["at"]: r["term"] for r in vocabulary.collect()}
    assert list(terms.values()) == sorted(terms.values())
    made = SJ.vectors(rows, SJ.weigh(counts, vocabulary), "target").collect()
    assert len(made) == 20 and all(r["indices"] == sorted(r["indices"]) and len(r["indices"]) == len(r["values"]) for r in made)
    got = {(r[SJ._ROW], terms[i]): v for r in made for i, v in zip(r["indices"], r["values"])}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_margins_are_those_of_the_fitted_regression_and_survive_saving(spark, tmp_dir):
    df = data(spark)
    model = SJ.fit(df)
    assert model.report.converged and model.report.gradient_max <= SJ.GRADIENT_TOLERANCE and model.report.iterations < SJ.MAX_ITER
    terms = {r["term"]: (r["idf"], r["coefficient"]) for r in model.terms.collect()}
    got = margins(model, df)
    for k, t in enumerate(TEXTS):
        words = [w.strip(",") for w in (t or "").split() if len(w.strip(",")) > 1]
        raw = {w: words.count(w) * terms[w][0] for w in set(words)}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        assert got[k] == pytest.approx(model.intercept + sum(v * terms[w][1] for w, v in raw.items()) / norm, abs=1e-9)
    model.save(f"{tmp_dir}/m")
    again = SJ.SentimentModel.load(spark, f"{tmp_dir}/m")
    assert margins(again, df) == pytest.approx(got) and again.report == model.report
    assert SJ.score(again, df).count() == 20 and SJ.score(again, df.select("content")).where("prediction is null").count() == 0
    spark.range(1).write.parquet(f"{tmp_dir}/other/terms")
    model.terms.sparkSession.read.text(f"{tmp_dir}/m/model").write.text(f"{tmp_dir}/other/model")
    with pytest.raises(TypeError):
        SJ.SentimentModel.load(spark, f"{tmp_dir}/other")


def test_a_fit_that_is_cut_says_so(spark):
    model = SJ.fit(data(spark), max_iter=1)
    assert not model.report.converged and model.report.iterations == 1
    assert model.report_frame().first()["tolerance"] == SJ.GRADIENT_TOLERANCE
    rows = SJ.fit(data(spark)).history_frame().orderBy("iteration").collect()
    assert rows[0]["iteration"] == 0 and rows[-1]["objective"] < rows[0]["objective"]
    with pytest.raises(ValueError):
        SJ.fit(data(spark).limit(0))


def drawn(n=60, d=7, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * (rng.random((n, d)) < 0.4) * np.array([1, 1, 0.01, 5, 1, 1, 1])
    return x, (x @ rng.standard_normal(d) + rng.standard_normal(n) > 0.3).astype(float)


def sparse(spark, x, y, parts=3):
    rows = [(float(t), [int(j) for j in np.nonzero(r)[0]], [float(v) for v in r[np.nonzero(r)[0]]]) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "label double, indices array<int>, values array<double>").repartition(parts)


def test_gradient_by_brute_force(spark, monkeypatch):
    """At coefficients that are not the best ones, in several blocks, against a sum over all rows."""
    monkeypatch.setattr(LG, "BLOCK", 3)
    (x, y), beta = drawn(), np.linspace(-1, 1, 7)
    loss, g, by_intercept, n = LG.loss_and_gradient(sparse(spark, x, y), 7, beta, 0.3)
    z = x @ beta + 0.3
    missed = 1 / (1 + np.exp(-z)) - y
    assert (loss, by_intercept, n) == pytest.approx((np.log1p(np.exp(z)).sum() - y @ z, missed.sum(), 60)) and g == pytest.approx(x.T @ missed)


def test_the_minimum_is_that_of_newton(spark):
    x, y = drawn()
    reg, wide = 0.02, np.hstack([x, np.ones((60, 1))])
    beta, penalty = np.zeros(8), np.diag([0.02] * 7 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-wide @ beta))
        beta -= np.linalg.solve((wide.T * (p * (1 - p))) @ wide / 60 + penalty, wide.T @ (p - y) / 60 + penalty @ beta)
    found = LG.fit_logistic(sparse(spark, x, y), 7, reg, 1e-8, 200)
    assert found.converged and np.append(found.coefficients, found.intercept) == pytest.approx(beta, abs=1e-5)
    objectives = [o for _, o, _, _ in found.history]
    assert objectives == sorted(objectives, reverse=True) and found.history[-1][2] <= 1e-8


def test_rows_of_one_class_and_no_rows(spark):
    x, y = drawn(20)
    one = LG.fit_logistic(sparse(spark, x, np.ones(20)), 7, 0.1, 1e-4, 100)
    assert np.isfinite(one.coefficients).all() and one.intercept > 2
    with pytest.raises(ValueError):
        LG.fit_logistic(sparse(spark, x, y).limit(0), 7, 0.1, 1e-4, 100)


def test_both_ways_of_stemming_agree(spark):
    docs = spark.createDataFrame([(1, ["running", "runs", "easily"]), (2, []), (3, ["the"] * 50 + ["cats"]), (4, ["cats", "dying", "the"])], "id long, tokens array<string>")
    a = {r["id"]: r["content"] for r in stemmed_content(docs, "id", "tokens").collect()}
    b = {r["id"]: r["content"] for r in docs.select("id", stem_text(X.join_tokens(F.col("tokens"))).alias("content")).collect()}
    assert a == b and a[2] == "" and a[1] == "run run easili"
    words = stem_dictionary(docs, "tokens").collect()
    assert {r["token"]: (r["n"], r["stem"]) for r in words}["the"] == (51, "the") and len(words) == 6
    assert all(r["stem"] == stem(r["token"]) for r in words)
    assert stemmed_content(docs.limit(0), "id", "tokens").count() == 0


def test_entries_made_by_unit_are_those_of_the_relational_steps(spark, monkeypatch):
    """in several units, with copies, an empty text and a null one."""
    monkeypatch.setattr(TF, "UNIT", 3)
    docs = data(spark).where("target is not null").coalesce(2).select(F.monotonically_increasing_id().alias(SJ._ROW), F.col("target").cast("double").alias("label"), F.lit("train").alias("split"), "content")
    counts = SJ.term_counts(docs, SJ._ROW)
    vocabulary = SJ.index_by_order(SJ.fit_idf(counts, SJ._ROW, docs.count()).select("term", "idf"), ["term"], "at")
    want = SJ.vectors(docs, SJ.weigh(counts, vocabulary), "label").collect()
    got = SJ.unit_vectors(TF.counted(docs, "label", SJ.raw_terms(), "split", "train"), vocabulary).collect()
    plain = lambda rows: sorted((r["label"], r["indices"], [round(v, 12) for v in r["values"]]) for r in rows)
    assert len(got) == docs.count() and plain(got) == plain(want)


def test_no_row_for_each_document_and_term(spark, monkeypatch):
    """the fit and the scoring shuffle a term once a unit; rows of one key are one text, a null key has none."""
    model = SJ.fit(data(spark))
    again = data(spark).select("id", "content").unionAll(spark.createDataFrame([(0, "bad bad plot"), (None, "good")], "id long, content string"))
    raw = SJ.term_counts(again, "id").join(model.terms, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    want = {r["id"]: r["m"] for r in raw.where("id is not null").groupBy("id").agg((F.sum(F.col("raw") * F.col("coefficient")) / F.sqrt(F.sum(F.col("raw") * F.col("raw")))).alias("m")).collect()}
    got = [(r["id"], r["margin"]) for r in SJ.score(model, again, "id").collect()]
    assert len(got) == again.count() and all(m == pytest.approx(model.intercept + want.get(k, 0.0), abs=1e-9) for k, m in got)

    def refuse(df, key):
        raise AssertionError("a row for each document and term")

    monkeypatch.setattr(SJ, "term_counts", refuse)
    model = SJ.fit(data(spark))
    assert SJ.score(model, data(spark), "id").count() == 2 * len(TEXTS) and SJ.score(model, data(spark)).count() == 2 * len(TEXTS)
