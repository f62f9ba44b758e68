"""Skew-shaped inputs: one key holding a large share of the rows must not change results."""

import math

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text as X
from shelfwise.operators import features as FE
from shelfwise.operators.drift import ks_two_sample
from shelfwise.operators.tfidf import tfidf


def test_vocabulary_with_a_dominant_value(spark):
    rows = [("hot",)] * 3000 + [(f"v{i % 70}",) for i in range(6000)]
    df = spark.createDataFrame(rows, "brand string").repartition(7)
    got = {r["value"] for r in FE.fit_vocabulary(df, ["brand"], [], top=50).collect()}
    counts = {}
    for (v,) in rows:
        counts[v] = counts.get(v, 0) + 1
    want = {v for v, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:50]} | {"Unknown", "Other"}
    assert got == want


def test_tfidf_with_a_term_in_every_document(spark):
    docs = {i: ("common " * 50 + f"rare{i % 5} word{i % 3}").strip() for i in range(60)}
    rows = [(i, "train" if i % 4 else "test", t) for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id int, split string, content string").repartition(5)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf(df, "doc_id", X.terms(F.col("content"))).collect()}
    train = [i for i, s, _ in rows if s == "train"]
    dfreq = {}
    for i in train:
        for t in set(docs[i].split()):
            dfreq[t] = dfreq.get(t, 0) + 1
    for i, text in docs.items():
        tf = {}
        for t in text.split():
            if t in dfreq:
                tf[t] = tf.get(t, 0) + 1
        raw = {t: c * (math.log((1 + len(train)) / (1 + dfreq[t])) + 1) for t, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for t, v in raw.items():
            assert got[(i, t)] == pytest.approx(v / norm, abs=1e-6)


def test_ks_with_a_hot_value(spark):
    a = [5.0] * 400 + [float(i % 17) for i in range(200)]
    b = [5.0] * 100 + [float(i % 13) for i in range(300)]
    df = spark.createDataFrame([(v, "train") for v in a] + [(v, "val") for v in b],
                               "y double, split string").repartition(6)
    r = ks_two_sample(df, "y", "split", "train", "val").first()
    vals = sorted(set(a) | set(b))
    d = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in vals)
    assert r["statistic"] == pytest.approx(d, abs=1e-12)
