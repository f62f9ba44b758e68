"""Text (X1-X5), Porter stems (golden pairs), KS drift against brute force."""

import math

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import porter
from shelfwise.functions import text as X
from shelfwise.operators.drift import ks_two_sample
from shelfwise.operators.tfidf import tfidf

GOLDEN = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "digitizer": "digit", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "communism": "commun", "activate": "activ", "homologous": "homolog", "effective": "effect",
    "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
    "roll": "roll", "generalizations": "gener", "dying": "die", "is": "is", "a": "a",
}


def test_porter_golden_pairs():
    wrong = {w: (porter.stem(w), s) for w, s in GOLDEN.items() if porter.stem(w) != s}
    assert not wrong


def test_stem_batch_keeps_shape():
    import pandas as pd
    s = pd.Series([["cats", "running", "cats"], None, []])
    out = porter.stem_batch(s)
    assert out[0] == ["cat", "run", "cat"] and out[1] is None and out[2] == []


def test_tokens_stop_words_keep_negations(spark):
    df = spark.createDataFrame([("I am NOT happy, it's the café!!",), (None,)], "text string")
    got = [r["t"] for r in X.remove_stop_words(df.select(X.letter_tokens(F.col("text")).alias("raw")), "raw", "t").collect()]
    assert got[0] == ["not", "happy", "caf"] and got[1] == []


def _brute_tfidf(docs, train_ids):
    df = {}
    for i in train_ids:
        for t in set(docs[i]):
            df[t] = df.get(t, 0) + 1
    n = len(train_ids)
    out = {}
    for i, toks in docs.items():
        tf = {}
        for t in toks:
            if t in df:
                tf[t] = tf.get(t, 0) + 1
        raw = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(i, t): v / norm for t, v in raw.items()})
    return out


def test_tfidf_matches_brute_force(spark):
    texts = {1: "good good movie", 2: "bad movie plot", 3: "good plot twist", 4: "unseen word good"}
    train = [1, 2, 3]
    rows = [(i, "train" if i in train else "test", t) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id int, split string, content string")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf(df, "doc_id", X.terms(F.col("content"))).collect()}
    want = _brute_tfidf({i: t.split() for i, t in texts.items()}, train)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


def _brute_ks(a, b):
    vals = sorted(set(a) | set(b))
    d = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in vals)
    lam = math.sqrt(len(a) * len(b) / (len(a) + len(b))) * d
    p = 1.0 if lam < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam)
                                                        for k in range(1, 101))))
    return d, p


def test_ks_matches_brute_force(spark):
    a = [float((i * 7) % 23) for i in range(200)]
    b = [float((i * 5) % 29) for i in range(150)]
    rows = [(v, "train") for v in a] + [(v, "val") for v in b]
    df = spark.createDataFrame(rows, "y double, split string").repartition(3)
    r = ks_two_sample(df, "y", "split", "train", "val").first()
    d, p = _brute_ks(a, b)
    assert r["n1"] == 200 and r["n2"] == 150
    assert r["statistic"] == pytest.approx(d, abs=1e-12)
    assert r["p_value"] == pytest.approx(p, abs=1e-9)


def test_tfidf_of_repeated_and_null_keys_over_several_units(spark, monkeypatch):
    from shelfwise.operators import tfidf as W
    monkeypatch.setattr(W, "UNIT", 2)
    rows = [(1, "train", "good good movie"), (2, "train", "bad movie plot a"), (2, "train", "bad bad twist"), (None, "test", "good plot"),
            (None, "test", "plot unseen"), (3, "train", ""), (4, "test", "unseen word good"), (5, "train", "plot good a b"), (6, "test", "")]
    df = spark.createDataFrame(rows, "doc_id int, split string, content string").repartition(3)
    got = {(r["doc_id"], r["term"]): (r["split"], r["tf"], r["weight"]) for r in tfidf(df, "doc_id", X.terms(F.col("content"))).collect()}
    texts = {}
    for i, _, t in rows:
        texts.setdefault(i, []).extend(x for x in t.split() if len(x) > 1)
    want = _brute_tfidf(texts, [1, 2, 3, 5])
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][2] == pytest.approx(v, abs=1e-9) and got[k][1] == texts[k[0]].count(k[1])
        assert got[k][0] == ("train" if k[0] in (1, 2, 3, 5) else "test")


def test_tfidf_needs_no_window_over_the_rows_of_all_documents(spark):
    df = spark.createDataFrame([(i, "train" if i % 3 else "test", f"common word{i % 4}") for i in range(30)], "doc_id int, split string, content string")
    plan = tfidf(df, "doc_id", X.terms(F.col("content")))._jdf.queryExecution().toString()
    assert "Window" not in plan and "FlatMapCoGroup" in plan
