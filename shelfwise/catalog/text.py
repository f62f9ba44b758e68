"""Text queries: cleaning, labels, baseline accuracy, stems, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..functions.porter import stem_text
from ..operators import report as REP
from ..operators.split import exact_split, hash_split, share_threshold, stratified_hash_split
from ..operators.stemming import stemmed_content, vocabulary
from ..operators.tfidf import tfidf
from ..sources.adapters import reviews
from ..sources.tables import table

SENTIMENT_SEED = 2
TEST_SHARE = 0.2


def clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    raw = docs.select("doc_id", X.letter_tokens(F.col("text")).alias("raw_tokens"))
    return X.remove_stop_words(raw, "raw_tokens", "tokens").drop("raw_tokens")


def q_document_tokens(spark, sf_dir):
    """X1 + X2 + X4 (+ X6) over every document, whole texts."""
    t = clean_documents(spark, sf_dir)
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), X.join_tokens(F.col("tokens")).alias("content"))


def labelled(spark, sf_dir):
    """D3 + B14 + E11: relabelled targets and the stratified split."""
    r = reviews(spark, sf_dir).withColumn("target", R.relabel(F.col("target")))
    return stratified_hash_split(r, "doc_id", "target", TEST_SHARE, SENTIMENT_SEED)


def q_review_labels(spark, sf_dir):
    """B14 + A1 + A8 + B7: label frequencies and shares."""
    r = labelled(spark, sf_dir)
    # the total comes from the aggregated rows (one per class): same job, bounded window
    total = F.sum("count").over(Window.partitionBy())
    return (REP.frequency(r, "target", "count")                                   # A1
            .withColumn("share_pct", F.col("count") / total.cast("double") * 100)
            .withColumn("label", R.sentiment_label(F.col("target"))))


def q_review_split(spark, sf_dir):
    """E11 + V12: rows per split and class."""
    return labelled(spark, sf_dir).groupBy("split", "target").agg(F.count(F.lit(1)).alias("rows"))


def q_review_majority_accuracy(spark, sf_dir):
    """A15 for the majority-class baseline fitted on train."""
    r = labelled(spark, sf_dir)
    top = (r.where(F.col("split") == "train").groupBy("target").count()
           .orderBy(F.col("count").desc(), F.col("target").asc()).first())
    majority = int(top["target"]) if top else 0
    return r.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col("target") == F.lit(majority)).cast("double")).alias("accuracy"),
        F.lit(majority).alias("majority_label"))


def q_review_stems(spark, sf_dir):
    """X1 + X2 + X3 + X4: stemmed content of every document (rows-only check)."""
    return clean_documents(spark, sf_dir).select("doc_id", stem_text(X.join_tokens(F.col("tokens"))).alias("stemmed_content"))


def q_review_vocabulary(spark, sf_dir):
    """How often each distinct token stands in the cleaned documents: what the stemmer sees, once each."""
    return vocabulary(clean_documents(spark, sf_dir), "tokens")


def q_review_stems_by_vocabulary(spark, sf_dir):
    """X3 by the dictionary of distinct tokens, joined back: the rows of ``review_stems``."""
    return stemmed_content(clean_documents(spark, sf_dir), "doc_id", "tokens", "stemmed_content")


def q_review_split_exact(spark, sf_dir):
    """E11 with exact sizes: a fifth of each class, the largest remainders first."""
    r = reviews(spark, sf_dir).withColumn("target", R.relabel(F.col("target")))
    return exact_split(r, "doc_id", TEST_SHARE, SENTIMENT_SEED, "target").select("doc_id", "target", "split")


def q_document_tfidf(spark, sf_dir):
    """TF-IDF of every document, idf fitted on the training split (E10 by doc)."""
    t = q_document_tokens(spark, sf_dir)
    s = hash_split(t, "doc_id", TEST_SHARE, SENTIMENT_SEED)
    return tfidf(s, "doc_id", X.terms(F.col("content"))).select("doc_id", "split", "term", "tf", F.round("weight", REP.METRIC_DIGITS).alias("weight"))


QUERIES = {
    "document_tokens": q_document_tokens,
    "review_labels": q_review_labels,
    "review_split": q_review_split,
    "review_majority_accuracy": q_review_majority_accuracy,
    "review_stems": q_review_stems,
    "review_vocabulary": q_review_vocabulary,
    "review_stems_by_vocabulary": q_review_stems_by_vocabulary,
    "review_split_exact": q_review_split_exact,
    "document_tfidf": q_document_tfidf,
}

# ---------------------------------------------------------------- SQL oracle

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in X.sentiment_stop_words())
_T = share_threshold(TEST_SHARE)

TOKENS = f"""
toks AS (
  SELECT doc_id,
    list_filter(list_filter(string_split_regex(lower(regexp_replace(coalesce(CAST(text AS VARCHAR), ''), '[^a-zA-Z]', ' ', 'g')), '\\s+'),
                            lambda x: x <> ''),
                lambda x: NOT list_contains([{_STOP}], x)) AS tokens
  FROM documents),
doc_tokens AS (SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS content FROM toks)
"""

LABELLED = f"""
lab AS (
  SELECT d.doc_id, CASE WHEN l.quality * 4 = 4 THEN 1 ELSE l.quality * 4 END AS target
  FROM documents d JOIN labels l USING (doc_id)),
labelled AS (
  SELECT *, CASE WHEN substr(md5(CAST(target AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR) || '|{SENTIMENT_SEED}'), 1, 4) < '{_T}'
                 THEN 'test' ELSE 'train' END AS split
  FROM lab)
"""

SQL = {
    "document_tokens": f"WITH {TOKENS} SELECT * FROM doc_tokens",
    "review_labels": f"""WITH {LABELLED}
SELECT target, count(*) AS count, count(*) / CAST((SELECT count(*) FROM labelled) AS DOUBLE) * 100 AS share_pct,
       CASE WHEN target = 1 THEN 'Positive' ELSE 'Negative' END AS label
FROM labelled GROUP BY target""",
    "review_split": f"WITH {LABELLED} SELECT split, target, count(*) AS rows FROM labelled GROUP BY split, target",
    "review_vocabulary": f"WITH {TOKENS} SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM toks) GROUP BY token",
    "review_split_exact": f"""WITH {LABELLED},
share AS (SELECT target, n, wanted * n // sum(n) OVER () AS least, wanted * n % sum(n) OVER () AS rest, wanted
          FROM (SELECT target, count(*) AS n, CAST(ceil(sum(count(*)) OVER () / 5) AS BIGINT) AS wanted FROM lab GROUP BY target)),
quota AS (SELECT target, least + CASE WHEN row_number() OVER (ORDER BY rest DESC, target) <= wanted - sum(least) OVER () THEN 1 ELSE 0 END AS quota FROM share)
SELECT doc_id, target, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY md5(CAST(target AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR) || '|{SENTIMENT_SEED}')) <= quota
                            THEN 'test' ELSE 'train' END AS split
FROM lab JOIN quota USING (target)""",
    "review_majority_accuracy": f"""WITH {LABELLED},
maj AS (SELECT target FROM labelled WHERE split = 'train' GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)
SELECT split, count(*) AS rows, avg(CAST(target = (SELECT target FROM maj) AS DOUBLE)) AS accuracy,
       (SELECT target FROM maj) AS majority_label
FROM labelled GROUP BY split""",
    "document_tfidf": f"""WITH {TOKENS},
sd AS (SELECT *, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR) || '|{SENTIMENT_SEED}'), 1, 4) < '{_T}' THEN 'test' ELSE 'train' END AS split
       FROM doc_tokens),
ex AS (SELECT doc_id, split, unnest(list_filter(string_split_regex(content, '\\s+'), lambda x: length(x) >= 2)) AS term FROM sd),
tf AS (SELECT doc_id, split, term, count(*) AS tf FROM ex GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM sd WHERE split = 'train')) / (1.0 + count(*))) + 1.0 AS idf
        FROM tf WHERE split = 'train' GROUP BY term),
w AS (SELECT tf.*, tf.tf * idf.idf AS raw FROM tf JOIN idf USING (term))
SELECT doc_id, split, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
}
