"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from . import line_runs, lpf_dedup, lsi_decontamination, oracle, phrase_automata, quality_lm, quality_rules, secret_scan, sentencepiece_bpe, simhash_dedup, spelling, token_counts, url_filter, whitening


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark, sf_dir):
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


# --- fixed values: the rules of the URL query
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# --- end of fixed values


def op2_url_filters(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).drop("score")


def op3_simhash_dedup(spark, sf_dir):
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, most=4).drop("key")


def op4_quality_classifier(spark, sf_dir):
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


def op5_suffix_dedup(spark, sf_dir):
    return lpf_dedup.dedup_bytes(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op6_decontamination(spark, sf_dir):
    found = lsi_decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "subsequence", "answer")


def op7_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.encoding_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_phrase_dedup(spark, sf_dir):
    return phrase_automata.dedup_phrases(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256.0)


def op12_spelling_variants(spark, sf_dir):
    return spelling.variant_groups(table(spark, sf_dir, "documents"), least_chars=6, least_count=5, ratio=5)


def op13_line_dedup(spark, sf_dir):
    kept = line_runs.drop_common_lines(table(spark, sf_dir, "documents"), least_docs=10, least_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = [op1_secret_scans, op2_url_filters, op3_simhash_dedup, op4_quality_classifier, op5_suffix_dedup,
           op6_decontamination, op7_quality_rules, op8_token_counts, op9_sentencepiece,
           op10_phrase_dedup, op11_embedding_whitening, op12_spelling_variants, op13_line_dedup]


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {**oracle.SQL, "op2_url_filters": oracle.urls(URL_RULES)}
