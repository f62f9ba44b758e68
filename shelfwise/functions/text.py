"""Text clean-up for the sentiment model (X1, X2, X4, X6) as column expressions."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# English stop words (the standard NLTK English list, 179 entries, in its order).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]
# Negations the sentiment model keeps (removed from the stop list).
KEPT_NEGATIONS = ["not", "no", "nor"]
KEPT_CONTRACTIONS = [
    "don", "don't", "ain", "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn",
    "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "ma",
    "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]
NON_LETTER_RUN = "[^a-zA-Z]+"
WHITESPACE = r"\s+"
MIN_TERM_LENGTH = 2     # TF-IDF keeps terms of two or more word characters


def sentiment_stop_words() -> list[str]:
    kept = set(KEPT_NEGATIONS) | set(KEPT_CONTRACTIONS)
    return [w for w in ENGLISH_STOP_WORDS if w not in kept]


def as_text(c: Column) -> Column:
    """Text column as string; NULL -> '' (documented deviation from 'nan')."""
    return F.coalesce(c.cast("string"), F.lit(""))


def letter_tokens(text: Column) -> Column:
    """Non-letters -> space, lower-case, split on whitespace (no empty tokens).

    Runs of non-letters collapse into one separator and the edges are
    trimmed, so only an empty text yields an empty string, which
    ``array_remove`` drops: no per-token lambda (higher-order functions are
    evaluated without code generation) and the text is scanned once.
    """
    spaced = F.trim(F.lower(F.regexp_replace(as_text(text), NON_LETTER_RUN, " ")))
    return F.array_remove(F.split(spaced, " "), "")


def remove_stop_words(df: DataFrame, input_col: str, output_col: str,
                      stop_words: list[str] | None = None) -> DataFrame:
    """Drop stop words (negations kept) with MLlib's hash-set remover."""
    words = sentiment_stop_words() if stop_words is None else stop_words
    return StopWordsRemover(inputCol=input_col, outputCol=output_col, stopWords=words,
                            caseSensitive=True).transform(df)


def join_tokens(tokens: Column) -> Column:
    """Re-join with single spaces."""
    return F.array_join(tokens, " ")


def terms(content: Column) -> Column:
    """TF-IDF tokenisation of cleaned content (the length rule is applied after explode)."""
    return F.array_remove(F.split(content, " "), "")
