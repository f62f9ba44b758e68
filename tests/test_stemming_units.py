"""Stemming by vocabulary in units of rows: what is shuffled, and rows of one key."""

from pyspark.sql import functions as F

from shelfwise.functions import text as X
from shelfwise.functions.porter import stem_text
from shelfwise.operators import stemming as ST


def test_units_give_the_texts_of_the_stemmer(spark, monkeypatch):
    monkeypatch.setattr(ST, "UNIT", 3)
    rows = [(k, ["running"] * (k % 4) + ["cats", f"word{k % 5}s"] if k % 6 else []) for k in range(20)] + [(100, None)]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    got = {r["id"]: r["content"] for r in ST.stemmed_content(docs, "id", "tokens").collect()}
    whole = docs.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    assert got == {r["id"]: r["content"] for r in whole.select("id", stem_text(X.join_tokens(F.col("tokens"))).alias("content")).collect()}
    assert got[100] == "" and got[3] == "run run run cat word3"


def test_a_token_is_a_row_for_each_unit_however_often_it_stands_there(spark):
    """before, every occurrence of a token was joined."""
    docs = spark.createDataFrame([(k, ["the"] * 300 + [f"w{k}"]) for k in range(40)], "id long, tokens array<string>").coalesce(1)
    table = ST.coded(docs, "id", "tokens")
    assert table.where("words is not null").select(F.sum(F.size("words"))).first()[0] == 41
    assert table.where("words is null").select(F.sum(F.size("codes"))).first()[0] == 40 * 301


def test_rows_of_one_key_and_null_keys(spark):
    docs = spark.createDataFrame([(1, ["b", "cats"]), (1, ["a"]), (1, []), (2, ["dogs", None, "x"]), (None, ["z"]), (3, []), (3, None)], "id long, tokens array<string>")
    got = sorted(((r["id"], r["content"]) for r in ST.stemmed_content(docs, "id", "tokens").collect()), key=str)
    assert got == sorted([(1, "a b cat")] * 3 + [(2, "dog x"), (3, ""), (3, ""), (None, "")], key=str)
