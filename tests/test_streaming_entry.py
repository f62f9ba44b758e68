"""Streaming reuse of the stateless transforms, and the driver contract with its SQL oracles."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from shelfwise.operators import quality as Q
from shelfwise.sources.adapters import daily_raw
from shelfwise.sources.readers import DAILY_RAW_SCHEMA
from shelfwise.sources.tables import TABLES
from shelfwise.streaming.scoring import start, stream_source

SF_SMALL = "/root/testdata/sf0.001"


def test_stream_cleaning_equals_batch(spark, tmp_dir):
    raw = daily_raw(spark, SF_SMALL)
    raw.repartition(3).write.parquet(f"{tmp_dir}/in")
    src = stream_source(spark, f"{tmp_dir}/in", DAILY_RAW_SCHEMA, max_files_per_trigger=1)
    q = start(src, lambda d: Q.cleaned_daily(Q.parse_daily(d)), f"{tmp_dir}/out", "clean_test",
              checkpoint=f"{tmp_dir}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_dir}/out")
    want = Q.cleaned_daily(Q.parse_daily(raw))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and {r["split"] for r in rows} == {"train", "val", "test"}
    assert all(r["chronological"] for r in rows)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_sql_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    cols = sorted(sdf.columns)
    s_rows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in sdf.collect())
    idx = [rel.columns.index(c) for c in cols]
    d_rows = sorted(repr(tuple(_norm(r[i]) for i in idx)) for r in rel.fetchall())
    assert s_rows == d_rows


def test_stream_price_scoring_equals_batch(spark, tmp_dir):
    from shelfwise.catalog import products as PR
    from shelfwise.plans.pricing import PriceConfig, PriceUnitsModel
    model = PriceUnitsModel.fit(PR.products_train(spark, SF_SMALL), PR.LUXURY_TESTDATA,
                                PriceConfig(price_trees=3, price_depth=3, units_trees=3, units_depth=3))
    req = PR.batch_request(spark, SF_SMALL)
    req.repartition(2).write.parquet(f"{tmp_dir}/req")
    src = stream_source(spark, f"{tmp_dir}/req", req.schema, max_files_per_trigger=1)
    q = start(src, model.predict_batch, f"{tmp_dir}/scored", "price_stream_test", checkpoint=f"{tmp_dir}/ck2")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_dir}/scored")
    want = model.predict_batch(req)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
