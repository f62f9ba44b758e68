"""Exact split sizes, exact Kolmogorov-Smirnov p-values, malformed lines."""

import hashlib
import itertools
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import quality as Q
from shelfwise.operators.drift import exact_p_value, ks_two_sample
from shelfwise.operators.split import exact_split, quotas
from shelfwise.plans import daily as DJ
from shelfwise.sources import readers


def test_quotas_add_up():
    assert quotas({"a": 10, "b": 10, "c": 11}, 0.2) == {"a": 2, "b": 2, "c": 3}
    assert quotas({1: 1, 0: 1, None: 1}, 0.5) == {0: 1, 1: 1, None: 0}
    assert quotas({}, 0.2) == {}
    for n, k in itertools.product(range(1, 30), range(1, 9)):
        counts = {c: n + c for c in range(k)}
        got = quotas(counts, 0.2)
        assert sum(got.values()) == math.ceil(sum(counts.values()) / 5 - 1e-9)
        assert all(abs(got[c] - sum(got.values()) * counts[c] / sum(counts.values())) < 1 for c in counts)


@pytest.mark.parametrize("n,share", [(1, 0.2), (7, 0.2), (1000, 0.2), (1000, 0.0), (1000, 1.0), (503, 0.37)])
def test_exact_split_takes_the_smallest_hashes(spark, n, share):
    df = spark.range(n).withColumn("k", F.concat(F.lit("key"), "id"))
    got = {r["k"] for r in exact_split(df, "k", share, 7).where("split = 'test'").collect()}
    keys = sorted((f"key{i}" for i in range(n)), key=lambda k: hashlib.md5(f"{k}|7".encode()).hexdigest())
    assert got == set(keys[:math.ceil(round(share * n, 9))])


def test_exact_stratified_split(spark):
    rows = [(i, (None, 0, 0, 0, 1, 1, 5)[i % 7]) for i in range(933)]
    df = spark.createDataFrame(rows, "id long, target int")
    for parts in (1, 6):
        out = exact_split(df.repartition(parts), "id", 0.2, 2, "target").collect()
        sizes = Counter(r["target"] for r in out if r["split"] == "test")
        assert dict(sizes) == quotas(dict(Counter(t for _, t in rows)), 0.2) and len(out) == 933
        for c in sizes:
            ids = sorted((i for i, t in rows if t == c), key=lambda i: hashlib.md5(f"{'' if c is None else c}|{i}|2".encode()).hexdigest())
            assert {r["id"] for r in out if r["target"] == c and r["split"] == "test"} == set(ids[:sizes[c]])


def test_exact_split_of_awkward_tables(spark):
    assert exact_split(spark.range(0), "id").collect() == [] and exact_split(spark.createDataFrame([], "id long, y int"), "id", label="y").collect() == []
    same = spark.createDataFrame([(1,)] * 10 + [(None,)] * 10, "id long")        # rows of one key stay together
    assert {(r["id"], r["split"]) for r in exact_split(same, "id", 0.5).collect()} in ({(1, "test"), (None, "train")}, {(1, "train"), (None, "test")})


def brute_p(gap, n1, n2):
    hit = 0
    for firsts in itertools.combinations(range(n1 + n2), n1):
        chosen, i, most = set(firsts), 0, 0
        for k in range(n1 + n2):
            i += k in chosen
            most = max(most, abs(i * n2 - (k + 1 - i) * n1))
        hit += most >= gap
    return hit / math.comb(n1 + n2, n1)


def test_exact_p_values_are_those_of_all_orders(spark):
    for n1, n2 in ((1, 1), (3, 4), (5, 5), (2, 7), (6, 4)):
        for gap in range(0, n1 * n2 + 2):
            assert exact_p_value(gap, n1, n2) == pytest.approx(brute_p(gap, n1, n2), abs=1e-12)
    assert 0 < exact_p_value(200 * 300, 200, 300) < 1e-100                      # small ones keep their digits
    a, b = [1.0, 2.0, 2.0, 3.5, 9.0], [2.0, 4.0, 5.0, 6.0]
    df = spark.createDataFrame([(v, "train") for v in a] + [(v, "val") for v in b] + [(None, "val")], "y double, split string")
    r = ks_two_sample(df, "y", "split", "train", "val", 10).first()
    assert r["statistic"] == pytest.approx(0.55) and r["p_value"] == pytest.approx(brute_p(11, 5, 4)) and (r["n1"], r["n2"]) == (5, 4)
    assert ks_two_sample(df, "y", "split", "train", "val").first()["p_value"] != r["p_value"]      # asymptotic when not asked for


HEADER = ",".join(Q.DAILY_COLUMNS)


def daily_file(path, bad, n=600):
    lines = [HEADER]
    for k in range(n):
        day = f"2024-{1 + k // 28 % 12:02d}-{1 + k % 28:02d}"
        lines.append(f'{day},P{k // 336},"{k % 9}",10.5,{k % 2},{k % 5},{k // 336}')
    for k in range(bad):
        lines.append("2024-01-01,P0,1,2.0" if k % 2 else "2024-01-01,P0,1,2.0,0,1,0,more,fields")
    os.makedirs(path)
    with open(f"{path}/a.csv", "w") as f:
        f.write("\n".join(lines) + "\n")


def test_malformed_lines_are_counted_and_set_aside(spark, tmp_dir):
    daily_file(f"{tmp_dir}/in", 4)
    raw = readers.read_daily_raw(spark, f"{tmp_dir}/in")
    cleaned, info = DJ.prepare_fact(raw)
    assert info["gates"]["rows"] == cleaned.count() == 600 and info["gates"]["corrupt_rows"] == 4 and info["gates"]["status"] == "PASS"
    lines = sorted((r["problem"], r["line"]) for r in info["quarantine"].collect())
    assert lines == [("too_few", "2024-01-01,P0,1,2.0")] * 2 + [("too_many", "2024-01-01,P0,1,2.0,0,1,0,more,fields")] * 2
    summ = DJ.run(spark, raw, f"{tmp_dir}/run", DJ.DailyConfig(max_iter=2, max_depth=2))
    assert summ["status"] == "PASS" and spark.read.parquet(f"{tmp_dir}/run/quarantine").count() == 4
    assert summ["best_iteration"] <= summ["rounds_fitted"] <= 2 and len(summ["gains"]) == 4
    assert spark.read.json(f"{tmp_dir}/run/history").count() == summ["rounds_fitted"] + 1
    _, contract = DJ.load_model(spark, f"{tmp_dir}/run")
    assert contract.names == DJ.FEATURES


def test_too_many_malformed_lines_fail_the_gate(spark, tmp_dir):
    daily_file(f"{tmp_dir}/in", 30)
    with pytest.raises(Q.ValidationError, match="corrupt_rows"):
        DJ.prepare_fact(readers.read_daily_raw(spark, f"{tmp_dir}/in"))


def test_files_without_texts_are_split(spark, tmp_dir):
    """One file of a few MB is read by several tasks: it is not one multi-line document."""
    daily_file(f"{tmp_dir}/in", 0, n=60_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        assert readers.read_daily_raw(spark, f"{tmp_dir}/in").rdd.getNumPartitions() > 2
        assert readers.read_products_csv(spark, f"{tmp_dir}/in").rdd.getNumPartitions() > 2
        assert readers.read_text_csv(spark, f"{tmp_dir}/in", "date").rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
