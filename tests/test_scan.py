"""Scans against plain loops, with groups that lie over many partitions."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomline.operators.scan import carried, counted, medians, numbered, queued, runs, summed, with_next
from loomline.session import clear, shared_dir, stored

SCHEMA = "g string, k int, v string, d boolean, want long, n long, extra array<struct<a:int>>, run string"


@pytest.fixture()
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def made(seed):
    rng = random.Random(seed)
    groups = ["hot"] * 12 + ["a", "b", None]
    return [(rng.choice(groups), k, rng.choice(["x", "x", "x", "y", None]), rng.choice([True, False, False, None]), rng.randrange(20_000), rng.randrange(1, 60), [(k,)], "clash") for k in range(600)]


def by_group(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("seed", [1, 2])
def test_runs(spark, many_partitions, seed):
    rows, want = made(seed), {}
    for group in by_group(rows).values():
        number, before = 0, None
        for r in group:
            if before is None or before[2] != r[2] or before[3]:
                number += 1
            want[r[1]], before = number, r
    df = spark.createDataFrame(rows, SCHEMA)
    got = runs(df, "g", ["k"], F.col("v"), F.col("d"), "number").collect()
    assert {r["k"]: r["number"] for r in got} == want and all(r["extra"][0]["a"] == r["k"] for r in got)


@pytest.mark.parametrize("seed", [3, 4])
def test_queued(spark, many_partitions, seed):
    rows, want = made(seed), {}
    for group in by_group(rows).values():
        end = None
        for r in group:
            want[r[1]] = r[4] if end is None else max(r[4], end)
            end = want[r[1]] + r[5]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["k"]: r["at"] for r in queued(df, "g", ["k"], F.col("want"), F.col("n"), "at").collect()} == want


@pytest.mark.parametrize("value", ["want", "v"])
def test_with_next(spark, many_partitions, value):
    rows, want = made(5), {}
    at = SCHEMA.split(", ").index(next(c for c in SCHEMA.split(", ") if c.startswith(f"{value} ")))
    for group in by_group(rows).values():
        for r, s in zip(group, [*group[1:], None]):
            want[r[1]] = s[at] if s else None
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["k"]: r["following"] for r in with_next(df, "g", ["k"], value, "following").collect()} == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert runs(df, "g", ["k"], F.col("v")).count() == queued(df, "g", ["k"], F.col("want"), F.col("n"), "at").count() == with_next(df, "g", ["k"], "want", "f").count() == numbered(df, ["k"], "i").count() == 0


def test_last_partition_is_told(spark):
    df = spark.range(100)

    def label(batches, state, last):
        rows = [pdf for pdf in batches]
        yield rows[0].iloc[:1].assign(last=last)

    got = carried(df, ["id"], lambda b: sum(map(len, b)) or None, lambda s, n: (s or 0) + n, label, "id long, last boolean", 5).orderBy("id").collect()
    assert [r["last"] for r in got] == [False] * (len(got) - 1) + [True]


def test_stored_tables_are_in_the_shared_folder_and_can_be_cleared(spark):
    df = stored(spark.range(5))
    assert df.count() == 5 and shared_dir(spark).removeprefix("file://") in df.inputFiles()[0]
    folder = os.path.join(shared_dir(spark), "tables", spark.sparkContext.applicationId).removeprefix("file://")
    assert os.listdir(folder)
    clear(spark)
    assert not os.path.exists(folder)


def test_running_sums_cross_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, rng.choice([0, 3, -2, 7, None])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["g"], r["i"]): r["total"] for r in summed(df, "g", ["i"], F.col("v"), "total").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, total = {}, {}
    for g, i, v in rows:
        total[g] = total.get(g, 0) + (v or 0)
        want[g, i] = total[g]
    assert got == want and summed(df.limit(0), "g", ["i"], F.col("v"), "total").count() == 0


def test_places_and_medians_of_a_hot_group(spark, many_partitions):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "hot", "hot", "hot", "hot"]), i, rng.choice([None, 1.0, 2.5, 7.0, rng.random()])) for i in range(900)] + [("one", 900, 3.0), ("none", 901, None)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    places, want = {}, {}
    for g, i, _ in rows:
        want[i] = places[g] = places.get(g, 4) + 1
    assert {r["i"]: r["n"] for r in counted(df, "g", ["i"], "n", first=5).collect()} == want
    got = {r["g"]: (r["m"], r["n"]) for r in medians(df, ["g"], "v", "m").collect()}
    for g in (None, "a", "hot", "one"):
        values = [v for k, _, v in rows if k == g and v is not None]
        assert got[g] == (pytest.approx(statistics.median(values)), len(values))
    assert "none" not in got and medians(df.limit(0), ["g"], "v", "m").count() == 0
