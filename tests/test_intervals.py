import random

from loomline.operators.intervals import periods_and_gaps
from loomline.operators.joins import nearest, overlapping, stab
from pyspark.sql import functions as F

SCHEMA = "media_id string, speaker_id string, a double, b double, kind string"


def brute(rows):
    groups = {}
    for m, s, a, b, _ in rows:
        if a is not None and b is not None and a == a and b == b and b > a:
            groups.setdefault((m, s), []).append((a, b))
    out = set()
    for (m, s), spans in groups.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(m, s, "period", a, b) for a, b in merged}
        out |= {(m, s, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def merged(spark, rows, n):
    df = spark.createDataFrame(rows, SCHEMA)  # a column named kind clashes with one of the result
    got = [tuple(r) for r in periods_and_gaps(df, ["media_id", "speaker_id"], "a", "b", n).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_hot_entity_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [("m", "s", t := rng.randrange(4000) / 4, t + rng.choice([0.25, 0.5, 3]), "x") for _ in range(900)]
    rows += [(rng.choice("pq"), rng.choice(["s", "t", None]), t := float(rng.randrange(100)), t + rng.random() * 3, None) for _ in range(200)]
    for n in (1, 3, 16):
        assert merged(spark, rows, n) == brute(rows)


def test_one_interval_holds_all_partitions(spark):
    rows = [("m", "s", 0.0, 1e6, "")] + [("m", "s", float(i), i + 0.5, "") for i in range(500)] + [("m", "s", 2e6, 3e6, "")]
    assert merged(spark, rows, 8) == {("m", "s", "period", 0.0, 1e6), ("m", "s", "gap", 1e6, 2e6), ("m", "s", "period", 2e6, 3e6)}


def test_nulls_nan_touching_repeated_and_empty(spark):
    nan = float("nan")
    rows = [(None, "s", 0.0, 1.0, ""), (None, "s", 1.0, 2.0, ""), ("m", "s", 0.0, 1.0, ""), ("m", "s", 0.0, 1.0, ""), ("m", "s", None, 1.0, ""), ("m", "s", 3.0, None, ""), ("m", "s", nan, 9.0, ""), ("m", "s", 5.0, nan, ""), ("m", "s", 7.0, 7.0, ""), ("m", "s", 9.0, 8.0, ""), ("-", "", 0.0, 1.0, "")]
    assert merged(spark, rows, 3) == {(None, "s", "period", 0.0, 2.0), ("m", "s", "period", 0.0, 1.0), ("-", "", "period", 0.0, 1.0)}
    assert merged(spark, [], 3) == set()


def test_stab_and_overlap_against_brute_force(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), i, t := rng.randrange(1000) / 8, t + rng.choice([0, 0.125, 1, 7, 300])) for i, _ in enumerate(range(120))]
    points = [(rng.choice("abc"), i, rng.randrange(2000) / 8) for i in range(150)]
    s = spark.createDataFrame(spans, "m string, i int, lo double, hi double")
    p = spark.createDataFrame(points, "m string, j int, t double")
    got = {(r["j"], r["i"]) for r in stab(p, "t", s, "lo", "hi", ["m"]).collect()}
    assert got == {(j, i) for m, j, t in points for n, i, lo, hi in spans if m == n and lo <= t < hi}
    o = s.selectExpr("m", "i as k", "lo as lo2", "hi as hi2")
    both = [(r["i"], r["k"]) for r in overlapping(s, "lo", "hi", o, "lo2", "hi2", ["m"]).collect()]
    assert len(both) == len(set(both))
    assert set(both) == {(x[1], y[1]) for x in spans for y in spans if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]}


def test_nearest_takes_the_first_of_equals(spark):
    marks = spark.createDataFrame([("a", 1.0, 5, "late"), ("a", 1.0, 2, "early"), ("a", 3.0, 1, "right"), ("b", None, 1, "none")], "m string, at double, o int, v string")
    points = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.0), ("a", 3, 9.0), ("a", 4, 1.0), ("b", 5, 1.0), ("c", 6, 1.0)], "m string, id int, t double")
    got = {r["id"]: (r["v"], r["v_distance"]) for r in nearest(points, "t", marks, "at", ["m"], ["o"], F.col("v"), "v").collect()}
    assert got == {1: ("right", 1.0), 2: ("early", 1.0), 3: ("right", 6.0), 4: ("early", 0.0), 5: (None, None), 6: (None, None)}
