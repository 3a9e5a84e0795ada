"""Joins of points and intervals that never pair a whole group with itself.

Intervals are filed by the power of two above their length: at each level the buckets
are as wide as the longest interval of the level, so an interval lies in two buckets at
most, however long it is, and a point asks one bucket a level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.scan import key_text, last_marks


def stab(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, by: Sequence[str]) -> DataFrame:
    """Each point with each interval of its group that holds it: start <= at < end.

    Columns of both sides but ``by`` must differ. Points and intervals with nulls in ``by``,
    ``at``, ``start`` or ``end``, and empty intervals, are in no pair.
    """
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    level = F.greatest(F.ceil(F.log2(F.greatest(e - s, F.lit(1e-3)))), F.lit(-10)).cast("int")
    filed = intervals.where(s < e).withColumn("_level", level)
    width = F.pow(F.lit(2.0), F.col("_level"))
    filed = filed.withColumn("_bucket", F.explode(F.sequence(F.floor(s / width), F.floor(e / width))))
    levels = [r["_level"] for r in filed.select("_level").distinct().collect()]  # a few dozen at most
    asked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x).cast("int") for x in levels]) if levels else F.lit(None).cast("array<int>")))
    asked = asked.withColumn("_bucket", F.floor(F.col(at).cast("double") / F.pow(F.lit(2.0), F.col("_level"))))
    found = asked.join(filed, [*by, "_level", "_bucket"])
    return found.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_level", "_bucket")


def overlapping(a: DataFrame, a_start: str, a_end: str, b: DataFrame, b_start: str, b_end: str, by: Sequence[str]) -> DataFrame:
    """Each pair of intervals of a group that have more than a touching end in common.

    One of the two begins within the other; each pair is found once.
    """
    a = a.where(F.col(a_start) < F.col(a_end))
    b = b.where(F.col(b_start) < F.col(b_end))
    first = stab(b, b_start, a, a_start, a_end, by)  # b begins in a
    second = stab(a, a_start, b, b_start, b_end, by).where(F.col(a_start) > F.col(b_start))  # a begins in b, later
    return first.unionByName(second)


def nearest(points: DataFrame, at: str, marks: DataFrame, mark: str, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Each point with ``value`` of the nearest mark of its group as ``name``, and ``name``_distance.

    Of marks equally far the first by ``order`` is taken. Marks before and after a point are found by
    scans over both in order of time; points without a mark in their group, or a null time, get nulls.
    """
    key = F.struct(*[F.col(c) for c in order])
    one = marks.where(F.col(mark).isNotNull()).groupBy(*by, F.col(mark).cast("double").alias("_at")).agg(F.min(F.struct(key.alias("k"), value.alias("v"))).alias("_m"))
    one = one.select(*by, "_at", F.col("_m.k").alias("_k"), F.col("_m.v").alias("_v"))
    group = F.concat_ws("\x1f", *[key_text(F.col(c)) for c in by])
    timed = points.withColumn("_at", F.col(at).cast("double"))
    marked = one.withColumn("_g", group)
    both = timed.select(*by, "_at").where("_at IS NOT NULL").distinct().withColumn("_g", group).select("_g", "_at", F.lit(False).alias("_mark"))
    line = both.unionByName(marked.select("_g", "_at", F.lit(True).alias("_mark")))
    seen = last_marks(line, forwards=True, name="_before").join(last_marks(line, forwards=False, name="_after"), ["_g", "_at"])
    m = marked.select("_g", F.col("_at"), F.struct(F.col("_at").alias("at"), F.col("_k").alias("k"), F.col("_v").alias("v")).alias("_m"))
    left = m.select("_g", F.col("_at").alias("_before"), F.col("_m").alias("_b"))
    right = m.select("_g", F.col("_at").alias("_after"), F.col("_m").alias("_a"))
    found = timed.withColumn("_g", group).join(seen, ["_g", "_at"], "left").join(left, ["_g", "_before"], "left").join(right, ["_g", "_after"], "left")
    far = lambda x: F.abs(F.col(f"{x}.at") - F.col("_at"))
    earlier = F.col("_a").isNull() | (F.col("_b").isNotNull() & ((far("_b") < far("_a")) | ((far("_b") == far("_a")) & (F.col("_b.k") <= F.col("_a.k")))))
    best = F.when(earlier, F.col("_b")).otherwise(F.col("_a"))
    return found.select(*points.columns, best["v"].alias(name), F.abs(best["at"] - F.col("_at")).alias(f"{name}_distance"), best["k"].alias(f"{name}_order"))
