"""Queries over embeddings. The query set is every row whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import vectors as V
from loomline.sources.tables import table

_CLOSE = 0.3


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings", ["vec_id", "embedding", "label"])


def _queries(spark: SparkSession, base: str) -> DataFrame:
    return _vectors(spark, base).where(F.col("vec_id") % 100 == 0)


def _similar(spark: SparkSession, base: str) -> DataFrame:
    """Cosines of the query set and all rows by plain expressions, as histogram."""
    q = _queries(spark, base).select(F.col("vec_id").alias("q"), F.col("embedding").alias("a"))
    near = V.nearest_entries(_queries(spark, base), _vectors(spark, base), "vec_id", "embedding", k=3)
    pairs = near.join(q, near["query_id"] == q["q"]).join(_vectors(spark, base).select(F.col("vec_id").alias("e"), F.col("embedding").alias("b")), F.col("entry_id") == F.col("e"))
    return pairs.select("query_id", "entry_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


def _nearest(spark: SparkSession, base: str) -> DataFrame:
    near = V.nearest_entries(_queries(spark, base), _vectors(spark, base), "vec_id", "embedding", k=1, at_least=_CLOSE)
    return near.select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"))


def _bank(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("voice_id"), F.concat(F.lit("take "), F.col("vec_id").cast("string")).alias("text"), (F.col("vec_id") * 37 % 101 / 100).alias("score"))


def _merged(spark: SparkSession, base: str) -> DataFrame:
    """All rows meet the bank of the query set; better takes replace those in the bank."""
    every, bank = _vectors(spark, base), _queries(spark, base)
    matches = V.nearest_entries(every, bank, "vec_id", "embedding", k=1)
    return V.merged_bank(_bank(bank), _bank(every), matches, _CLOSE)


def _claimed(spark: SparkSession, base: str) -> DataFrame:
    """Twelve rows are a run; they claim entries of the query set."""
    every, bank = _vectors(spark, base), _queries(spark, base)
    matches = V.nearest_entries(every, bank, "vec_id", "embedding", k=13, at_least=0.1, same=True)
    runs = every.withColumn("run", F.floor(F.col("vec_id") / 12))
    return V.claimed(runs, matches, "run", "vec_id")


def _allotted(spark: SparkSession, base: str) -> DataFrame:
    """Ids for the rows that find no entry similar enough."""
    every, bank = _vectors(spark, base), _queries(spark, base)
    near = V.nearest_entries(every, bank, "vec_id", "embedding", k=1, at_least=_CLOSE, same=True)
    new = every.select("vec_id").join(near.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    names = bank.select(F.concat(F.lit("speaker_"), F.lpad((F.col("vec_id") / 100 + 1).cast("int").cast("string"), 3, "0")).alias("voice_id"))
    return V.allotted(new, ["vec_id"], F.col("voice_id"), names)


def _clusters(spark: SparkSession, base: str) -> DataFrame:
    return V.clustered(_vectors(spark, base), "label", "vec_id", "embedding", distance=0.9)


QUERIES = {
    "E1_cosine": _similar,
    "E2_nearest": _nearest,
    "E3_merged_bank": _merged,
    "E4_claimed": _claimed,
    "E5_allotted": _allotted,
    "E6_E7_clusters": _clusters,
}

_V = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0)"""
_SIM = "list_dot_product({0}.e, {1}.e) / (sqrt(list_dot_product({0}.e, {0}.e)) * sqrt(list_dot_product({1}.e, {1}.e)))"
_TOP = _V + ", p AS (SELECT a.vec_id AS query_id, b.vec_id AS entry_id, " + _SIM.format("a", "b") + " AS s FROM {0} a JOIN {1} b ON {2}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, entry_id) AS rn FROM p)"

SQL = {
    "E1_cosine": _TOP.format("q", "v", "a.vec_id <> b.vec_id") + " SELECT query_id, entry_id, round(s, 6) AS cosine FROM r WHERE rn <= 3",
    "E2_nearest": _TOP.format("q", "v", "a.vec_id <> b.vec_id") + f" SELECT query_id, entry_id, round(s, 6) AS similarity FROM r WHERE rn = 1 AND s >= {_CLOSE}",
    "E3_merged_bank": _TOP.format("v", "q", "a.vec_id <> b.vec_id") + f""",
m AS (SELECT entry_id, query_id, query_id * 37 % 101 / 100 AS ns, row_number() OVER (PARTITION BY entry_id ORDER BY query_id * 37 % 101 / 100 DESC, query_id) AS k FROM r WHERE rn = 1 AND s >= {_CLOSE}),
j AS (SELECT vec_id AS voice_id, vec_id * 37 % 101 / 100 AS score, query_id, ns FROM q LEFT JOIN m ON m.entry_id = q.vec_id AND k = 1)
SELECT voice_id, 'take ' || CASE WHEN ns > score THEN query_id ELSE voice_id END AS text, CASE WHEN ns > score THEN ns ELSE score END AS score, CASE WHEN ns > score THEN query_id END AS replaced_by FROM j""",
    "E5_allotted": _TOP.format("v", "q", "true") + f""", n AS (SELECT vec_id FROM v WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = v.vec_id AND rn = 1 AND s >= {_CLOSE}))
SELECT vec_id, 'speaker_' || printf('%03d', row_number() OVER (ORDER BY vec_id) + (SELECT max(vec_id // 100 + 1) FROM q)) AS voice_id FROM n""",
}
# a run's candidates in order, each with the entries that those before it took
SQL["E4_claimed"] = _TOP.format("v", "q", "true").replace("WITH v", "WITH RECURSIVE v") + """,
k AS (SELECT vec_id AS id, vec_id // 12 AS run, row_number() OVER (PARTITION BY vec_id // 12 ORDER BY vec_id) AS pos FROM v),
c AS (SELECT query_id, entry_id, rn FROM r WHERE rn <= 13 AND s >= 0.1),
f AS (
  SELECT DISTINCT run, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS entry_id FROM k
  UNION ALL
  SELECT run, n + 1, CASE WHEN e IS NULL THEN taken ELSE list_append(taken, e) END, id, e FROM (
    SELECT f.run, f.n, f.taken, k.id, arg_min(c.entry_id, c.rn) FILTER (NOT list_contains(f.taken, c.entry_id)) AS e
    FROM f JOIN k ON k.run = f.run AND k.pos = f.n + 1 LEFT JOIN c ON c.query_id = k.id GROUP BY f.run, f.n, f.taken, k.id))
SELECT run, id, entry_id FROM f WHERE n > 0"""
