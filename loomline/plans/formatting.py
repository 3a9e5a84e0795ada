"""Queries that apply the formatting functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import formatting as T
from loomline.sources.tables import table

_NOW = "2026-01-01 00:00:00"


def _episodes(spark: SparkSession, base: str) -> DataFrame:
    eps = table(spark, base, "episodes", ["id", "ep_number", "duration", "view_count", "bytes", "created_at"])
    now = F.lit(_NOW).cast("timestamp")
    return eps.select(
        "id",
        T.pad(F.col("ep_number")).alias("padded"),
        T.format_duration(F.col("duration")).alias("length"),
        T.format_count(F.col("view_count")).alias("views"),
        T.episode_label(F.col("ep_number")).alias("label"),
        T.time_ago(F.col("created_at"), now).alias("age"),
        T.format_date(F.col("created_at")).alias("day"),
        T.poster_hue(F.col("id")).alias("hue"),
    )


def _parsed(spark: SparkSession, base: str) -> DataFrame:
    """Timestamps written in both forms and read again."""
    made = table(spark, base, "series", ["id", "created_at"])
    plain, zoned = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return made.select("id", F.unix_seconds(T.parse_timestamp(plain)).alias("plain_s"), F.unix_seconds(T.parse_timestamp(zoned)).alias("zoned_s"), T.parse_timestamp(F.lit("soon")).isNull().alias("bad_is_null"))


def _genres(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "series", ["id", "title", "genre"])
    return s.select("id", T.normalize_list(F.col("genre"), "Anime").alias("genre"), F.size(T.split_list(F.col("genre"))).alias("n_parts"), T.valid_text(F.col("title"), 12).alias("short_title"))


def _counts(spark: SparkSession, base: str) -> DataFrame:
    """Counts and sizes over a dense range of values, exact halves among them."""
    n = table(spark, base, "lineitem", ["l_orderkey"]).select(F.col("l_orderkey").alias("n")).distinct()
    return n.select("n", T.format_count(F.col("n")).alias("as_count"), T.format_count(F.col("n") * 25).alias("as_more"))


def _bytes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "episodes", ["id", "bytes"]).select("id", T.format_bytes(F.col("bytes")).alias("size"))


QUERIES = {
    "G1_G2_G3_G4_G6_G7_G8_formats": _episodes,
    "G3_format_count": _counts,
    "G5_parse_timestamp": _parsed,
    "G9_C21_genres": _genres,
    "G10_format_bytes": _bytes,
}

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _fixed(value: str, digits: int) -> str:
    """Exact halves up; a half this short is exact in a double only for multiples of 1/1024."""
    s = 10**digits
    exact = f"({value} * {s} - floor({value} * {s}) = 0.5 AND {value} * 1024 = floor({value} * 1024))"
    return f"printf('%.{digits}f', CASE WHEN {exact} THEN (floor({value} * {s}) + 1) / {s} ELSE {value} END)"


def _count(v: str) -> str:
    v = f"CAST({v} AS DOUBLE)"
    return f"""CASE WHEN {v} < 1000 THEN CAST(CAST({v} AS BIGINT) AS VARCHAR)
  WHEN {v} < 10000 THEN regexp_replace({_fixed(f'({v} / 1000)', 1)}, '[.]0$', '') || 'K'
  WHEN {v} < 1000000 THEN {_fixed(f'({v} / 1000)', 0)} || 'K'
  ELSE regexp_replace({_fixed(f'({v} / 1000000)', 1)}, '[.]0$', '') || 'M' END"""


_AGE = " ".join(f"WHEN s >= {size} THEN CAST(CAST(floor(s / {size}) AS BIGINT) AS VARCHAR) || ' {name}' || CASE WHEN floor(s / {size}) = 1 THEN '' ELSE 's' END || ' ago'" for name, size in T.UNITS)

SQL = {
    "G1_G2_G3_G4_G6_G7_G8_formats": f"""
WITH e AS (SELECT *, greatest(0.0, epoch(TIMESTAMP '{_NOW}') - epoch(created_at AT TIME ZONE 'UTC')) AS s, CAST(floor(duration + 0.5) AS BIGINT) AS t FROM episodes)
SELECT id, printf('%02d', ep_number) AS padded,
  CASE WHEN duration IS NULL OR duration < 1 THEN '' WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, (t % 3600) // 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS length,
  {_count('view_count')} AS views,
  ep_number || CASE WHEN ep_number = 1 THEN ' episode' ELSE ' episodes' END AS label,
  CASE WHEN created_at IS NULL THEN NULL {_AGE} ELSE 'Just now' END AS age,
  strftime(created_at AT TIME ZONE 'UTC', '%b %-d, %Y') AS day,
  CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(id, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) % 360 AS INT) AS hue
FROM e""",
    "G3_format_count": f"SELECT n, {_count('n')} AS as_count, {_count('n * 25')} AS as_more FROM (SELECT DISTINCT l_orderkey AS n FROM lineitem)",
    "G5_parse_timestamp": "SELECT id, CAST(epoch(created_at AT TIME ZONE 'UTC') AS BIGINT) AS plain_s, CAST(epoch(created_at AT TIME ZONE 'UTC') AS BIGINT) AS zoned_s, true AS bad_is_null FROM (SELECT id, date_trunc('second', created_at) AS created_at FROM series)",
    "G9_C21_genres": f"""
WITH p AS (SELECT id, title, list_filter(list_transform(string_split(genre, ','), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS parts FROM series)
SELECT id, CASE WHEN len(parts) > 0 THEN array_to_string(list_transform(parts[1:6], lambda x: x[1:30]), ', ') ELSE 'Anime' END AS genre,
  len(parts) AS n_parts, CASE WHEN length({_STRIP.format('title')}) BETWEEN 1 AND 12 THEN {_STRIP.format('title')} END AS short_title FROM p""",
    "G10_format_bytes": f"SELECT id, CASE WHEN bytes >= 1073741824 THEN {_fixed('(bytes / 1073741824.0)', 2)} || ' GB' ELSE {_fixed('(bytes / 1048576.0)', 1)} || ' MB' END AS size FROM episodes",
}
