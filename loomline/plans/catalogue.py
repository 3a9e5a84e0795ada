"""Queries over the catalogue of series and episodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import catalogue as C
from loomline.sources.tables import table

_SERIES = ["id", "title", "synopsis", "genre", "cover_key", "created_at"]
_OUT = ["id", "title", "genre", "episode_count", "views", "first_episode_id", "latest_episode_at"]


def _series(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "series", _SERIES)


def _episodes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "episodes", ["id", "series_id", "ep_number", "title", "thumb_key", "duration", "view_count", "created_at"])


def _listed(**options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, base: C.list_series(_series(spark, base), _episodes(spark, base), **options).select(*_OUT)


def _neighbours(spark: SparkSession, base: str) -> DataFrame:
    return C.with_neighbours(_episodes(spark, base)).select("id", "series_id", "ep_number", "previous_id", "next_id")


def _missing(spark: SparkSession, base: str) -> DataFrame:
    """Numbers 1 to 3 of each series that no episode has: existence as an anti-join."""
    wanted = _series(spark, base).select(F.col("id").alias("series_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("ep_number"))
    return wanted.join(_episodes(spark, base).select("series_id", "ep_number"), ["series_id", "ep_number"], "left_anti")


def _lookup(spark: SparkSession, base: str) -> DataFrame:
    """The episode that the most viewed one is followed by, by its key."""
    eps = _episodes(spark, base)
    keys = C.with_neighbours(eps).orderBy(F.col("view_count").desc_nulls_last(), "id").limit(1).select(F.col("next_id").alias("id"))
    return eps.join(keys, "id", "left_semi").select("id", "series_id", "ep_number", "title")


def _first_series(spark: SparkSession, base: str) -> str:
    """Key of the series with the most episodes."""
    top = _episodes(spark, base).groupBy("series_id").count().orderBy(F.desc("count"), "series_id").first()
    return top["series_id"] if top else ""


def _special_signs(spark: SparkSession, base: str) -> DataFrame:
    """A search for signs that patterns treat as wild, in titles of which a third hold them."""
    signed = F.when(F.length("title") % 3 == 0, F.concat("title", F.lit(" 50%_off!"))).otherwise(F.col("title"))
    series = _series(spark, base).withColumn("title", signed)
    return C.list_series(series, _episodes(spark, base), sort="alphabetical", query="0%_OFF!").select(*_OUT)


QUERIES = {
    "A1_A2_A7_A10_popular_series": _listed(sort="popular", limit=20),
    "A1_A2_series_aggregates": lambda s, b: C.series_with_episodes(_series(s, b), _episodes(s, b)).select(*_OUT),
    "A3_A4_A5_A6_search": _listed(sort="newest", genre="drama", query="the"),
    "A5_A6_search_special_signs": _special_signs,
    "A4_genre": _listed(sort="newest", genre="ACTION"),
    "A8_newest_series": _listed(sort="newest", limit=20),
    "A9_alphabetical_series": _listed(sort="alphabetical"),
    "A11_find_series": lambda s, b: C.find_series(_series(s, b), _episodes(s, b), _first_series(s, b)).select(*_OUT),
    "A12_list_episodes": lambda s, b: C.list_episodes(_episodes(s, b), _first_series(s, b)).select("id", "ep_number", "title"),
    "A13_latest_episodes": lambda s, b: C.list_latest_episodes(_series(s, b), _episodes(s, b), 20).select("id", "ep_number", "created_at", "series_title", "series_cover_key"),
    "A14_genres": lambda s, b: C.list_genres(_series(s, b)),
    "A15_last_numbers": lambda s, b: C.last_episode_numbers(_episodes(s, b)),
    "A16_episode_by_key": _lookup,
    "A17_missing_numbers": _missing,
    "A18_related_series": lambda s, b: C.related_series(_series(s, b), _episodes(s, b)),
    "A19_featured_series": lambda s, b: C.featured_series(_series(s, b), _episodes(s, b)).select("id", "title", "views"),
    "A20_neighbours": _neighbours,
    "A21_episodes_descending": lambda s, b: C.list_episodes(_episodes(s, b), _first_series(s, b), descending=True).select("id", "ep_number", "title"),
    "A22_top_12": _listed(sort="popular", limit=12),
    "A23_next_numbers": lambda s, b: C.next_episode_numbers(_series(s, b), _episodes(s, b)),
}

_AGG = """
WITH e AS (SELECT series_id, count(id) AS episode_count, coalesce(sum(view_count), 0) AS views,
                  max(created_at) AT TIME ZONE 'UTC' AS latest_episode_at
           FROM episodes GROUP BY series_id),
f AS (SELECT series_id, id AS first_episode_id FROM (SELECT series_id, id, row_number() OVER (PARTITION BY series_id ORDER BY ep_number, id) AS rn FROM episodes) WHERE rn = 1),
a AS (SELECT s.id, s.title, s.synopsis, s.genre, s.cover_key, s.created_at AT TIME ZONE 'UTC' AS created_at, coalesce(e.episode_count, 0) AS episode_count,
             CAST(coalesce(e.views, 0) AS BIGINT) AS views, f.first_episode_id, e.latest_episode_at
      FROM series s LEFT JOIN e ON e.series_id = s.id LEFT JOIN f ON f.series_id = s.id)
"""
_COLS = "id, title, genre, episode_count, views, first_episode_id, latest_episode_at"
_POPULAR = "views DESC NULLS LAST, latest_episode_at DESC NULLS LAST, lower(title) ASC NULLS LAST, id"
_NEWEST = "coalesce(latest_episode_at, created_at) DESC NULLS LAST, lower(title) ASC NULLS LAST, id"
_BUSIEST = "(SELECT series_id FROM episodes GROUP BY 1 ORDER BY count(*) DESC, series_id LIMIT 1)"
_TOKEN = "list_contains(list_transform(string_split(lower(genre), ','), lambda x: trim(x)), '{0}')"
_FOUND = "(coalesce(title ILIKE '{0}' ESCAPE '!', false) OR coalesce(synopsis ILIKE '{0}' ESCAPE '!', false) OR coalesce(genre ILIKE '{0}' ESCAPE '!', false))"

SQL = {
    "A1_A2_A7_A10_popular_series": f"{_AGG} SELECT {_COLS} FROM a ORDER BY {_POPULAR} LIMIT 20",
    "A1_A2_series_aggregates": f"{_AGG} SELECT {_COLS} FROM a",
    "A3_A4_A5_A6_search": f"{_AGG} SELECT {_COLS} FROM a WHERE {_TOKEN.format('drama')} AND {_FOUND.format('%the%')}",
    "A5_A6_search_special_signs": f"{_AGG.replace('FROM series s', 'FROM (SELECT * REPLACE (CASE WHEN length(title) % 3 = 0 THEN title || chr(32) || chr(53) || chr(48) || chr(37) || chr(95) || $$off!$$ ELSE title END AS title) FROM series) s')} SELECT {_COLS} FROM a WHERE {_FOUND.format('%0!%!_OFF!!%')}",
    "A4_genre": f"{_AGG} SELECT {_COLS} FROM a WHERE {_TOKEN.format('action')}",
    "A8_newest_series": f"{_AGG} SELECT {_COLS} FROM a ORDER BY {_NEWEST} LIMIT 20",
    "A9_alphabetical_series": f"{_AGG} SELECT {_COLS} FROM a",
    "A11_find_series": f"{_AGG} SELECT {_COLS} FROM a WHERE id = {_BUSIEST}",
    "A12_list_episodes": f"SELECT id, ep_number, title FROM episodes WHERE series_id = {_BUSIEST}",
    "A13_latest_episodes": "SELECT e.id, e.ep_number, e.created_at AT TIME ZONE 'UTC' AS created_at, s.title AS series_title, s.cover_key AS series_cover_key FROM episodes e JOIN series s ON s.id = e.series_id ORDER BY e.created_at DESC NULLS LAST, e.ep_number DESC NULLS LAST, e.id LIMIT 20",
    "A14_genres": """
WITH t AS (SELECT created_at, id, unnest(string_split(genre, ',')) AS g, generate_subscripts(string_split(genre, ','), 1) AS pos FROM series)
SELECT genre FROM (SELECT trim(g) AS genre, row_number() OVER (PARTITION BY lower(trim(g)) ORDER BY created_at NULLS LAST, id, pos) AS rn FROM t WHERE trim(g) <> '') WHERE rn = 1""",
    "A15_last_numbers": "SELECT series_id, max(ep_number) AS last_number FROM episodes GROUP BY series_id",
    "A16_episode_by_key": """
WITH n AS (SELECT *, lead(id) OVER (PARTITION BY series_id ORDER BY ep_number, id) AS next_id FROM episodes)
SELECT id, series_id, ep_number, title FROM episodes WHERE id = (SELECT next_id FROM n ORDER BY view_count DESC NULLS LAST, id LIMIT 1)""",
    "A17_missing_numbers": "SELECT s.id AS series_id, CAST(k.k AS INT) AS ep_number FROM series s, (VALUES (1), (2), (3)) k(k) WHERE NOT EXISTS (SELECT 1 FROM episodes e WHERE e.series_id = s.id AND e.ep_number = k.k)",
    "A18_related_series": f"""{_AGG},
t AS (SELECT *, list_filter(list_transform(string_split(lower(genre), ','), lambda x: trim(x)), lambda x: x <> '') AS tokens FROM a),
g AS (SELECT DISTINCT id, unnest(tokens) AS genre_key FROM t),
p AS (SELECT g.genre_key, a.id AS related_id, row_number() OVER (PARTITION BY g.genre_key ORDER BY a.views DESC NULLS LAST, a.latest_episode_at DESC NULLS LAST, lower(a.title) ASC NULLS LAST, a.id) AS place FROM g JOIN a USING (id))
SELECT id, related_id, CAST(rank AS INT) AS rank FROM (
  SELECT t.id, p.related_id, row_number() OVER (PARTITION BY t.id ORDER BY p.place) AS rank
  FROM t JOIN p ON p.genre_key = t.tokens[1] WHERE p.related_id <> t.id) WHERE rank <= 20""",
    "A19_featured_series": f"{_AGG} SELECT id, title, views FROM a WHERE episode_count > 0 ORDER BY CASE WHEN cover_key IS NOT NULL AND cover_key <> '' THEN 0 ELSE 1 END, {_POPULAR} LIMIT 1",
    "A20_neighbours": "SELECT id, series_id, ep_number, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM episodes WINDOW w AS (PARTITION BY series_id ORDER BY ep_number, id)",
    "A21_episodes_descending": f"SELECT id, ep_number, title FROM episodes WHERE series_id = {_BUSIEST}",
    "A22_top_12": f"{_AGG} SELECT {_COLS} FROM a ORDER BY {_POPULAR} LIMIT 12",
    "A23_next_numbers": "SELECT s.id AS series_id, coalesce(max(e.ep_number), 0) + 1 AS next_number FROM series s LEFT JOIN episodes e ON e.series_id = s.id GROUP BY s.id",
}
