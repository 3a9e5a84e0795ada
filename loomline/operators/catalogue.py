"""Catalogue of series and episodes: listing, search, ranking, neighbours.

All functions are lazy and take DataFrames. ``series``: id, title, synopsis, genre (comma
list), cover_key, created_at; ``episodes``: id, series_id, ep_number, title, object_key,
content_type, bytes, thumb_key, duration, view_count, created_at. Rows with a null key
join nothing; extra columns of episodes are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.scan import with_next

SORTS = ("popular", "newest", "alphabetical")


def folded(text: Column) -> Column:
    """Text for ordering and comparing without regard to case."""
    return F.lower(text)


def genre_tokens(genre: Column) -> Column:
    """Lower-case tokens of a comma list, without outer blanks; null gives null."""
    return F.filter(F.transform(F.split(F.lower(genre), ","), lambda g: F.trim(g)), lambda g: g != "")


def has_genre(genre: Column, wanted: str) -> Column:
    """Whether a comma list has a token, whatever its case: 'Action' isn't in 'Reaction'."""
    return F.array_contains(genre_tokens(genre), F.lower(F.lit(wanted.strip())))


def escape_like(text: str) -> str:
    """A text as a LIKE pattern that means itself, with '!' as the escape sign."""
    return "".join("!" + c if c in "!%_" else c for c in text)


def mentions(columns: list[Column], text: str) -> Column:
    """Whether any of the columns holds a text, whatever its case; signs of patterns mean themselves."""
    pattern = F.lit(f"%{escape_like(text)}%")
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.ilike(c, pattern, F.lit("!")), F.lit(False))
    return found


def series_with_episodes(series: DataFrame, episodes: DataFrame) -> DataFrame:
    """Every series with episode_count, views, first_episode_id and latest_episode_at.

    Episodes are aggregated before the join, so the join moves one row a series. Series
    without episodes are kept with 0, 0, null and null; null views count as 0.
    """
    per = episodes.groupBy("series_id").agg(
        F.count("id").alias("episode_count"),
        F.coalesce(F.sum("view_count"), F.lit(0)).alias("views"),
        F.min_by("id", F.struct("ep_number", "id")).alias("first_episode_id"),
        F.max("created_at").alias("latest_episode_at"),
    )
    joined = series.join(per, series["id"] == per["series_id"], "left").drop("series_id")
    return joined.withColumns({"episode_count": F.coalesce("episode_count", F.lit(0)), "views": F.coalesce("views", F.lit(0))})


def order_of(sort: str) -> list[Column]:
    """Ordering of a listing, made total by the id."""
    title = [folded(F.col("title")).asc_nulls_last(), F.col("id").asc_nulls_last()]
    if sort == "popular":
        return [F.col("views").desc_nulls_last(), F.col("latest_episode_at").desc_nulls_last(), *title]
    if sort == "newest":
        return [F.coalesce("latest_episode_at", "created_at").desc_nulls_last(), *title]
    if sort == "alphabetical":
        return title
    raise ValueError(f"sort must be one of {', '.join(SORTS)}")


def list_series(series: DataFrame, episodes: DataFrame, sort: str = "newest", genre: str | None = None, query: str | None = None, limit: int | None = None) -> DataFrame:
    """Series in order, of a genre and with a text in title, synopsis or genre; no limit if it is 0 or None."""
    if genre:
        series = series.where(has_genre(F.col("genre"), genre))
    if query:
        series = series.where(mentions([F.col("title"), F.col("synopsis"), F.col("genre")], query))
    found = series_with_episodes(series, episodes).orderBy(*order_of(sort))
    return found.limit(int(limit)) if limit else found


def find_series(series: DataFrame, episodes: DataFrame, id: str) -> DataFrame:
    """One series with its aggregates; both scans are filtered by its id."""
    return series_with_episodes(series.where(F.col("id") == id), episodes.where(F.col("series_id") == id))


def list_episodes(episodes: DataFrame, series_id: str, descending: bool = False) -> DataFrame:
    """Episodes of a series by number."""
    number = F.col("ep_number")
    return episodes.where(F.col("series_id") == series_id).orderBy(number.desc_nulls_last() if descending else number.asc_nulls_last(), "id")


def list_latest_episodes(series: DataFrame, episodes: DataFrame, limit: int) -> DataFrame:
    """The newest episodes that have a series, with its title and cover."""
    about = series.select(F.col("id").alias("series_id"), F.col("title").alias("series_title"), F.col("cover_key").alias("series_cover_key"))
    order = [F.col("created_at").desc_nulls_last(), F.col("ep_number").desc_nulls_last(), F.col("id")]
    return episodes.join(about, "series_id").orderBy(*order).limit(limit)


def list_genres(series: DataFrame) -> DataFrame:
    """Distinct genres, compared without case, in the spelling of the oldest series that has them."""
    tokens = series.select("created_at", "id", F.posexplode(F.split("genre", ",")).alias("pos", "genre")).withColumn("genre", F.trim("genre")).where("genre <> ''")
    first = F.struct(F.coalesce("created_at", F.lit("9999-12-31").cast("timestamp")), "id", "pos")
    return tokens.groupBy(folded(F.col("genre")).alias("genre_key")).agg(F.min_by("genre", first).alias("genre")).orderBy("genre_key").select("genre")


def last_episode_numbers(episodes: DataFrame) -> DataFrame:
    """Largest number of each series that has episodes."""
    return episodes.groupBy("series_id").agg(F.max("ep_number").alias("last_number"))


def next_episode_numbers(series: DataFrame, episodes: DataFrame) -> DataFrame:
    """Number that the next episode of each series would get: 1 for a series without any."""
    last = last_episode_numbers(episodes)
    return series.select(F.col("id").alias("series_id")).join(last, "series_id", "left").select("series_id", (F.coalesce("last_number", F.lit(0)) + 1).alias("next_number"))


def related_series(series: DataFrame, episodes: DataFrame, limit: int = 20) -> DataFrame:
    """Of each series the most popular others with its first genre, at most ``limit``, ranked from 1.

    Only the ``limit + 1`` most popular series of a genre are kept before the join, so it
    makes a bounded number of rows a series.
    """
    every = series_with_episodes(series, episodes)
    first = every.select("id", F.get(genre_tokens(F.col("genre")), F.lit(0)).alias("genre_key")).where("genre_key IS NOT NULL")
    tokens = every.withColumn("genre_key", F.explode(F.array_distinct(genre_tokens(F.col("genre")))))
    w = Window.partitionBy("genre_key").orderBy(*order_of("popular"))
    top = tokens.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit + 1).select("genre_key", F.col("id").alias("related_id"), "place")
    pairs = first.join(top, "genre_key").where("related_id <> id")
    per = Window.partitionBy("id").orderBy("place")
    return pairs.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= limit).select("id", "related_id", "rank")


def featured_series(series: DataFrame, episodes: DataFrame) -> DataFrame:
    """The most popular series with episodes, one with a cover before those without."""
    covered = F.when(F.col("cover_key").isNotNull() & (F.col("cover_key") != ""), 0).otherwise(1)
    return series_with_episodes(series, episodes).where("episode_count > 0").orderBy(covered, *order_of("popular")).limit(1)


def with_neighbours(episodes: DataFrame) -> DataFrame:
    """Every episode with previous_id and next_id in its series by number, null at the ends."""
    after = with_next(episodes, "series_id", ["ep_number", "id"], "id", "next_id")
    before = after.where("next_id IS NOT NULL").select(F.col("next_id").alias("id"), F.col("id").alias("previous_id"))
    return after.join(before, "id", "left").select(*episodes.columns, "previous_id", "next_id")
