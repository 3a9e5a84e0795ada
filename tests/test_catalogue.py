from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomline.functions import formatting as G
from loomline.operators import catalogue as C

D = datetime(2025, 1, 1)
S = "id string, title string, synopsis string, genre string, cover_key string, created_at timestamp"
E = "id string, series_id string, ep_number int, title string, thumb_key string, duration int, view_count int, created_at timestamp"


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([
        ("a", "beta", "", "Action, Drama", "c", D), ("b", "Alpha", "100% true_story!", "Reaction", None, D), ("c", "gamma", None, " action ,x", "", D), ("d", None, "", "", None, None), ("e", "beta", "", "ACTION", "c", D),
    ], S)


@pytest.fixture(scope="module")
def episodes(spark):
    return spark.createDataFrame([("1", "a", 2, "t", None, 5, 3, D), ("2", "a", 1, "t", None, None, None, D), ("3", "e", 1, "t", None, 5, 3, D), ("4", "zz", 1, "t", None, 5, 9, D), ("5", None, 1, "t", None, 5, 9, None)], E)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_empty_series_are_kept(series, episodes):
    got = {r["id"]: (r["episode_count"], r["views"], r["first_episode_id"], r["latest_episode_at"]) for r in C.series_with_episodes(series, episodes).collect()}
    assert got["b"] == (0, 0, None, None) and got["a"] == (2, 3, "2", D) and len(got) == 5


def test_orders_are_total(series, episodes):
    assert ids(C.list_series(series, episodes, "popular"))[:2] == ["a", "e"]  # tied in views, date and title
    assert ids(C.list_series(series, episodes, "alphabetical")) == ["b", "a", "e", "c", "d"]
    assert ids(C.list_series(series, episodes, "newest"))[-1] == "d"
    with pytest.raises(ValueError):
        C.list_series(series, episodes, "best")


def test_genre_is_a_token(series, episodes):
    assert set(ids(C.list_series(series, episodes, genre="action"))) == {"a", "c", "e"}


@pytest.mark.parametrize("query,want", [("100%", {"b"}), ("true_s", {"b"}), ("y!", {"b"}), ("%", {"b"}), ("ALPHA", {"b"}), ("drama", {"a"}), ("none", set())])
def test_search_takes_signs_as_they_are(series, episodes, query, want):
    assert set(ids(C.list_series(series, episodes, query=query))) == want


def test_limits(series, episodes):
    assert len(ids(C.list_series(series, episodes, limit=2))) == 2 and len(ids(C.list_series(series, episodes, limit=0))) == 5


def test_genres_in_first_spelling(series):
    assert [r["genre"] for r in C.list_genres(series).collect()] == ["Action", "Drama", "Reaction", "x"]


def test_neighbours_numbers_and_featured(series, episodes):
    got = {r["id"]: (r["previous_id"], r["next_id"]) for r in C.with_neighbours(episodes).collect()}
    assert got["2"] == (None, "1") and got["1"] == ("2", None)
    assert {r["series_id"]: r["next_number"] for r in C.next_episode_numbers(series, episodes).collect()}["b"] == 1
    assert ids(C.featured_series(series, episodes)) == ["a"]
    assert {(r["id"], r["related_id"]) for r in C.related_series(series, episodes).collect()} >= {("a", "e"), ("c", "a"), ("e", "c")}


def test_empty_tables(spark):
    s, e = spark.createDataFrame([], S), spark.createDataFrame([], E)
    assert ids(C.list_series(s, e)) == [] and C.list_genres(s).count() == 0 and ids(C.featured_series(s, e)) == [] and C.related_series(s, e).count() == 0


@pytest.mark.parametrize("f,value,want", [
    (G.format_duration, 0.4, ""), (G.format_duration, 59.5, "1:00"), (G.format_duration, 3661.0, "1:01:01"), (G.format_duration, None, ""),
    (G.format_count, 999, "999"), (G.format_count, 1000, "1K"), (G.format_count, 1450, "1.4K"), (G.format_count, 1250, "1.3K"), (G.format_count, 9950, "9.9K"), (G.format_count, 12_500, "13K"), (G.format_count, 999_999, "1000K"), (G.format_count, 3_500_000, "3.5M"),
    (G.format_bytes, 1 << 30, "1.00 GB"), (G.format_bytes, 1 << 20, "1.0 MB"), (G.episode_label, 1, "1 episode"), (G.episode_label, 0, "0 episodes"), (G.pad, 123, "123"), (G.pad, 7, "07"),
])
def test_formats(spark, f, value, want):
    kind = "double" if f is G.format_duration else "bigint"
    assert spark.range(1).select(f(F.lit(value).cast(kind))).first()[0] == want


@pytest.mark.parametrize("seconds,want", [(-5, "Just now"), (59, "Just now"), (60, "1 minute ago"), (7200, "2 hours ago"), (86_400 * 6, "6 days ago"), (86_400 * 13, "1 week ago"), (86_400 * 400, "1 year ago")])
def test_time_ago(spark, seconds, want):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    then = F.timestamp_seconds(F.unix_seconds(now) - seconds)
    assert spark.range(1).select(G.time_ago(then, now)).first()[0] == want


def test_dates_and_hues(spark):
    row = spark.range(1).select(G.format_date(G.parse_timestamp(F.lit("2026-05-04 10:00:00"))), G.format_date(G.parse_timestamp(F.lit("2026-05-04T23:30:00-02:00"))), G.parse_timestamp(F.lit("soon")), G.poster_hue(F.lit("")), G.poster_hue(F.lit("abc")), G.normalize_list(F.lit(" , ,"), "Anime"), G.normalize_list(F.lit("a,b,c,d,e,f,g"), "x"), G.valid_text(F.lit(" \t "), 5)).first()
    assert tuple(row) == ("May 4, 2026", "May 5, 2026", None, 0, (97 * 961 + 98 * 31 + 99) % 360, "Anime", "a, b, c, d, e, f", None)
