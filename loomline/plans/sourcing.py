"""Queries over sources and sinks: files are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.scan import counted
from loomline.operators.state import scratch
from loomline.sources import files as S
from loomline.sources.tables import table

_RATE = 8000


def _signals(spark: SparkSession, base: str) -> DataFrame:
    """Values of each user's events as samples."""
    e = table(spark, base, "events", ["event_id", "user_id", "ts", "value"])
    rows = counted(e, "user_id", ["ts", "event_id"], "n", first=0)
    return rows.select(F.col("user_id").cast("string").alias("media_id"), "n", (F.floor((F.col("value") / 500 - 0.5) * 32768) / 32768).alias("x"))


def _wavs(spark: SparkSession, base: str) -> DataFrame:
    """Signals through WAV containers and back: sizes from the header, sums from the samples."""
    coded = S.wav_bytes(_signals(spark, base), _RATE).select(F.col("media_id").alias("path"), "content")
    heads = S.wav_headers(coded)
    sums = S.signal_of(coded).groupBy(F.col("media_id").alias("path")).agg(F.round(F.sum("x"), 6).alias("total"))
    return heads.join(sums, "path").select("path", "sample_rate", "channels", "n_frames", "duration", "total")


def _probes(spark: SparkSession, base: str) -> DataFrame:
    """Streams of episodes as a probe would list them, and where their results go."""
    eps = table(spark, base, "episodes", ["id", "ep_number", "object_key"])
    k = F.coalesce("ep_number", F.lit(0)) % 4
    probe = F.when(k == 0, "video,0\naudio,0").when(k == 1, "audio,0\nvideo,1").when(k == 2, "audio,0").otherwise("")
    s = S.streams(probe)
    return eps.select("id", s["has_video"].alias("has_video"), s["has_audio"].alias("has_audio"), S.result_path(F.concat("id", F.lit(".out.mp4")), s["has_video"]).alias("result"))


def _names(spark: SparkSession, base: str) -> DataFrame:
    """Titles as a list of names in text files, with comments and blank lines."""
    at = scratch(spark)
    titles = table(spark, base, "series", ["id", "title"])
    titles.select(F.concat(F.lit("# "), "id", F.lit("\n\n  "), F.coalesce("title", F.lit("")), F.lit("  "))).write.text(at)
    return S.name_list(spark, at).distinct()


def _glossary(spark: SparkSession, base: str) -> DataFrame:
    return S.glossary(spark, "captain: kapitan\nticket: chipta\n7: yetti\n'Dr': Dr\n")


def _parameters(spark: SparkSession, base: str) -> DataFrame:
    """SQL with bound parameters: text is never put together."""
    views = {"series": table(spark, base, "series", ["id", "title", "genre"]), "episodes": table(spark, base, "episodes", ["series_id", "view_count"])}
    return spark.sql("SELECT s.id, s.title, coalesce(sum(e.view_count), 0) AS views FROM {series} s LEFT JOIN {episodes} e ON e.series_id = s.id WHERE contains(lower(s.genre), :genre) GROUP BY s.id, s.title", args={"genre": "drama"}, **views)


def _stored(spark: SparkSession, base: str) -> DataFrame:
    """Files of one kind in a folder of several."""
    at = scratch(spark)
    eps = table(spark, base, "episodes", ["id", "title"])
    eps.write.mode("append").json(f"{at}/all")
    eps.select("title").where("title IS NOT NULL").write.mode("append").text(f"{at}/all")
    found = S.files(spark, f"{at}/all", "*.json").select(F.col("path").endswith(".json").alias("only_json"), F.lit(None).cast("string").alias("id"))
    documents = S.json_documents(spark, f"{at}/all", "id string, title string", "*.json").select(F.lit(None).cast("boolean").alias("only_json"), "id")
    return found.unionByName(documents).agg(F.coalesce(F.bool_and("only_json"), F.lit(True)).alias("only_json"), F.count("id").alias("n_documents"))


QUERIES = {
    "H1_H11_files": _stored,
    "H2_H5_probes": _probes,
    "H3_H4_wavs": _wavs,
    "H6_C19_glossary": _glossary,
    "H7_names": _names,
    "H9_parameters": _parameters,
}

_STRIP = r"regexp_replace(title, '^\s+|\s+$', '', 'g')"

SQL = {
    "H1_H11_files": "SELECT true AS only_json, count(id) AS n_documents FROM episodes",
    "H2_H5_probes": "SELECT id, coalesce(ep_number, 0) % 4 = 0 AS has_video, coalesce(ep_number, 0) % 4 < 3 AS has_audio, CASE WHEN coalesce(ep_number, 0) % 4 = 0 THEN id || '.out.mp4' ELSE id || '.out.wav' END AS result FROM episodes",
    "H3_H4_wavs": f"SELECT CAST(user_id AS VARCHAR) AS path, {_RATE} AS sample_rate, 1 AS channels, count(*) AS n_frames, count(*) / {_RATE} AS duration, round(sum(floor((value / 500 - 0.5) * 32768) / 32768), 6) AS total FROM events GROUP BY user_id",
    "H6_C19_glossary": "SELECT * FROM (VALUES ('captain', 'kapitan'), ('ticket', 'chipta'), ('7', 'yetti'), ('Dr', 'Dr')) t(term, rendering)",
    "H7_names": f"SELECT DISTINCT {_STRIP} AS name FROM series WHERE {_STRIP} <> '' AND NOT starts_with({_STRIP}, '#')",
    "H9_parameters": "SELECT s.id, s.title, CAST(coalesce(sum(e.view_count), 0) AS BIGINT) AS views FROM series s LEFT JOIN episodes e ON e.series_id = s.id WHERE contains(lower(s.genre), 'drama') GROUP BY s.id, s.title",
}
