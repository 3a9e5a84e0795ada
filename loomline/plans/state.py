"""Queries over watch history and the state of uploads and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import state as S
from loomline.sources.tables import table

_COLS = ["user_id", "episode_id", "series_id", "series_title", "ep_number", "title", "time_s", "duration", "updated_at", "ingested_at"]
_OUT = ["user_id", "episode_id", "series_id", "time_s", "duration"]


def _history(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "history", _COLS)


def _episodes(spark: SparkSession, base: str, *cols: str) -> DataFrame:
    return table(spark, base, "episodes", ["id", *cols])


def _views(spark: SparkSession, base: str) -> DataFrame:
    """A user's day is a session."""
    h = _history(spark, base).withColumn("day", F.to_date("updated_at"))
    return S.view_counts(h, ["user_id", "day"], "episode_id")


def _counted(spark: SparkSession, base: str) -> DataFrame:
    """Episodes with the views of the history added to theirs."""
    eps = _episodes(spark, base, "view_count")
    changes = eps.join(_views(spark, base), eps["id"] == F.col("episode_id")).select("id", (F.coalesce("view_count", F.lit(0)) + F.col("n_views")).cast("int").alias("view_count"))
    return S.upserted(eps, changes, ["id"])


def _uploads(spark: SparkSession, base: str) -> DataFrame:
    """Uploads of every series: the number after each episode, and the episode's own again."""
    eps = _episodes(spark, base, "series_id", "ep_number").where("ep_number IS NOT NULL")
    return eps.select(F.concat(F.lit("u"), "id").alias("id"), "series_id", F.explode(F.array("ep_number", F.col("ep_number") + 1)).alias("ep_number"))


def _appended(spark: SparkSession, base: str) -> DataFrame:
    """Uploads without conflict become episodes and leave the uploads: both tables change as one version."""
    eps, up = _episodes(spark, base, "series_id", "ep_number"), _uploads(spark, base)
    bad = S.conflicts(up, eps, ["series_id", "ep_number"]).select("series_id", "ep_number").distinct()
    good = S.deleted(up, bad, ["series_id", "ep_number"])
    at = S.scratch(spark)
    S.published({"episodes": eps, "uploads": up}, at)
    S.published({"episodes": S.current(spark, at, "episodes").unionByName(good), "uploads": S.deleted(S.current(spark, at, "uploads"), good, ["id", "ep_number"])}, at)
    both = S.current(spark, at, "episodes").withColumn("tbl", F.lit("episodes")).unionByName(S.current(spark, at, "uploads").withColumn("tbl", F.lit("uploads")))
    return both.groupBy("tbl", "series_id").agg(F.count(F.lit(1)).alias("n"), F.max("ep_number").alias("last"))


def _parts(spark: SparkSession, base: str) -> DataFrame:
    plan = S.part_plan(F.col("bytes"))
    numbers = F.sequence(F.lit(1), plan["n_parts"].cast("int"))
    tags = F.transform(numbers, lambda n: F.when(n % 50 == 0, F.lit("")).otherwise(n.cast("string")))
    return _episodes(spark, base, "bytes").select("id", plan["n_parts"].alias("n_parts"), plan["last_size"].alias("last_size"), S.parts_complete(numbers, tags, plan["n_parts"]).alias("complete"))


def _jobs(spark: SparkSession, base: str) -> DataFrame:
    """Documents of episodes, saved twice as JSON and read again; the newest states of the newest thirty."""
    eps = _episodes(spark, base, "title", "created_at")
    doc = eps.select("id", "title", F.unix_seconds("created_at").cast("double").alias("created_at"))
    saved = doc.withColumns({"status": F.lit("queued"), "saved_at": F.lit(1)}).unionByName(doc.withColumns({"status": F.lit("done"), "saved_at": F.lit(2)}))
    at = S.scratch(spark)
    saved.write.json(at)
    read = spark.read.schema("id string, title string, created_at double, status string, saved_at int").json(at)
    return S.newest_documents(read).select("id", "title", "created_at", "status")


def _logs(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "segments", ["seg_id", "seg_idx"])
    line = F.concat(F.lit("Stage "), (F.col("seg_idx") % 11).cast("string"), F.lit("/8: working"))
    s = S.stage_of(line)
    return rows.select("seg_id", s["stage"].alias("stage"), s["progress"].alias("progress"))


def _ranges(spark: SparkSession, base: str) -> DataFrame:
    """Ranges of all kinds on every episode's bytes."""
    kinds = ("bytes=0-99", "bytes=100-", "bytes=-500", "bytes=5-2", "bytes=99999999999-", "items=1-2", "bytes=7-99999999999")
    rows = _episodes(spark, base, "bytes").select("id", F.col("bytes").cast("bigint").alias("size"), F.explode(F.array(*map(F.lit, kinds))).alias("header"))
    r = S.byte_range(F.col("header"), F.col("size"), suffixes=True)
    return rows.select("id", "header", r["first"].alias("first"), r["last"].alias("last"), r["status"].alias("status"))


def _checks(spark: SparkSession, base: str) -> DataFrame:
    """Results of a batch: what is to do, and whether what is there can stand."""
    eps = _episodes(spark, base, "bytes", "duration", "thumb_key", "content_type")
    seen = table(spark, base, "history", ["episode_id", "duration"]).groupBy(F.col("episode_id").alias("id")).agg(F.max("duration").alias("played"))
    rows = eps.join(seen, "id", "left")
    ok = S.acceptable(F.col("bytes"), F.col("content_type").startswith("video"), F.lit(True), F.col("played"), F.col("duration"))
    up = S.upload_progress(F.col("bytes") / 3, F.col("bytes"), F.col("duration"))
    return rows.select("id", F.col("played").isNull().alias("to_do"), ok.alias("stands"), S.drifted(F.col("played"), F.col("duration")).alias("drifted"), F.round(S.thumbnail_time(F.col("duration")), 6).alias("thumbnail_at"), up["percent"].alias("percent"), F.round(up["bytes_per_second"], 3).alias("speed"))


def _parsed(spark: SparkSession, base: str) -> DataFrame:
    """Progress of each user as stored JSON, some of it broken, read again."""
    p = S.progress(_history(spark, base))
    item = F.to_json(F.struct(F.col("episode_id").alias("episodeId"), F.col("time_s").alias("time"), "duration"))
    raw = p.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("raw"), F.count(F.lit(1)).alias("n"))
    sign = F.substring(F.md5("user_id"), 1, 1)
    broken = F.when(sign.isin("0", "1", "2"), F.lit("{}")).when(sign.isin("3", "4"), F.lit("[oops")).otherwise(F.col("raw"))
    return raw.select("user_id", F.size(S.parsed_history(broken)).alias("n_read"))



QUERIES = {
    "F1_F2_progress": lambda s, b: S.progress(_history(s, b)).select(*_OUT, "rank"),
    "F3_F5_F20_resume": lambda s, b: S.progress(_history(s, b)).select("user_id", "episode_id", S.is_finished(F.col("time_s"), F.col("duration")).alias("finished"), S.resume_at(F.col("time_s"), F.col("duration")).alias("resume_at"), F.round(S.watched_part(F.col("time_s"), F.col("duration")), 6).alias("percent")),
    "F4_continue_watching": lambda s, b: S.continue_watching(_history(s, b)).select(*_OUT, "place"),
    "F6_views": _views,
    "F7_F8_appended": _appended,
    "F9_counted": _counted,
    "F10_conflicts": lambda s, b: S.conflicts(_uploads(s, b), _episodes(s, b, "series_id", "ep_number"), ["series_id", "ep_number"]).select("id", "series_id", "ep_number", "reason"),
    "F11_parts": _parts,
    "F12_F13_H8_jobs": _jobs,
    "F14_stages": _logs,
    "F16_ranges": _ranges,
    "F18_F19_F21_F22_checks": _checks,
    "F24_parsed": _parsed,
}

_P = """
WITH h AS (SELECT DISTINCT user_id, episode_id, series_id, series_title, ep_number, title, time_s, duration, updated_at, ingested_at FROM history),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, episode_id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST, time_s DESC NULLS LAST, duration DESC NULLS LAST, series_id DESC NULLS LAST, series_title DESC NULLS LAST, ep_number DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST, episode_id) AS rank FROM k WHERE rn = 1),
e AS (SELECT *, coalesce(duration > 0 AND time_s / duration > 0.95, false) AS finished FROM p WHERE rank <= 100)"""
_UP = "u AS (SELECT 'u' || id AS id, series_id, unnest([ep_number, ep_number + 1]) AS ep_number FROM episodes WHERE ep_number IS NOT NULL)"
_CON = f"""{_UP},
tk AS (SELECT u.*, EXISTS (SELECT 1 FROM episodes e WHERE e.series_id = u.series_id AND e.ep_number = u.ep_number) AS taken, count(*) OVER (PARTITION BY series_id, ep_number) AS c FROM u)"""

SQL = {
    "F1_F2_progress": f"{_P} SELECT user_id, episode_id, series_id, time_s, duration, CAST(rank AS INT) AS rank FROM e",
    "F3_F5_F20_resume": f"{_P} SELECT user_id, episode_id, finished, CASE WHEN time_s > 10 AND NOT finished THEN time_s END AS resume_at, round(coalesce(CASE WHEN duration > 0 THEN least(100.0::DOUBLE, time_s / duration * 100) END, 0.0), 6) AS percent FROM e",
    "F4_continue_watching": f"""{_P},
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, series_id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST, episode_id DESC) AS sn FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, series_id) AS place FROM s WHERE sn = 1 AND NOT finished)
SELECT user_id, episode_id, series_id, time_s, duration, CAST(place AS INT) AS place FROM c WHERE place <= 12""",
    "F6_views": "SELECT episode_id, count(*) AS n_views FROM (SELECT DISTINCT user_id, CAST(updated_at AT TIME ZONE 'UTC' AS DATE) AS d, episode_id FROM history) GROUP BY 1",
    "F7_F8_appended": f"""WITH {_CON}, good AS (SELECT id, series_id, ep_number FROM tk WHERE NOT taken AND c = 1),
b AS (SELECT 'episodes' AS tbl, series_id, ep_number FROM episodes UNION ALL SELECT 'episodes', series_id, ep_number FROM good UNION ALL SELECT 'uploads', series_id, ep_number FROM tk WHERE taken OR c > 1)
SELECT tbl, series_id, count(*) AS n, max(ep_number) AS last FROM b GROUP BY 1, 2""",
    "F9_counted": "WITH v AS (SELECT episode_id, count(*) AS n FROM (SELECT DISTINCT user_id, CAST(updated_at AT TIME ZONE 'UTC' AS DATE) AS d, episode_id FROM history) GROUP BY 1) SELECT id, CASE WHEN n IS NULL THEN view_count ELSE CAST(coalesce(view_count, 0) + n AS INT) END AS view_count FROM episodes LEFT JOIN v ON v.episode_id = id",
    "F10_conflicts": f"WITH {_CON} SELECT id, series_id, ep_number, CASE WHEN taken THEN 'taken' ELSE 'twice' END AS reason FROM tk WHERE taken OR c > 1",
    "F11_parts": """WITH p AS (SELECT id, bytes, CAST(ceil(bytes / 8388608) AS BIGINT) AS n FROM episodes)
SELECT id, CASE WHEN bytes > 0 THEN n END AS n_parts, CASE WHEN bytes > 0 THEN bytes - (n - 1) * 8388608 END AS last_size, coalesce(bytes > 0 AND n < 50, false) AS complete FROM p""",
    "F12_F13_H8_jobs": "SELECT id, title, CAST(floor(epoch(created_at AT TIME ZONE 'UTC')) AS DOUBLE) AS created_at, 'done' AS status FROM episodes ORDER BY coalesce(floor(epoch(created_at AT TIME ZONE 'UTC')), 0) DESC, id LIMIT 30",
    "F14_stages": f"SELECT seg_id, CASE WHEN seg_idx % 11 BETWEEN 1 AND 8 THEN ['Extracting audio', 'Separating dialogue', 'Finding speakers', 'Sampling voices', 'Transcribing', 'Translating', 'Generating Uzbek voices', 'Mixing final audio'][seg_idx % 11] END AS stage, CASE WHEN seg_idx % 11 BETWEEN 1 AND 8 THEN CAST(seg_idx % 11 * 10 + 5 AS INT) END AS progress FROM segments",
    "F16_ranges": r"""
WITH r AS (SELECT id, CAST(bytes AS BIGINT) AS size, unnest(['bytes=0-99', 'bytes=100-', 'bytes=-500', 'bytes=5-2', 'bytes=99999999999-', 'items=1-2', 'bytes=7-99999999999']) AS header FROM episodes),
x AS (SELECT *, regexp_extract(header, '^bytes=(\d*)-(\d*)$', 1) AS a, regexp_extract(header, '^bytes=(\d*)-(\d*)$', 2) AS b FROM r),
y AS (SELECT *, a = '' AND b <> '' AS tail, a <> '' OR b <> '' AS part FROM x),
z AS (SELECT *, CASE WHEN tail THEN greatest(0, size - TRY_CAST(b AS BIGINT)) WHEN part THEN TRY_CAST(a AS BIGINT) ELSE 0 END AS f, CASE WHEN part AND NOT tail AND b <> '' THEN least(TRY_CAST(b AS BIGINT), size - 1) ELSE size - 1 END AS l FROM y)
SELECT id, header, CASE WHEN NOT (f >= size OR l < f) THEN f END AS first, CASE WHEN NOT (f >= size OR l < f) THEN l END AS last, CASE WHEN f >= size OR l < f THEN 416 WHEN part THEN 206 ELSE 200 END AS status FROM z""",
    "F18_F19_F21_F22_checks": """
WITH h AS (SELECT episode_id, max(duration) AS played FROM history GROUP BY 1), r AS (SELECT e.*, played FROM episodes e LEFT JOIN h ON h.episode_id = e.id)
SELECT id, played IS NULL AS to_do, coalesce(bytes >= 1000000 AND starts_with(content_type, 'video') AND abs(played - duration) <= 2.0, false) AS stands, abs(played - duration) > 2.0 AS drifted,
  CAST(round(least(greatest(0.2::DOUBLE * duration, 1.0), greatest(duration - 1, 0.0)), 6) AS DOUBLE) AS thumbnail_at, CAST(floor(bytes / 3 / nullif(bytes, 0) * 100 + 0.5) AS BIGINT) AS percent, round(bytes / 3 / greatest(1.0::DOUBLE, coalesce(duration, 1)), 3) AS speed FROM r""",
    "F24_parsed": f"{_P} SELECT user_id, CASE WHEN substr(md5(user_id), 1, 1) BETWEEN '0' AND '4' THEN 0 ELSE count(*) END AS n_read FROM e GROUP BY user_id",
}
