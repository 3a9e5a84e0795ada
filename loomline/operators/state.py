"""State by key: watch progress, views, keyed changes of tables, documents of jobs.

``history`` has user_id, episode_id, series_id, series_title, ep_number, title, time_s,
duration, updated_at, ingested_at. Its order of events is (updated_at, ingested_at,
time_s, duration); rows that are equal in all of these are one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.session import shared_dir

_EVENT = ("updated_at", "ingested_at", "time_s", "duration")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, then by all its values; aggregated before the shuffle.

    Nulls in ``order`` come first; null keys are keys like others.
    """
    rest = [c for c in df.columns if c not in key]
    place = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), place).alias("_r"))
    return best.select(*key, "_r.*").select(*df.columns)


def progress(history: DataFrame, keep: int = 100) -> DataFrame:
    """Last progress of each user in each episode, the newest ``keep`` of a user, with rank from 1."""
    last = latest(history, ["user_id", "episode_id"], _EVENT)
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("ingested_at"), "episode_id")
    return last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def is_finished(time: Column, duration: Column) -> Column:
    """More than 95 % seen; false where the duration is missing or zero."""
    return F.coalesce((duration > 0) & (time / duration > 0.95), F.lit(False))


def continue_watching(history: DataFrame, most: int = 12) -> DataFrame:
    """Newest episode of each series of a user if it isn't finished, ``most`` of them, newest first.

    The newest is taken first: a finished one hides its series.
    """
    entries = progress(history)
    last = latest(entries.drop("rank"), ["user_id", "series_id"], ["updated_at", "ingested_at"]).where(~is_finished(F.col("time_s"), F.col("duration")))
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("updated_at"), "series_id")
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def resume_at(time: Column, duration: Column) -> Column:
    """Where to go on: after the first 10 seconds of what isn't finished, else null."""
    return F.when((time > 10) & ~is_finished(time, duration), time)


def watched_part(time: Column, duration: Column) -> Column:
    """Per cent seen, 100 at most; 0 without a duration."""
    return F.coalesce(F.when(duration > 0, F.least(F.lit(100.0), time / duration * 100)), F.lit(0.0))


def view_counts(views: DataFrame, session: Sequence[str], item: str) -> DataFrame:
    """Views of each item, one for each session however often it was played."""
    return views.select(*session, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n_views"))


def upserted(table: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table with rows replaced by key and new ones added; ``changes`` has one row a key and the same columns."""
    kept = table.join(changes.select(*key), list(key), "left_anti")
    return kept.unionByName(changes.select(*table.columns))


def deleted(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table without rows of the given keys."""
    return table.join(keys.select(*key).distinct(), list(key), "left_anti")


def conflicts(new: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows that may not be added: their key is taken, or twice among the new."""
    taken = new.join(table.select(*key).distinct(), list(key), "left_semi").withColumn("reason", F.lit("taken"))
    twice = new.groupBy(*key).count().where("count > 1").drop("count")
    return taken.unionByName(new.join(twice, list(key), "left_semi").join(table.select(*key).distinct(), list(key), "left_anti").withColumn("reason", F.lit("twice")))


def published(frames: dict[str, DataFrame], at: str) -> str:
    """Write several tables as one version: each to a fresh folder, and last a file that names them.

    Readers follow the newest complete version, so either all tables change or none does. One writer at a time.
    """
    spark = next(iter(frames.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in frames.items():
        df.write.parquet(os.path.join(at, version, name))
    rows = [(version, name) for name in frames]
    spark.createDataFrame(rows, "version string, name string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(os.path.join(at, "_versions"))
    return version


def current(spark, at: str, name: str) -> DataFrame:
    """A table of the newest complete version."""
    newest = spark.read.parquet(os.path.join(at, "_versions")).orderBy(F.desc("at"), F.desc("version")).first()
    return spark.read.parquet(os.path.join(at, newest["version"], name))


def part_plan(size: Column, part: int = 8 << 20) -> Column:
    """(n_parts, last_size) of an upload in equal parts and a rest; null for nothing."""
    n = F.ceil(size / part).cast("bigint")
    return F.when(size > 0, F.struct(n.alias("n_parts"), (size - (n - 1) * part).alias("last_size")))


def parts_complete(numbers: Column, tags: Column, n_parts: Column) -> Column:
    """Whether parts 1 to n are there in order, each with a tag."""
    return F.coalesce((numbers == F.sequence(F.lit(1), n_parts.cast("int"))) & F.forall(tags, lambda t: F.coalesce(F.trim(t) != "", F.lit(False))) & (F.size(tags) == n_parts), F.lit(False))


def newest_documents(documents: DataFrame, n: int = 30) -> DataFrame:
    """Newest state of each document (id, created_at, ...), the ``n`` newest; no creation time counts as 0."""
    one = latest(documents, ["id"], ["created_at"]) if "saved_at" not in documents.columns else latest(documents, ["id"], ["saved_at"])
    return one.orderBy(F.desc(F.coalesce("created_at", F.lit(0.0))), "id").limit(n)


#: Names of the stages of a run, fixed values.
STAGES = ("Extracting audio", "Separating dialogue", "Finding speakers", "Sampling voices", "Transcribing", "Translating", "Generating Uzbek voices", "Mixing final audio")


def stage_of(message: Column) -> Column:
    """(stage, progress) that a log line reports as 'Stage n/8:'; null for other lines."""
    n = F.nullif(F.regexp_extract(message, r"Stage (\d)/8:", 1), F.lit("")).cast("int")
    name = F.get(F.array(*map(F.lit, STAGES)), n - 1)
    return F.when(n.between(1, 8), F.struct(name.alias("stage"), (n * 10 + 5).alias("progress")))


def byte_range(header: Column, size: Column, suffixes: bool = False) -> Column:
    """(first, last, status) of a Range header on so many bytes: 206 for a part, 200 for all, 416 for none there is.

    'bytes=a-b' and 'bytes=a-'; with ``suffixes`` also 'bytes=-n', the last n. Anything else asks for all.
    """
    a = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1)
    b = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    tail = F.lit(suffixes) & (a == "") & (b != "")
    part = F.coalesce((a != "") | tail, F.lit(False))
    first = F.when(tail, F.greatest(F.lit(0).cast("bigint"), size - b.try_cast("bigint"))).when(part, a.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    last = F.when(part & ~tail & (b != ""), F.least(b.try_cast("bigint"), size - 1)).otherwise(size - 1)
    bad = (first >= size) | (last < first)
    return F.struct(F.when(~bad, first).alias("first"), F.when(~bad, last).alias("last"), F.when(bad, 416).when(part, 206).otherwise(200).alias("status"))


def drifted(a: Column, b: Column, tolerance: float = 2.0) -> Column:
    """Whether two durations differ by more than the tolerance; null if one is missing."""
    return F.abs(a - b) > tolerance


def acceptable(size: Column, has_video: Column, has_audio: Column, duration: Column, expected: Column) -> Column:
    """Whether a result can stand: large enough, with both streams, of the right length."""
    return F.coalesce((size >= 1_000_000) & has_video & has_audio & (F.abs(duration - expected) <= 2.0), F.lit(False))


def upload_progress(sent: Column, size: Column, seconds: Column) -> Column:
    """(percent, bytes_per_second) of an upload; at least a second counts."""
    return F.struct(F.floor(sent / F.nullif(size, F.lit(0)) * 100 + 0.5).alias("percent"), (sent / F.greatest(F.lit(1.0), seconds)).alias("bytes_per_second"))


def thumbnail_time(duration: Column) -> Column:
    """Where to take a picture: a fifth in, a second at least, and before the last second."""
    return F.least(F.greatest(0.2 * duration, F.lit(1.0)), F.greatest(duration - 1, F.lit(0.0)))


ENTRIES = T.ArrayType(T.StructType([T.StructField("episodeId", T.StringType()), T.StructField("time", T.DoubleType()), T.StructField("duration", T.DoubleType())]))


def parsed_history(raw: Column) -> Column:
    """Entries of a stored JSON text; none for what is no JSON array."""
    ok = F.ltrim(F.coalesce(raw, F.lit(""))).startswith("[")
    return F.coalesce(F.when(ok, F.from_json(raw, ENTRIES, {"mode": "PERMISSIVE"})), F.array().cast(ENTRIES))


def scratch(spark) -> str:
    """A fresh folder in the place all executors share."""
    return os.path.join(shared_dir(spark), "state", uuid.uuid4().hex)
