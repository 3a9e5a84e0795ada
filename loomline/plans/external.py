"""Queries through the slots for models, with stand-ins, and the dataflow of a whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import external as E
from loomline.operators import signals as G
from loomline.operators import timeline as T
from loomline.operators.scan import counted
from loomline.plans.text import GLOSSARY
from loomline.session import stored
from loomline.sources.tables import table


def _frames(spark: SparkSession, base: str) -> DataFrame:
    """Ten events of a user in order of time are a frame."""
    e = table(spark, base, "events", ["event_id", "user_id", "ts", "value"])
    rows = counted(e, "user_id", ["ts", "event_id"], "n", first=0).select(F.col("user_id").alias("media_id"), "n", ((F.col("value") - 30) / 500).alias("x")).withColumn("frame", F.floor(F.col("n") / 10))
    return rows.groupBy("media_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda v: v["x"]).alias("samples"))


def _separated(spark: SparkSession, base: str) -> DataFrame:
    """Tracks add up to what they were made of."""
    r = E.stand_ins()
    tracks = E.separate_frames(r, "halves", _frames(spark, base))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return tracks.groupBy("media_id", "track").agg(F.count(F.lit(1)).alias("n_frames"), F.round(F.sum(total), 6).alias("total"))


def _diarized(spark: SparkSession, base: str) -> DataFrame:
    """Who speaks in each user's frames, by the diarizer that is picked without a token."""
    r = E.stand_ins()
    return E.diarized(r, E.pick_diarizer("auto", False, r.names("diarizer")), _frames(spark, base))


def _single(spark: SparkSession, base: str) -> DataFrame:
    """One turn over all frames of each user, by the diarizer for a single speaker."""
    return E.diarized(E.stand_ins(), "single", _frames(spark, base))


def _spelled(spark: SparkSession, base: str) -> DataFrame:
    """Turns whose sound says how long their words are, through the transcriber."""
    r = E.stand_ins()
    lines = T.timeline(table(spark, base, "segments", ["media_id", "seg_id", "start_s", "end_s", "speaker_id", "text"])).where("text <> ''")
    # 15 samples a sign, loud for letters and silent for blanks
    sound = F.flatten(F.transform(F.split(F.regexp_replace("text", r"(?U)\s", " "), ""), lambda c: F.array_repeat(F.when(c == " ", 0.0).otherwise(0.2), 15)))
    turns = lines.select("media_id", "seg_id", "speaker_id", "start_ms", sound.alias("samples"))
    words = E.transcribed(r, "lengths", turns, rate=250, names=["Anna"])
    return words.groupBy("seg_id", "speaker_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum(F.length("text")).alias("n_letters"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


def _transcribed(spark: SparkSession, base: str) -> DataFrame:
    """Words of the given transcripts with the speaker who holds each at its middle."""
    lines = T.timeline(table(spark, base, "segments", ["media_id", "seg_id", "seg_idx", "start_s", "end_s", "speaker_id", "words"]))
    turns = lines.where("speaker_id IS NOT NULL").select("media_id", F.col("start_ms").alias("turn_start"), F.col("end_ms").alias("turn_end"), F.struct("seg_idx", "seg_id").alias("turn_order"), F.col("speaker_id").alias("turn_speaker"))
    words = T.words_of(lines).select("media_id", F.concat_ws("-", F.col("seg_id").cast("string"), F.col("word_idx").cast("string")).alias("word_id"), ((F.col("word_start") + F.col("word_end")) / 2).alias("middle"))
    return T.speaker_at(words, "middle", "word_id", turns).groupBy("media_id", "speaker").agg(F.count(F.lit(1)).alias("n_words"))


def _translated(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "segments", ["seg_id", "text", "detected_language"])
    return rows.select("seg_id", E.translate_column(E.stand_ins(), "tagged", F.col("text"), X.source_language(F.col("detected_language"), None), "uz").alias("translated"))


def _spoken(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "segments", ["media_id", "seg_id", "translated_text"]).select("media_id", "seg_id", F.col("translated_text").alias("text"), F.lit(1.25).alias("speed"))
    return E.synthesize_rows(E.stand_ins(), "tone", rows).select("media_id", "seg_id", F.round("seconds", 6).alias("seconds"))


def _presets(spark: SparkSession, base: str) -> DataFrame:
    """Presets of a voice by their names and by each word of their tags."""
    rows = [("xotirjam", "[calm]"), ("quvnoq", "[happy] [excited]"), ("pichirlash", "[whispers]")]
    df = spark.createDataFrame(rows, "name string, tag string")
    words = F.filter(F.split(F.translate("tag", "[]", "  "), " "), lambda w: w != "")
    return df.select("name", F.explode(F.array_union(F.array(F.lower("name")), F.transform(words, lambda w: F.lower(w)))).alias("key"))


def _dataflow(spark: SparkSession, base: str) -> DataFrame:
    """Sentences, plain wording, protected terms, translation, placement and speed of every line."""
    r = E.stand_ins()
    r.preflight({"translator": "tagged", "synthesizer": "tone", "diarizer": E.pick_diarizer("auto", False, r.names("diarizer"))})
    lines = T.timeline(table(spark, base, "segments", ["media_id", "seg_id", "seg_idx", "start_s", "end_s", "speaker_id", "text", "detected_language"])).where("text IS NOT NULL")
    plain = X.plain_wording(F.col("text"), F.col("detected_language"))
    ready = lines.withColumn("protected", X.protect(plain, GLOSSARY))
    said = ready.withColumn("raw", E.translate_column(r, "tagged", F.col("protected"), X.source_language(F.col("detected_language"), None), "uz"))
    said = said.withColumn("translated", X.restore(F.col("raw"), X.fired(F.col("protected"), GLOSSARY)))
    ends = lines.groupBy("media_id").agg(F.max("end_ms").alias("track_end"))
    timed = said.join(ends, "media_id").select("media_id", "seg_id", "seg_idx", "start_ms", "end_ms", "speaker_id", "translated", F.round(F.length("translated") * 0.06, 3).alias("natural"), "track_end")
    plan = T.plan_speeds(timed, "natural", "track_end")
    level = F.least(F.lit(0.3), F.length("translated") / 1000)
    planned = plan.withColumn("level", level)
    # the medians of the levels read the plan several times
    return G.targets(stored(planned)).select("media_id", "seg_id", "translated", F.round("planned_start", 6).alias("planned_start"), F.round("speed", 6).alias("speed"), F.round("intensity_db", 6).alias("intensity_db"))


QUERIES = {
    "J1_separated": _separated,
    "J2_J8_J9_diarized": _diarized,
    "J2_single": _single,
    "J3_words_of_sound": _spelled,
    "J3_transcribed": _transcribed,
    "J4_translated": _translated,
    "J5_spoken": _spoken,
    "J5_C22_presets": _presets,
    "J6_J7_J10_dataflow": _dataflow,
}

_SIG = "s AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, (value - 30) / 500 AS x FROM events)"

SQL = {
    "J1_separated": f"WITH {_SIG}, t AS (SELECT media_id, n // 10 AS f, x, unnest(['vocals', 'background']) AS track FROM s) SELECT media_id, track, count(DISTINCT f) AS n_frames, round(sum(CASE WHEN (abs(x) >= 0.1) = (track = 'vocals') THEN x ELSE 0.0 END), 6) AS total FROM t GROUP BY 1, 2",
    "J5_spoken": "SELECT media_id, seg_id, round(round(coalesce(length(translated_text), 0) * 0.06::DOUBLE * 250 / 1.25) / 250, 6) AS seconds FROM segments",
    "J5_C22_presets": "SELECT * FROM (VALUES ('xotirjam', 'xotirjam'), ('xotirjam', 'calm'), ('quvnoq', 'quvnoq'), ('quvnoq', 'happy'), ('quvnoq', 'excited'), ('pichirlash', 'pichirlash'), ('pichirlash', 'whispers')) t(name, key)",
}

_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL["J4_translated"] = rf"SELECT seg_id, CASE WHEN text IS NULL OR regexp_matches(text, '^{_BLANK}*$') THEN '' ELSE '[' || coalesce(nullif(detected_language, ''), 'auto') || '>uz] ' || text END AS translated FROM segments"
SQL["J3_transcribed"] = """
WITH t AS (SELECT *, CAST(round(start_s * 1000) AS BIGINT) AS start_ms, CAST(round(end_s * 1000) AS BIGINT) AS end_ms FROM segments WHERE media_id IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s)),
l AS (SELECT * FROM t WHERE end_ms > start_ms),
w AS (SELECT media_id, seg_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM l),
p AS (SELECT media_id, seg_id || '-' || i AS word_id, (CAST(round(word.start_s * 1000) AS BIGINT) + CAST(round(word.end_s * 1000) AS BIGINT)) / 2 AS middle FROM w WHERE word.text IS NOT NULL AND NOT isnan(word.start_s) AND NOT isnan(word.end_s)),
u AS (SELECT media_id, start_ms, end_ms, seg_idx, seg_id, speaker_id FROM l WHERE speaker_id IS NOT NULL),
j AS (SELECT p.media_id, p.word_id, arg_min(u.speaker_id, {'c': CASE WHEN u.start_ms <= middle AND middle < u.end_ms THEN 0 ELSE 1 END, 'd': CASE WHEN u.start_ms <= middle AND middle < u.end_ms THEN 0 ELSE least(abs(u.start_ms - middle), abs(u.end_ms - middle)) END, 's': u.start_ms, 'i': u.seg_idx, 'g': u.seg_id}) AS speaker
      FROM p LEFT JOIN u ON u.media_id = p.media_id GROUP BY 1, 2)
SELECT media_id, coalesce(speaker, 'SPEAKER_00') AS speaker, count(*) AS n_words FROM j GROUP BY 1, 2"""
SQL["J2_single"] = "SELECT user_id AS media_id, 0.0::DOUBLE AS start_ms, ((count(*) + 9) // 10 * 1000)::DOUBLE AS end_ms, 'SPEAKER_00' AS speaker_id FROM events GROUP BY 1"
SQL["J3_words_of_sound"] = rf"""
WITH t AS (SELECT *, CAST(round(start_s * 1000) AS BIGINT) AS start_ms, CAST(round(end_s * 1000) AS BIGINT) AS end_ms, regexp_replace(text, '{_BLANK}', ' ', 'g') AS plain FROM segments WHERE media_id IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s)),
l AS (SELECT * FROM t WHERE end_ms > start_ms AND length(replace(plain, ' ', '')) > 0)
SELECT seg_id, speaker_id, len(list_filter(string_split(plain, ' '), lambda w: w <> '')) AS n_words, length(replace(plain, ' ', '')) AS n_letters, start_ms + 60 * (length(plain) - length(ltrim(plain, ' '))) AS first_ms, start_ms + 60 * length(rtrim(plain, ' ')) AS last_ms FROM l"""
