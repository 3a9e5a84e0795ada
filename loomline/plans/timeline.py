"""Queries over ordered timelines: segments of dubbed episodes, and events as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import timeline as T
from loomline.operators.intervals import milliseconds
from loomline.operators.scan import counted
from loomline.sources.tables import table

_COLS = ["media_id", "seg_id", "seg_idx", "start_s", "end_s", "speaker_id"]
#: Milliseconds between lines, and seconds that a character takes to say, of the planner's queries.
_GAP, _PACE = 80, 0.06


def _lines(spark: SparkSession, base: str, *more: str) -> DataFrame:
    return T.timeline(table(spark, base, "segments", [*_COLS, *more]))


def _speakers(spark: SparkSession, base: str) -> DataFrame:
    """Lines without a speaker get the one who speaks at their middle."""
    lines = _lines(spark, base)
    turns = lines.where("speaker_id IS NOT NULL").select("media_id", F.col("start_ms").alias("turn_start"), F.col("end_ms").alias("turn_end"), F.struct("seg_idx", "seg_id").alias("turn_order"), F.col("speaker_id").alias("turn_speaker"))
    points = lines.where("speaker_id IS NULL").select("media_id", "seg_id", ((F.col("start_ms") + F.col("end_ms")) / 2).alias("middle"))
    return T.speaker_at(points, "middle", "seg_id", turns).select("media_id", "seg_id", "middle", "speaker")


def _words(spark: SparkSession, base: str) -> DataFrame:
    return T.words_of(_lines(spark, base, "words"))


def _sentences(longest_ms: int | None):
    return lambda spark, base: T.sentences(_words(spark, base), longest_ms)


def _frames(spark: SparkSession, base: str) -> DataFrame:
    """Events of a user as frames, numbered by time, with speech where the value is above 30."""
    e = table(spark, base, "events", ["event_id", "user_id", "ts", "value"])
    return counted(e, "user_id", ["ts", "event_id"], "frame").select("user_id", "frame", (F.col("value") > 30).alias("is_speech"))


def _windows(spark: SparkSession, base: str) -> DataFrame:
    """Six-hour windows of a user's events of which half are speech."""
    e = table(spark, base, "events", ["user_id", "ts", "value"]).select(F.col("user_id").cast("string").alias("media_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") > 30).alias("is_speech"))
    hour = 3_600_000
    start = F.floor(F.col("at") / (6 * hour)) * (6 * hour)
    windows = e.select("media_id", start.alias("w_start")).distinct().withColumn("w_end", F.col("w_start") + 6 * hour)
    return T.covered_windows(windows, e, "at", "is_speech").withColumn("coverage", F.round("coverage", 6))


def _identified(spark: SparkSession, base: str) -> DataFrame:
    lines = _lines(spark, base)
    windows = lines.where("speaker_id IS NOT NULL").select("media_id", F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"), F.col("speaker_id").alias("label")).distinct()
    return T.identify_regions(T.speech_regions(lines), windows)


def _clips(spark: SparkSession, base: str) -> DataFrame:
    """The longest line of each speaker as a clip, with the words in it."""
    lines = _lines(spark, base, "words").where("speaker_id IS NOT NULL")
    longest = F.struct((F.col("end_ms") - F.col("start_ms")).alias("n"), -F.col("start_ms"), -F.col("seg_id"))
    clips = lines.groupBy("media_id", "speaker_id").agg(F.max_by(F.struct("start_ms", "end_ms"), longest).alias("c")).select("media_id", "speaker_id", F.col("c.start_ms").alias("clip_start"), F.col("c.end_ms").alias("clip_end"))
    return T.words_in_clips(T.words_of(lines), clips)


def _placement(spark: SparkSession, base: str) -> DataFrame:
    lines = _lines(spark, base, "placed_start")
    wanted = F.coalesce(milliseconds(F.col("placed_start")), F.col("start_ms"))
    rows = T.placed(lines, wanted, F.col("end_ms") - F.col("start_ms"), _GAP)
    return rows.select("media_id", "seg_id", "placed_ms", T.sample_offset(F.col("placed_ms"), 24_000).alias("sample"))


def _planned_input(spark: SparkSession, base: str) -> DataFrame:
    lines = _lines(spark, base, "translated_text")
    ends = lines.groupBy("media_id").agg(F.max("end_ms").alias("track_end"))
    natural = F.round(F.coalesce(F.length("translated_text"), F.lit(0)) * _PACE, 3)
    return lines.withColumn("natural", natural).join(ends, "media_id").drop("translated_text")


def _speeds(spark: SparkSession, base: str) -> DataFrame:
    """Speed and cap of each line if it started on time."""
    rows = _planned_input(spark, base)
    rows = T.with_room(rows, "track_end").withColumn("room_s", F.col("room_ms") / 1000)
    slot = (F.col("end_ms") - F.col("start_ms")) / 1000
    cap = T.speed_cap(F.lit(0.0), F.col("natural"), F.col("room_s"), 1.25, 1.4, 0.3)
    return rows.select("media_id", "seg_id", F.round("room_s", 6).alias("room_s"), cap.alias("cap"), F.round(T.choose_speed(F.col("natural"), F.col("room_s"), slot, 0.9, cap), 6).alias("speed"))


def _plan(spark: SparkSession, base: str) -> DataFrame:
    return T.plan_speeds(_planned_input(spark, base), "natural", "track_end")


def _planned(spark: SparkSession, base: str) -> DataFrame:
    return _plan(spark, base).select("media_id", "seg_id", *(F.round(c, 6).alias(c) for c in ("planned_start", "speed", "spoken")))


def _mix(spark: SparkSession, base: str) -> DataFrame:
    """Levels of one-second frames: every line at 0.2 over a background of 0.1."""
    lines = _lines(spark, base)
    ends = lines.groupBy("media_id").agg(F.max("end_ms").alias("track_ms"))
    length = F.col("end_ms") - F.col("start_ms")
    rows = T.placed(lines.withColumn("length_ms", length).join(ends, "media_id"), F.col("start_ms"), F.col("length_ms"), 0).select("media_id", "placed_ms", "length_ms", "track_ms", F.lit(0.2).alias("level"))
    return T.mixed_frames(rows, 1000, 0.1).withColumn("mixed", F.round("mixed", 6))


def _referenced(spark: SparkSession, base: str) -> DataFrame:
    """Lines with a reference of their own if they last 1.5 s, else the default."""
    lines = _lines(spark, base)
    long = F.col("end_ms") - F.col("start_ms") >= 1500
    return lines.withColumn("reference", F.when(long, F.concat(F.lit("line-"), F.col("seg_id").cast("string"))).otherwise(F.lit("default")))


def _chain(spark: SparkSession, base: str) -> DataFrame:
    """Reference of each line: its speaker's clip, their montage, its own, the nearest borrowed, the default."""
    lines = _referenced(spark, base)
    per = lines.where("speaker_id IS NOT NULL").groupBy("media_id", "speaker_id").agg(F.max(F.col("end_ms") - F.col("start_ms")).alias("longest"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"))
    clip = F.when(F.col("longest") >= 4000, F.concat(F.lit("clip-"), F.col("speaker_id")))
    montage = F.when(F.col("total") >= 600, F.concat(F.lit("montage-"), F.col("speaker_id")))
    own = F.when(F.col("reference") != "default", F.col("reference"))
    settled = lines.join(per, ["media_id", "speaker_id"], "left").withColumn("reference", F.coalesce(clip, montage, own, F.lit("default"))).drop("longest", "total")
    return T.borrowed(settled, "reference", "default").select("media_id", "seg_id", F.col("borrowed").alias("reference"))


def _projection(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "segments", [*_COLS, "text", "translated_text"]).where("start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s)")
    return counted(lines, "media_id", ["start_s", "seg_idx", "seg_id"], "n").select("media_id", "seg_id", F.col("speaker_id").alias("speaker"), T.two_digits(F.col("start_s")).alias("start_at"), T.two_digits(F.col("end_s")).alias("end_at"), F.col("text").alias("original"), F.col("translated_text").alias("translated"), F.format_string("line-%03d.wav", "n").alias("audio"))


def _stub(spark: SparkSession, base: str) -> DataFrame:
    media = table(spark, base, "episodes", ["id", "duration"]).select(F.col("id").alias("media_id"), "duration")
    return T.single_speaker(media, "duration")


QUERIES = {
    "B1_B2_speaker_at": _speakers,
    "B3_sentences": _sentences(None),
    "B3_B4_sentences_forced": _sentences(12_000),
    "B5_speech_runs": lambda s, b: T.runs_of(_frames(s, b), "user_id", "frame", F.col("is_speech")),
    "B6_speech_regions": lambda s, b: T.speech_regions(_lines(s, b)),
    "B7_identified_regions": _identified,
    "B8_covered_windows": _windows,
    "B9_words_in_clips": _clips,
    "B10_speaker_bounds": lambda s, b: T.speaker_bounds(_lines(s, b)).select("media_id", "seg_id", "run_start", "run_end"),
    "B11_B17_placement": _placement,
    "B12_B13_B14_speeds": _speeds,
    "B15_plan": _planned,
    "B16_lateness": lambda s, b: T.lateness(_plan(s, b)),
    "B18_mix": _mix,
    "B19_borrowed": lambda s, b: T.borrowed(_referenced(s, b), "reference", "default").select("media_id", "seg_id", "reference", "borrowed"),
    "B20_reference_chain": _chain,
    "B21_B22_checks": lambda s, b: T.media_checks(table(s, b, "segments", ["media_id", "speaker_id", "text"])),
    "B23_single_speaker": _stub,
    "B24_projection": _projection,
}

_T = """
WITH t AS (SELECT *, CAST(round(start_s * 1000) AS BIGINT) AS start_ms, CAST(round(end_s * 1000) AS BIGINT) AS end_ms FROM segments
           WHERE media_id IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s)),
l AS (SELECT * FROM t WHERE end_ms > start_ms)"""
_W = "(PARTITION BY media_id ORDER BY start_ms, seg_idx, seg_id)"
_RW = "(PARTITION BY media_id ORDER BY start_ms, seg_idx, seg_id ROWS UNBOUNDED PRECEDING)"
_REGIONS = """
rm AS (SELECT media_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, seg_id FROM l),
ri AS (SELECT *, sum(CASE WHEN prev IS NULL OR start_ms - prev > 350 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, seg_id ROWS UNBOUNDED PRECEDING) AS island FROM rm),
r AS (SELECT media_id, min(start_ms) AS r_start, max(end_ms) AS r_end FROM ri GROUP BY media_id, island HAVING max(end_ms) - min(start_ms) >= 400)"""
_REF = "CASE WHEN end_ms - start_ms >= 1500 THEN 'line-' || seg_id ELSE 'default' END"
_INPUT = f"""p0 AS (SELECT media_id, seg_id, seg_idx, start_ms, end_ms, round(coalesce(length(translated_text), 0) * {_PACE}, 3) AS n,
  coalesce(lead(start_ms) OVER {_W}, max(end_ms) OVER (PARTITION BY media_id)) AS due, row_number() OVER {_W} AS rn FROM l)"""
_RECURSIVE = _T.replace("WITH t", "WITH RECURSIVE t") + ", " + _INPUT + """,
s AS (SELECT p0.*, start_ms / 1000 AS want, (end_ms - start_ms) / 1000 AS slot FROM p0),
f AS (
  SELECT media_id, seg_id, rn, start_ms, planned_start, speed, n / speed AS spoken FROM (
    SELECT *, CASE WHEN abs(sp - 1.0) < 0.02 THEN 1.0 ELSE sp END AS speed FROM (
      SELECT *, CASE WHEN n <= 0 THEN 1.0 WHEN free <= 0 THEN cap WHEN n > free THEN least(cap, n / free) WHEN slot > 0 AND n < slot * 0.85 THEN greatest(0.9, n / slot) ELSE 1.0 END AS sp FROM (
        SELECT *, CASE WHEN planned_start - want > 0.3 OR n / 1.25 - greatest(free, 0.0) > 0.3 THEN 1.4 ELSE 1.25 END AS cap FROM (
          SELECT *, due / 1000 - planned_start AS free FROM (SELECT *, want AS planned_start FROM s WHERE rn = 1)))))
  UNION ALL
  SELECT media_id, seg_id, rn, start_ms, planned_start, speed, n / speed AS spoken FROM (
    SELECT *, CASE WHEN abs(sp - 1.0) < 0.02 THEN 1.0 ELSE sp END AS speed FROM (
      SELECT *, CASE WHEN n <= 0 THEN 1.0 WHEN free <= 0 THEN cap WHEN n > free THEN least(cap, n / free) WHEN slot > 0 AND n < slot * 0.85 THEN greatest(0.9, n / slot) ELSE 1.0 END AS sp FROM (
        SELECT *, CASE WHEN planned_start - want > 0.3 OR n / 1.25 - greatest(free, 0.0) > 0.3 THEN 1.4 ELSE 1.25 END AS cap FROM (
          SELECT *, due / 1000 - planned_start AS free FROM (
            SELECT s.*, greatest(s.want, f.planned_start + f.spoken + 0.08) AS planned_start FROM f JOIN s ON s.media_id = f.media_id AND s.rn = f.rn + 1))))))
"""

SQL = {
    "B1_B2_speaker_at": f"""{_T},
p AS (SELECT media_id, seg_id, (start_ms + end_ms) / 2 AS middle FROM l WHERE speaker_id IS NULL),
u AS (SELECT media_id, start_ms, end_ms, seg_idx, seg_id AS turn_id, speaker_id FROM l WHERE speaker_id IS NOT NULL),
j AS (SELECT p.*, u.speaker_id, row_number() OVER (PARTITION BY p.seg_id ORDER BY
        CASE WHEN u.start_ms <= middle AND middle < u.end_ms THEN 0 ELSE 1 END,
        CASE WHEN u.start_ms <= middle AND middle < u.end_ms THEN 0 ELSE least(abs(u.start_ms - middle), abs(u.end_ms - middle)) END,
        u.start_ms, u.seg_idx, u.turn_id) AS rn FROM p LEFT JOIN u ON u.media_id = p.media_id)
SELECT media_id, seg_id, middle, coalesce(speaker_id, 'SPEAKER_00') AS speaker FROM j WHERE rn = 1""",
    "B3_sentences": f"""{_T},
w AS (SELECT media_id, start_ms, seg_idx, seg_id, speaker_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM l),
x AS (SELECT media_id, start_ms AS seg_start, seg_idx, seg_id, i, speaker_id, word.text AS txt, CAST(round(word.start_s * 1000) AS BIGINT) AS ws, CAST(round(word.end_s * 1000) AS BIGINT) AS we FROM w
      WHERE word.text IS NOT NULL AND word.start_s IS NOT NULL AND word.end_s IS NOT NULL AND NOT isnan(word.start_s) AND NOT isnan(word.end_s)),
y AS (SELECT *, regexp_matches(regexp_replace(txt, '\\s+$', ''), '[.!?。！？؟]$') AS ends FROM x),
z AS (SELECT *, CASE WHEN lag(i) OVER v IS NULL OR speaker_id IS DISTINCT FROM lag(speaker_id) OVER v OR lag(ends) OVER v THEN 1 ELSE 0 END AS fresh FROM y WINDOW v AS (PARTITION BY media_id ORDER BY seg_start, seg_idx, seg_id, i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY seg_start, seg_idx, seg_id, i ROWS UNBOUNDED PRECEDING) AS run FROM z)
SELECT media_id, CAST(run AS INT) AS sentence, first(ws ORDER BY seg_start, seg_idx, seg_id, i) AS start_ms, last(we ORDER BY seg_start, seg_idx, seg_id, i) AS end_ms, first(speaker_id ORDER BY seg_start, seg_idx, seg_id, i) AS speaker_id,
  trim(string_agg(txt, ' ' ORDER BY seg_start, seg_idx, seg_id, i)) AS text, CAST(count(*) AS INT) AS n_words FROM g GROUP BY media_id, run""",
    "B5_speech_runs": """
WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, value > 30 AS s FROM events),
g AS (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS run FROM f WHERE s)
SELECT user_id, CAST(min(frame) AS INT) AS first_frame, CAST(max(frame) AS INT) AS last_frame FROM g GROUP BY user_id, run""",
    "B6_speech_regions": f"{_T}, {_REGIONS} SELECT media_id, r_start AS start_ms, r_end AS end_ms FROM r",
    "B7_identified_regions": f"""{_T}, {_REGIONS},
w AS (SELECT DISTINCT media_id, start_ms AS w_start, end_ms AS w_end, speaker_id AS label, (start_ms + end_ms) / 2 AS centre FROM l WHERE speaker_id IS NOT NULL),
p AS (SELECT r.media_id, r_start, r_end, w_start, w_end, label, centre FROM r JOIN w ON w.media_id = r.media_id AND w_end > r_start AND w_start < r_end),
c AS (SELECT *, CASE WHEN lag(label) OVER v IS NULL THEN r_start WHEN lag(label) OVER v <> label THEN (lag(centre) OVER v + centre) / 2 END AS cut FROM p WINDOW v AS (PARTITION BY media_id, r_start ORDER BY w_start, w_end, label)),
d AS (SELECT *, coalesce(lead(cut) OVER (PARTITION BY media_id, r_start ORDER BY w_start, w_end, label), r_end) AS upto FROM c WHERE cut IS NOT NULL),
e AS (SELECT media_id, CAST(cut AS DOUBLE) AS start_ms, CAST(upto AS DOUBLE) AS end_ms, label FROM d WHERE upto - cut >= 400
  UNION ALL SELECT media_id, r_start, r_end, coalesce(label, '') FROM (
    SELECT r.media_id, r_start, r_end, label, row_number() OVER (PARTITION BY r.media_id, r_start ORDER BY abs(centre - (r_start + r_end) / 2), w_start, w_end, label) AS rn
    FROM r LEFT JOIN w ON w.media_id = r.media_id WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.media_id = r.media_id AND p.r_start = r.r_start)) WHERE rn = 1),
n AS (SELECT media_id, label, row_number() OVER (PARTITION BY media_id ORDER BY min(start_ms), label) - 1 AS k FROM e GROUP BY media_id, label)
SELECT e.media_id, start_ms, end_ms, 'SPEAKER_' || printf('%02d', k) AS speaker_id FROM e JOIN n ON n.media_id = e.media_id AND n.label = e.label""",
    "B8_covered_windows": """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS media_id, epoch_ms(ts) AS ms, value > 30 AS s FROM events),
w AS (SELECT DISTINCT media_id, CAST(floor(ms / 21600000.0) AS BIGINT) * 21600000 AS w_start FROM e)
SELECT w.media_id, w_start, w_start + 21600000 AS w_end, round(avg(CAST(s AS DOUBLE)), 6) AS coverage, count(*) AS n_frames
FROM w JOIN e ON e.media_id = w.media_id AND ms >= w_start AND ms < w_start + 21600000 GROUP BY 1, 2 HAVING avg(CAST(s AS DOUBLE)) >= 0.5""",
    "B9_words_in_clips": f"""{_T},
c AS (SELECT media_id, speaker_id, start_ms AS clip_start, end_ms AS clip_end FROM (SELECT *, row_number() OVER (PARTITION BY media_id, speaker_id ORDER BY end_ms - start_ms DESC, start_ms, seg_id) AS rn FROM l WHERE speaker_id IS NOT NULL) WHERE rn = 1),
w AS (SELECT media_id, start_ms, seg_idx, seg_id, speaker_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM l),
x AS (SELECT *, word.text AS txt, CAST(round(word.start_s * 1000) AS BIGINT) AS ws, CAST(round(word.end_s * 1000) AS BIGINT) AS we FROM w WHERE word.text IS NOT NULL AND word.start_s IS NOT NULL AND word.end_s IS NOT NULL)
SELECT c.media_id, c.speaker_id, clip_start, clip_end, coalesce(string_agg(txt, ' ' ORDER BY start_ms, seg_idx, seg_id, i), '') AS text
FROM c LEFT JOIN x ON x.media_id = c.media_id AND x.speaker_id = c.speaker_id AND ws < clip_end AND we > clip_start GROUP BY 1, 2, 3, 4""",
    "B10_speaker_bounds": f"""{_T},
c AS (SELECT *, CASE WHEN row_number() OVER {_W} = 1 OR speaker_id IS DISTINCT FROM lag(speaker_id) OVER {_W} THEN 1 ELSE 0 END AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER {_RW} AS run FROM c)
SELECT media_id, seg_id, first_value(start_ms) OVER v AS run_start, last_value(end_ms) OVER v AS run_end FROM g
WINDOW v AS (PARTITION BY media_id, run ORDER BY start_ms, seg_idx, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "B11_B17_placement": f"""{_T},
c AS (SELECT *, coalesce(CAST(round(placed_start * 1000) AS BIGINT), start_ms) AS want, coalesce(sum(end_ms - start_ms + {_GAP}) OVER (PARTITION BY media_id ORDER BY start_ms, seg_idx, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l),
p AS (SELECT media_id, seg_id, CAST(used + max(want - used) OVER {_RW} AS BIGINT) AS placed_ms FROM c)
SELECT media_id, seg_id, placed_ms, placed_ms * 24 AS sample FROM p""",
    "B12_B13_B14_speeds": f"""{_T}, {_INPUT},
a AS (SELECT *, (due - start_ms) / 1000 AS room, (end_ms - start_ms) / 1000 AS slot FROM p0),
b AS (SELECT *, CASE WHEN n / 1.25 - greatest(room, 0.0) > 0.3 THEN 1.4 ELSE 1.25 END AS cap FROM a)
SELECT media_id, seg_id, round(room, 6) AS room_s, CAST(cap AS DOUBLE) AS cap, CAST(round(CASE WHEN n <= 0 THEN 1.0 WHEN room <= 0 THEN cap WHEN n > room THEN least(cap, n / room) WHEN slot > 0 AND n < slot * 0.85 THEN greatest(0.9, n / slot) ELSE 1.0 END, 6) AS DOUBLE) AS speed FROM b""",
    "B15_plan": _RECURSIVE + " SELECT media_id, seg_id, round(planned_start, 6) AS planned_start, CAST(round(speed, 6) AS DOUBLE) AS speed, round(spoken, 6) AS spoken FROM f",
    "B16_lateness": _RECURSIVE + " SELECT media_id, count(*) AS n_lines, count(*) FILTER (planned_start - start_ms / 1000 > 0.05) AS n_late, round(coalesce(max(planned_start - start_ms / 1000) FILTER (planned_start - start_ms / 1000 > 0.05), 0.0), 6) AS worst_delay FROM f GROUP BY media_id",
    "B18_mix": f"""{_T},
c AS (SELECT *, end_ms - start_ms AS n, max(end_ms) OVER (PARTITION BY media_id) AS track, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seg_idx, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l),
p AS (SELECT media_id, n, track, CAST(used + max(start_ms - used) OVER {_RW} AS BIGINT) AS pos FROM c),
z AS (SELECT media_id, max(greatest(track, pos + n)) AS fin FROM p GROUP BY 1),
fr AS (SELECT media_id, unnest(generate_series(0, CAST(floor((fin - 1) / 1000) AS BIGINT))) AS frame FROM z),
so AS (SELECT media_id, unnest(generate_series(CAST(floor(pos / 1000) AS BIGINT), CAST(floor((pos + n - 1) / 1000) AS BIGINT))) AS frame FROM p),
v AS (SELECT media_id, frame, count(*) * 0.2 AS voice FROM so GROUP BY 1, 2),
m AS (SELECT fr.media_id, fr.frame, 0.1 + coalesce(voice, 0.0) AS mixed FROM fr LEFT JOIN v ON v.media_id = fr.media_id AND v.frame = fr.frame)
SELECT media_id, frame, CAST(round(CASE WHEN peak > 0.98 THEN mixed * 0.98 / peak ELSE mixed END, 6) AS DOUBLE) AS mixed FROM (SELECT *, max(mixed) OVER (PARTITION BY media_id) AS peak FROM m)""",
    "B19_borrowed": f"""{_T},
a AS (SELECT *, {_REF} AS ref FROM l),
j AS (SELECT a.media_id, a.seg_id, a.ref, d.ref AS other, row_number() OVER (PARTITION BY a.seg_id ORDER BY abs(d.start_ms - a.start_ms), d.start_ms, d.seg_idx, d.seg_id) AS rn
      FROM a LEFT JOIN a d ON d.media_id = a.media_id AND d.ref <> 'default' AND a.ref = 'default')
SELECT media_id, seg_id, ref AS reference, coalesce(other, ref) AS borrowed FROM j WHERE rn = 1""",
    "B20_reference_chain": f"""{_T},
s AS (SELECT media_id, speaker_id, max(end_ms - start_ms) AS longest, sum(end_ms - start_ms) AS total FROM l WHERE speaker_id IS NOT NULL GROUP BY 1, 2),
a AS (SELECT l.media_id, l.seg_id, l.seg_idx, l.start_ms, CASE WHEN longest >= 4000 THEN 'clip-' || l.speaker_id WHEN total >= 600 THEN 'montage-' || l.speaker_id ELSE {_REF} END AS ref
      FROM l LEFT JOIN s ON s.media_id = l.media_id AND s.speaker_id = l.speaker_id),
j AS (SELECT a.media_id, a.seg_id, a.ref, d.ref AS other, row_number() OVER (PARTITION BY a.seg_id ORDER BY abs(d.start_ms - a.start_ms), d.start_ms, d.seg_idx, d.seg_id) AS rn
      FROM a LEFT JOIN a d ON d.media_id = a.media_id AND d.ref <> 'default' AND a.ref = 'default')
SELECT media_id, seg_id, coalesce(other, ref) AS reference FROM j WHERE rn = 1""",
    "B21_B22_checks": "SELECT media_id, count(DISTINCT speaker_id) AS n_speakers, count(DISTINCT speaker_id) > 12 AS too_many, coalesce(bool_or(regexp_matches(text, '[^\\s\\x{a0}\\x{3000}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}]')), false) AS has_speech FROM segments GROUP BY media_id",
    "B23_single_speaker": "SELECT id AS media_id, 0.0::DOUBLE AS start_s, CAST(duration AS DOUBLE) AS end_s, 'SPEAKER_00' AS speaker_id FROM episodes WHERE duration > 0",
    "B24_projection": """
SELECT media_id, seg_id, speaker_id AS speaker, CAST(printf('%.2f', start_s) AS DOUBLE) AS start_at, CAST(printf('%.2f', end_s) AS DOUBLE) AS end_at, text AS original, translated_text AS translated,
  printf('line-%03d.wav', row_number() OVER (PARTITION BY media_id ORDER BY start_s, seg_idx, seg_id)) AS audio
FROM segments WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s)""",
}
#: The fold of a run of words that is too long, word by word: where the next part begins, and the last word that was looked at.
_PARTS = """,
x0 AS (SELECT *, row_number() OVER (PARTITION BY media_id, run ORDER BY seg_start, seg_idx, seg_id, i) - 1 AS k FROM g),
x1 AS (SELECT media_id, run, k, ws, we, txt, speaker_id, ends, max(k) OVER (PARTITION BY media_id, run) AS last, ws - lag(we) OVER (PARTITION BY media_id, run ORDER BY k) AS gap FROM x0),
c AS (
  SELECT DISTINCT media_id, run, CAST(0 AS BIGINT) AS first, CAST(-1 AS BIGINT) AS seen FROM x1
  UNION ALL
  SELECT h.media_id, h.run, h.first + greatest(1, coalesce(arg_max(n.k - h.first, n.gap * 1000000 + n.k) FILTER (n.k > h.first AND n.gap >= 150), min(n.k - h.first) FILTER (n.we - h.from_ws >= 12000))) AS first, h.stop AS seen
  FROM (SELECT c.media_id, c.run, c.first, s.ws AS from_ws, min(w.k) AS stop FROM c JOIN x1 s ON s.media_id = c.media_id AND s.run = c.run AND s.k = c.first
        JOIN x1 w ON w.media_id = c.media_id AND w.run = c.run AND w.k > c.seen AND w.k >= c.first AND w.we - s.ws > 12000 AND NOT (w.ends AND w.k = w.last) GROUP BY 1, 2, 3, 4) h
  JOIN x1 n ON n.media_id = h.media_id AND n.run = h.run AND n.k >= h.first AND n.k <= h.stop GROUP BY h.media_id, h.run, h.first, h.stop),
b AS (SELECT DISTINCT media_id, run, first FROM c),
p AS (SELECT x1.*, max(b.first) AS part FROM x1 JOIN b ON b.media_id = x1.media_id AND b.run = x1.run AND b.first <= x1.k GROUP BY ALL)
SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY run, part) AS INT) AS sentence, first(ws ORDER BY k) AS start_ms, last(we ORDER BY k) AS end_ms, first(speaker_id ORDER BY k) AS speaker_id,
  trim(string_agg(txt, ' ' ORDER BY k)) AS text, CAST(count(*) AS INT) AS n_words FROM p GROUP BY media_id, run, part"""
_RUNS = SQL["B3_sentences"]
SQL["B3_B4_sentences_forced"] = _RUNS[: _RUNS.index("\nSELECT media_id, CAST(run AS INT)")].replace("WITH t", "WITH RECURSIVE t") + _PARTS
