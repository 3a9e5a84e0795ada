"""Queries over signals: the values of each user's events in order of time are its samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators import signals as S
from loomline.operators import timeline as T
from loomline.operators.scan import counted
from loomline.session import stored
from loomline.sources.tables import spread, table

_FRAME, _LINE, _RATE = 5, 20, 250


def _signal(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events", ["event_id", "user_id", "ts", "value"])
    rows = counted(e, "user_id", ["ts", "event_id"], "n", first=0)
    return rows.select(F.col("user_id").alias("media_id"), "n", ((F.col("value") - 30) / 500).alias("x"))


def _lines(spark: SparkSession, base: str) -> DataFrame:
    """Twenty samples are a line; its pitch is that of its sign changes, for want of a tracker."""
    s = _signal(spark, base).withColumn("line", F.floor(F.col("n") / _LINE))
    w = Window.partitionBy("media_id", "line").orderBy("n")
    s = s.withColumn("turn", (F.signum("x") != F.lag(F.signum("x")).over(w)).cast("int"))
    signs = F.element_at(F.array(*map(F.lit, ("Stop!", "Why?", "Is it so that we go there now?", "Go on.", ""))), (F.col("line") % 5 + 1).cast("int"))
    per = s.groupBy("media_id", "line").agg(S.rms(F.col("x")).alias("level"), F.coalesce(F.avg("turn"), F.lit(0.0)).alias("pitch"), F.count(F.lit(1)).alias("n_samples"))
    return per.withColumns({"speaker_id": F.concat(F.lit("S"), (F.col("line") % 2).cast("string")), "text": signs})


def _rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _levels(spark: SparkSession, base: str) -> DataFrame:
    s = _signal(spark, base)
    whole = s.groupBy("media_id").agg(S.rms(F.col("x")).alias("level"))
    return _rounded(whole.join(S.active_rms(S.frames(s, _FRAME)), "media_id", "left"), "level", "active")


def _targets(spark: SparkSession, base: str) -> DataFrame:
    rows = S.targets(stored(_lines(spark, base)))
    return _rounded(rows.select("media_id", "line", "target", "intensity_db", "effort_db"), "target", "intensity_db", "effort_db", digits=6)


def _gains(spark: SparkSession, base: str) -> DataFrame:
    rows = S.deliveries(stored(_lines(spark, base)))
    return rows.select("media_id", "line", "delivery", F.round(S.preset_gain(F.col("level"), F.col("delivery")), 6).alias("gain"))


def _takes(spark: SparkSession, base: str) -> DataFrame:
    """Three neighbouring lines are three takes of one."""
    rows = _lines(spark, base).withColumns({"item": F.floor(F.col("line") / 3), "attempt": (F.col("line") % 3 + 1).cast("int")})
    takes = rows.select("media_id", "item", "attempt", F.round("level", 9).alias("level"), F.round(F.col("pitch") / 4, 9).alias("voiced"), F.lit("happy").alias("preset"))
    return S.chosen_takes(takes, ["media_id", "item"])


def _ranges(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(S.dynamic_range(S.frames(_signal(spark, base), _FRAME), ["media_id"]), "dynamic_range", digits=6)


def _scores(spark: SparkSession, base: str) -> DataFrame:
    samples = _signal(spark, base).withColumn("line", F.floor(F.col("n") / _LINE)).withColumn("k", F.col("n") % _LINE)
    return _rounded(S.clip_scores(samples, ["media_id", "line"], _FRAME).select("media_id", "line", "score"), "score", digits=6)


def _best(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(S.best_windows(_signal(spark, base), 40, 5, 20, _FRAME), "score", digits=6)


def _references(spark: SparkSession, base: str) -> DataFrame:
    """Best window of each signal, from the raw signal where the background (a tenth of the level) allows it."""
    best = S.best_windows(_signal(spark, base), 40, 5, 20, _FRAME)
    inside = _signal(spark, base).join(best, "media_id").where((F.col("n") >= F.col("offset")) & (F.col("n") < F.col("offset") + F.col("n_samples")))
    per = inside.groupBy("media_id", "offset", "n_samples").agg(S.rms(F.col("x")).alias("vocal"), S.rms(F.col("x") * F.when(F.col("n") % 7 == 0, 0.5).otherwise(0.0)).alias("background"), F.avg((F.abs("x") > 0.02).cast("double")).alias("voiced"))
    return per.where("voiced >= 0.3").select("media_id", "offset", "n_samples", ((F.col("vocal") > 0) & (F.col("background") < 0.1 * F.col("vocal"))).alias("from_raw"))


def _timed(spark: SparkSession, base: str) -> DataFrame:
    return T.timeline(table(spark, base, "segments", ["media_id", "seg_id", "seg_idx", "start_s", "end_s", "speaker_id", "text"]))


def _widened(spark: SparkSession, base: str) -> DataFrame:
    rows = T.speaker_bounds(_timed(spark, base))
    span = S.widened(F.col("start_ms"), F.col("end_ms"), F.col("run_start"), F.col("run_end"), 1500, 10_000)
    return rows.select("media_id", "seg_id", span["first"].alias("first"), span["stop"].alias("stop"))


def _montages(spark: SparkSession, base: str) -> DataFrame:
    lines = _timed(spark, base).where("speaker_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    return S.montage(lines, F.col("end_ms") - F.col("start_ms"), 10_000, 600, 80)


def _stretches(spark: SparkSession, base: str) -> DataFrame:
    t = table(spark, base, "segments", ["seg_id", "start_s", "end_s", "translated_text"])
    return t.select("seg_id", F.round(S.stretch_ratio(F.col("end_s") - F.col("start_s"), F.length("translated_text") * 0.06, 0.8, 1.25), 6).alias("ratio"))


def _mono(spark: SparkSession, base: str) -> DataFrame:
    s = S.normalized(_signal(spark, base))
    return s.select("media_id", "n", F.round(S.downmixed(F.array("x", F.col("x") * 0.5)), 9).alias("x"))


def _slices(spark: SparkSession, base: str) -> DataFrame:
    lines = _timed(spark, base)
    rows = lines.join(lines.groupBy("media_id").agg(F.floor(F.max("end_ms") * 8).alias("length")), "media_id")
    span = S.sample_bounds(F.col("start_ms") / 1000, F.col("end_ms") / 1000, 8000, F.col("length"))
    return rows.select("media_id", "seg_id", span["first"].alias("first"), span["stop"].alias("stop"))


def _tones(spark: SparkSession, base: str) -> DataFrame:
    """A tone for each line: 0.4 s of 100, 200 or 300 Hz in four strengths, silence where nothing is said."""
    t = spread(table(spark, base, "segments", ["media_id", "seg_id", "speaker_id", "text"]))
    hz, loud = (F.col("seg_id") % 3 + 1) * 100, F.when(F.col("text").rlike(r"(?U)\S"), (F.col("seg_id") % 4 + 1) * 0.05).otherwise(F.lit(0.0))
    wave = F.transform(F.sequence(F.lit(0), F.lit(1599)), lambda n: loud * F.sin(2 * math.pi * hz * n / 4000))
    return t.withColumns({"hz": hz, "line": F.col("seg_id"), "samples": wave})


def _pitches(spark: SparkSession, base: str) -> DataFrame:
    """Of each line's tone: whether the tracker hears a voice all along, and its pitch within a hundredth."""
    tones = _tones(spark, base)
    heard = S.pitched(tones, 4000).join(tones.select("line", "hz"), "line")
    return heard.select(F.col("line").alias("seg_id"), F.col("hz").cast("int").alias("hz"), (F.col("voiced") > 0.95).alias("is_voiced"), (F.abs(F.col("pitch") - F.col("hz")) < F.col("hz") / 100).alias("is_found"), F.round("level", 6).alias("level"))


def _tracked(spark: SparkSession, base: str) -> DataFrame:
    """Deliveries of lines from their tracked pitch."""
    tones = _tones(spark, base)
    heard = stored(S.pitched(tones, 4000).drop("media_id").withColumns({"pitch": F.round("pitch"), "level": F.round("level", 6)}))
    return S.deliveries(heard.join(tones.select("line", "media_id", "speaker_id", "text"), "line")).select(F.col("line").alias("seg_id"), "delivery")


def _mastered(spark: SparkSession, base: str) -> DataFrame:
    s = _signal(spark, base).withColumn("line", F.floor(F.col("n") / 200))
    arrays = s.groupBy("media_id", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda v: v["x"]).alias("samples"), S.rms(F.col("x")).alias("level"))
    rows = S.targets(arrays)
    return S.mastered(rows, _RATE).select("media_id", "line", F.round("active", 6).alias("active"), F.round("peak", 6).alias("peak"), F.size("samples").alias("n_samples"))


QUERIES = {
    "D1_slices": _slices,
    "D2_D3_levels": _levels,
    "D4_D5_D6_targets": _targets,
    "D7_D12_D13_deliveries": _gains,
    "D8_D9_D10_mastered": _mastered,
    "D11_pitch": _pitches,
    "D11_D12_tracked": _tracked,
    "D14_D22_takes": _takes,
    "D15_dynamic_range": _ranges,
    "D16_clip_scores": _scores,
    "D17_best_windows": _best,
    "D18_references": _references,
    "D19_widened": _widened,
    "D20_montages": _montages,
    "D21_stretch_ratio": _stretches,
    "D23_D24_mono": _mono,
}

_SIG = "s AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, (value - 30) / 500 AS x FROM events)"
_LN = f"""{_SIG},
tn AS (SELECT *, n // {_LINE} AS line, CAST(sign(x) <> lag(sign(x)) OVER (PARTITION BY media_id, n // {_LINE} ORDER BY n) AS INT) AS turn FROM s),
ln AS (SELECT media_id, line, sqrt(avg(x * x)) AS level, coalesce(avg(turn), 0.0) AS pitch, 'S' || (line % 2) AS speaker_id, ['Stop!', 'Why?', 'Is it so that we go there now?', 'Go on.', ''][line % 5 + 1] AS text FROM tn GROUP BY media_id, line)"""
_TGT = f"""{_LN},
sc AS (SELECT media_id, median(level) AS scene FROM ln WHERE level > 1e-5 GROUP BY 1),
tg AS (SELECT ln.*, CASE WHEN level > 1e-5 THEN greatest(least(level, scene * 3.0::DOUBLE), scene * 0.35::DOUBLE) END AS target FROM ln LEFT JOIN sc USING (media_id)),
md AS (SELECT media_id, median(target) AS mid FROM tg WHERE target IS NOT NULL GROUP BY 1),
db AS (SELECT tg.*, CASE WHEN target IS NOT NULL AND mid > 0 THEN 20 * log10(target / mid) ELSE 0.0 END AS db FROM tg LEFT JOIN md USING (media_id))"""
_LOUD = "CASE WHEN level > 1e-4 THEN level END"
_SPREAD = f"coalesce(CASE WHEN count(level) >= 2 AND count({_LOUD}) >= 2 THEN stddev_pop({_LOUD}) / avg({_LOUD}) END, 0.0)"
_SCORED = f"""
ff AS (SELECT media_id, grp, k // {_FRAME} AS f, sum(x * x) AS ss, count(*) AS c, count(*) FILTER (abs(x) < 0.01) AS q, max(abs(x)) AS p, CASE WHEN count(*) = {_FRAME} THEN sqrt(sum(x * x) / count(*)) END AS level FROM k GROUP BY 1, 2, 3),
sd AS (SELECT media_id, grp, max(p) AS peak, sum(c) AS n_samples, sqrt(sum(ss) / sum(c)) * (1 - sum(q) / sum(c)) * (1 + {_SPREAD}) AS score FROM ff GROUP BY 1, 2)"""
_BEST = f"""{_SIG},
le AS (SELECT media_id, max(n) + 1 AS len FROM s GROUP BY 1 HAVING max(n) + 1 >= 20),
wn AS (SELECT media_id, least(40, len) AS size, unnest(generate_series(0, (len - least(40, len)) // 5 * 5, 5)) AS grp FROM le),
k AS (SELECT wn.media_id, wn.grp, s.n - wn.grp AS k, s.x FROM wn JOIN s ON s.media_id = wn.media_id AND s.n >= wn.grp AND s.n < wn.grp + wn.size), {_SCORED},
be AS (SELECT media_id, grp AS "offset", n_samples, score, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, grp) AS rn FROM sd WHERE peak <= 0.99)"""
_L = """
t AS (SELECT *, CAST(round(start_s * 1000) AS BIGINT) AS start_ms, CAST(round(end_s * 1000) AS BIGINT) AS end_ms FROM segments WHERE media_id IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s)),
l AS (SELECT * FROM t WHERE end_ms > start_ms)"""
_O = "PARTITION BY media_id ORDER BY start_ms, seg_idx, seg_id"
_SIGNS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOLD = f"len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> ''))"
_TONES = f"tn AS (SELECT *, (seg_id % 3 + 1) * 100 AS hz, CASE WHEN regexp_matches(coalesce(text, ''), '[^{_SPACE[1:-1]}]') THEN round((seg_id % 4 + 1) * 0.05::DOUBLE / sqrt(2), 6) ELSE 0.0 END AS level FROM segments)"

SQL = {
    "D1_slices": f"WITH {_L} SELECT media_id, seg_id, CAST(greatest(0, floor(start_ms / 1000 * 8000)) AS BIGINT) AS first, CAST(least(max(end_ms) OVER (PARTITION BY media_id) * 8, floor(end_ms / 1000 * 8000)) AS BIGINT) AS stop FROM l",
    "D2_D3_levels": f"""WITH {_SIG},
w AS (SELECT media_id, sqrt(avg(x * x)) AS level FROM s GROUP BY 1),
f AS (SELECT media_id, n // {_FRAME} AS f, sqrt(avg(x * x)) AS lv FROM s GROUP BY 1, 2 HAVING count(*) = {_FRAME}),
m AS (SELECT *, max(lv) OVER (PARTITION BY media_id) AS top FROM f),
a AS (SELECT media_id, sqrt(avg(lv * lv)) AS active FROM m WHERE lv >= top * pow(10, -1.5) GROUP BY 1)
SELECT media_id, round(level, 9) AS level, round(active, 9) AS active FROM w LEFT JOIN a USING (media_id)""",
    "D4_D5_D6_targets": f"WITH {_TGT} SELECT media_id, line, round(target, 6) AS target, round(db, 6) AS intensity_db, round(greatest(0.0, least(1.0, (db - 2.5) / 3.5)) * 6.0, 6) AS effort_db FROM db",
    "D7_D12_D13_deliveries": f"""WITH {_LN},
sc AS (SELECT media_id, median(level) AS scene FROM ln WHERE level > 0 GROUP BY 1),
vo AS (SELECT media_id, speaker_id, median(pitch) AS mp, count(*) AS c FROM ln WHERE pitch > 0 GROUP BY 1, 2),
r AS (SELECT ln.*, level / scene AS e, scene, CASE WHEN pitch > 0 AND c >= 3 THEN pitch / mp END AS pr, contains(text, '!') AS sh, contains(text, '?') AS qu, {_SIGNS} AS words FROM ln LEFT JOIN sc USING (media_id) LEFT JOIN vo USING (media_id, speaker_id)),
d AS (SELECT *, CASE WHEN level > 1e-4 AND scene > 0 THEN CASE WHEN e > 1.7 AND coalesce(pr > 1.4, false) THEN 'surprised' WHEN e > 1.7 THEN 'angry' WHEN sh THEN 'happy' WHEN qu AND (e >= 0.9 OR words <= 5) THEN 'surprised'
  WHEN e < 0.45 AND NOT qu THEN 'whispers' WHEN e > 1.35 THEN 'angry' WHEN e < 0.6 AND coalesce(pr < 0.85, false) THEN 'sad' ELSE 'calm' END END AS delivery FROM r)
SELECT media_id, line, delivery, CAST(round(CASE WHEN level > 1e-6 THEN least(CASE delivery {" ".join(f"WHEN '{k}' THEN {v}" for k, v in S.PRESET_LEVELS.items())} ELSE 0.1 END / level, 6.0) ELSE 1.0 END, 6) AS DOUBLE) AS gain FROM d""",
    "D11_pitch": f"WITH {_TONES} SELECT seg_id, CAST(hz AS INT) AS hz, level > 0 AS is_voiced, level > 0 AS is_found, level FROM tn",
    "D11_D12_tracked": f"""WITH {_TONES},
ln AS (SELECT seg_id, media_id, speaker_id, coalesce(text, '') AS text, level, CASE WHEN level > 0 THEN hz ELSE 0 END AS pitch FROM tn),
sc AS (SELECT media_id, median(level) AS scene FROM ln WHERE level > 0 GROUP BY 1),
vo AS (SELECT media_id, speaker_id, median(pitch) AS mp, count(*) AS c FROM ln WHERE pitch > 0 GROUP BY 1, 2),
r AS (SELECT ln.*, level / scene AS e, scene, CASE WHEN pitch > 0 AND c >= 3 THEN pitch / mp END AS pr, regexp_matches(text, '[!！¡]') AS sh, regexp_matches(text, '[?？¿]') AS qu, {_TOLD} AS words
  FROM ln LEFT JOIN sc ON sc.media_id = ln.media_id LEFT JOIN vo ON vo.media_id = ln.media_id AND vo.speaker_id IS NOT DISTINCT FROM ln.speaker_id)
SELECT seg_id, CASE WHEN level > 1e-4 AND scene > 0 THEN CASE WHEN e > 1.7 AND coalesce(pr > 1.4, false) THEN 'surprised' WHEN e > 1.7 THEN 'angry' WHEN sh THEN 'happy' WHEN qu AND (e >= 0.9 OR words <= 5) THEN 'surprised'
  WHEN e < 0.45 AND NOT qu THEN 'whispers' WHEN e > 1.35 THEN 'angry' WHEN e < 0.6 AND coalesce(pr < 0.85, false) THEN 'sad' ELSE 'calm' END END AS delivery FROM r""",
    "D14_D22_takes": f"""WITH {_LN},
t AS (SELECT media_id, line // 3 AS item, CAST(line % 3 + 1 AS INT) AS attempt, round(level, 9) AS level, round(pitch / 4, 9) AS voiced FROM ln),
u AS (SELECT *, level >= 1e-3 AND voiced >= 0.15 AS ok FROM t),
g AS (SELECT media_id, item, min(attempt) FILTER (ok) AS good, max(attempt) AS n FROM u GROUP BY 1, 2),
b AS (SELECT media_id, item, attempt FROM (SELECT *, row_number() OVER (PARTITION BY media_id, item ORDER BY voiced DESC, level DESC, attempt) AS rn FROM u) WHERE rn = 1)
SELECT g.media_id, g.item, coalesce(good, attempt) AS attempt, coalesce(good, n) AS n_asked, good IS NOT NULL AS is_usable FROM g JOIN b ON b.media_id = g.media_id AND b.item = g.item""",
    "D15_dynamic_range": f"WITH {_SIG}, f AS (SELECT media_id, n // {_FRAME} AS f, sqrt(avg(x * x)) AS level FROM s GROUP BY 1, 2 HAVING count(*) = {_FRAME}) SELECT media_id, round({_SPREAD}, 6) AS dynamic_range FROM f GROUP BY 1",
    "D16_clip_scores": f"WITH {_SIG}, k AS (SELECT media_id, n // {_LINE} AS grp, n % {_LINE} AS k, x FROM s), {_SCORED} SELECT media_id, grp AS line, round(score, 6) AS score FROM sd",
    "D17_best_windows": f'WITH {_BEST} SELECT media_id, "offset", CAST(n_samples AS BIGINT) AS n_samples, round(score, 6) AS score FROM be WHERE rn = 1',
    "D18_references": f"""WITH {_BEST}
SELECT be.media_id, be."offset", CAST(be.n_samples AS BIGINT) AS n_samples, sqrt(avg(x * x)) > 0 AND sqrt(avg(pow(x * CASE WHEN s.n % 7 = 0 THEN 0.5 ELSE 0.0 END, 2))) < 0.1 * sqrt(avg(x * x)) AS from_raw
FROM be JOIN s ON s.media_id = be.media_id AND s.n >= be."offset" AND s.n < be."offset" + be.n_samples WHERE rn = 1 GROUP BY 1, 2, 3 HAVING avg(CAST(abs(x) > 0.02 AS DOUBLE)) >= 0.3""",
    "D19_widened": f"""WITH {_L},
c AS (SELECT *, CASE WHEN row_number() OVER ({_O}) = 1 OR speaker_id IS DISTINCT FROM lag(speaker_id) OVER ({_O}) THEN 1 ELSE 0 END AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER ({_O} ROWS UNBOUNDED PRECEDING) AS run FROM c),
r AS (SELECT media_id, seg_id, start_ms, end_ms, first_value(start_ms) OVER v AS lo, last_value(end_ms) OVER v AS hi FROM g WINDOW v AS (PARTITION BY media_id, run ORDER BY start_ms, seg_idx, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT *, end_ms - start_ms < 1500 AS short, greatest(lo, CAST(floor((start_ms + end_ms) / 2) AS BIGINT) - 750) AS a0 FROM r),
b AS (SELECT *, least(hi, a0 + 1500) AS b0 FROM a),
d AS (SELECT *, greatest(lo, b0 - 1500) AS a1 FROM b),
f AS (SELECT *, NOT short OR (hi - lo >= 1500 AND b0 - a1 >= 1500) AS ok, CASE WHEN short THEN a1 ELSE start_ms END AS x, CASE WHEN short THEN b0 ELSE end_ms END AS y FROM d)
SELECT media_id, seg_id, CASE WHEN ok THEN x END AS first, CASE WHEN ok THEN least(y, x + 10000) END AS stop FROM f""",
    "D20_montages": f"""WITH {_L},
b AS (SELECT *, end_ms - start_ms AS len, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY media_id, speaker_id ORDER BY start_ms, seg_idx, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM l WHERE speaker_id IS NOT NULL)
SELECT media_id, speaker_id, count(*) AS n_lines, CAST(sum(len) + (count(*) - 1) * 80 AS BIGINT) AS total, trim(coalesce(string_agg(text, ' ' ORDER BY start_ms, seg_idx, seg_id) FILTER (text IS NOT NULL AND text <> ''), '')) AS text
FROM b WHERE bef < 10000 GROUP BY 1, 2 HAVING sum(len) >= 600""",
    "D21_stretch_ratio": """WITH r AS (SELECT seg_id, end_s - start_s AS t, length(translated_text) * 0.06::DOUBLE AS c FROM segments),
q AS (SELECT *, greatest(0.8::DOUBLE, least(1.25::DOUBLE, t / c)) AS ratio FROM r)
SELECT seg_id, CASE WHEN c > 0 AND t > 0 AND abs(ratio - 1) >= 0.02 THEN round(ratio, 6) ELSE 1.0 END AS ratio FROM q""",
    "D23_D24_mono": f"WITH {_SIG}, p AS (SELECT *, max(abs(x)) OVER (PARTITION BY media_id) AS p FROM s), q AS (SELECT media_id, n, CASE WHEN p > 0 THEN x / p * 0.95::DOUBLE ELSE x END AS y FROM p) SELECT media_id, n, round((y + y * 0.5::DOUBLE) / 2, 9) AS x FROM q",
}
