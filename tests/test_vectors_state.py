import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import external as X
from loomline.operators import state as S
from loomline.operators import vectors as V
from loomline.operators.scan import numbered
from loomline.sources import files as W
from loomline.streaming import live


def test_nearest_against_numpy_with_zero_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[5] = 0
    x[7] = x[9] = x[11]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [])], "id long, v array<double>")
    got = {}
    for r in V.nearest_entries(df.where("id % 10 = 1 OR id = 5"), df, "id", "v", k=3, block=64).collect():
        got.setdefault(r["query_id"], {})[r["place"]] = r["entry_id"]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    for q in [*range(1, 300, 10), 5]:
        sims = np.round(unit @ unit[q], 12)
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-sims[i], i))[:3]
        assert [got[q][k] for k in (1, 2, 3)] == order
    assert V.nearest_entries(df.where("id < 0"), df, "id", "v").count() == 0


def test_cosine_of_zero(spark):
    c = lambda a, b: spark.range(1).select(V.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]
    assert c((0.0, 0.0), (1.0, 0.0)) == 0 and c((1.0, 0.0), (1.0, 1.0)) == pytest.approx(0.5**0.5)


def test_merge_needs_a_strictly_better_score(spark):
    bank = spark.createDataFrame([(1, "old", 0.5), (2, "keep", 0.9)], "voice_id long, text string, score double")
    new = spark.createDataFrame([(11, "a", 0.5), (12, "b", 0.8), (13, "c", 0.95), (14, "d", 0.8)], "voice_id long, text string, score double")
    m = spark.createDataFrame([(11, 1, 0.9), (12, 1, 0.8), (14, 1, 0.8), (13, 2, 0.7)], "query_id long, entry_id long, similarity double")
    got = {r["voice_id"]: (r["text"], r["replaced_by"]) for r in V.merged_bank(bank, new, m, 0.75).collect()}
    assert got == {1: ("b", 12), 2: ("keep", None)}


def test_claims_are_once_a_run(spark):
    c = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3), ("s", 4)], "run string, id long")
    m = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 7, 1), (2, 8, 2), (3, 7, 1), (4, 7, 1)], "query_id long, entry_id long, place int")
    assert {r["id"]: r["entry_id"] for r in V.claimed(c, m, "run", "id").collect()} == {1: 7, 2: 8, 3: None, 4: 7}


def test_new_ids_follow_the_largest(spark):
    new = spark.createDataFrame([(i,) for i in (5, 3, 9)], "k long")
    bank = spark.createDataFrame([("speaker_007",), ("other",), ("speaker_1000",)], "id string")
    assert {r["k"]: r["voice_id"] for r in V.allotted(new, ["k"], F.col("id"), bank).collect()} == {3: "speaker_1001", 5: "speaker_1002", 9: "speaker_1003"}
    assert {r["voice_id"] for r in V.allotted(new, ["k"], F.col("id"), bank.limit(0)).collect()} == {"speaker_001", "speaker_002", "speaker_003"}


def naive(x, stop):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        d, i, j = min((far[np.ix_(a, b)].mean(), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if stop(d, len(groups)):
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(4))
def test_average_linkage_against_a_loop(seed):
    x = np.random.default_rng(seed).normal(size=(30, 4))
    as_sets = lambda labels: {frozenset(np.flatnonzero(labels == c)) for c in set(labels)}
    assert as_sets(V.clusters(x, k=5)) == naive(x, lambda d, n: n <= 5)
    assert as_sets(V.clusters(x, distance=0.4, most=99)) == naive(x, lambda d, n: d >= 0.4)
    assert len(set(V.clusters(x, distance=0.0001, most=12))) == 12
    assert V.clusters(x[:1]).tolist() == [0] and len(V.clusters(x[:0])) == 0


def test_numbering_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = numbered(df, ["k"], "n").collect()
    assert all(r["n"] == r["k"] + 1 for r in got) and len(got) == 1000


D = datetime(2025, 1, 1)
H = "user_id string, episode_id string, series_id string, series_title string, ep_number int, title string, time_s double, duration double, updated_at timestamp, ingested_at timestamp"


def entry(u, e, s, t, d, at, late=0):
    return (u, e, s, "x", 1, None, t, d, D + timedelta(hours=at), D + timedelta(hours=at + late))


def test_progress_and_what_to_continue(spark):
    rows = [entry("u", "1", "s", 5.0, 100.0, 1), entry("u", "1", "s", 50.0, 100.0, 2), entry("u", "1", "s", 50.0, 100.0, 2), entry("u", "2", "s", 99.0, 100.0, 3), entry("u", "3", "r", 9.0, None, 1), entry("u", "4", "q", 9.0, 0.0, 9), entry(None, "1", "s", 1.0, 2.0, 1)]
    h = spark.createDataFrame(rows, H)
    got = {(r["user_id"], r["episode_id"]): (r["time_s"], r["rank"]) for r in S.progress(h).collect()}
    assert got["u", "1"] == (50.0, 3) and got["u", "4"][1] == 1 and len(got) == 5
    assert [r["episode_id"] for r in S.continue_watching(h).where("user_id = 'u'").orderBy("place").collect()] == ["4", "3"]  # the finished newest hides its series
    many = spark.createDataFrame([entry("u", str(i), str(i), 1.0, 9.0, i) for i in range(150)], H)
    assert S.progress(many).count() == 100 and S.continue_watching(many).count() == 12
    assert S.progress(h.limit(0)).count() == 0


def test_changes_by_key(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    assert {tuple(r) for r in S.upserted(t, spark.createDataFrame([("b", 9), ("c", 8)], "k string, v int"), ["k"]).collect()} == {("a", 1), ("b", 9), ("c", 8), (None, 3)}
    new = spark.createDataFrame([("a", 5), ("n", 1), ("n", 2), ("ok", 1)], "k string, v int")
    assert {(r["k"], r["reason"]) for r in S.conflicts(new, t, ["k"]).collect()} == {("a", "taken"), ("n", "twice")}


def test_a_version_is_whole(spark):
    at = S.scratch(spark)
    S.published({"x": spark.range(3), "y": spark.range(1)}, at)
    S.published({"x": spark.range(5), "y": spark.range(2)}, at)
    assert (S.current(spark, at, "x").count(), S.current(spark, at, "y").count()) == (5, 2)


@pytest.mark.parametrize("header,size,suffixes,want", [("bytes=0-2", 6, False, (0, 2, 206)), ("bytes=2-", 6, False, (2, 5, 206)), ("bytes=-2", 6, True, (4, 5, 206)), ("bytes=-2", 6, False, (0, 5, 200)), ("bytes=6-", 6, False, (None, None, 416)), ("bytes=3-1", 6, False, (None, None, 416)), (None, 6, False, (0, 5, 200)), ("bytes=-", 6, True, (0, 5, 200))])
def test_byte_range(spark, header, size, suffixes, want):
    assert tuple(spark.range(1).select(S.byte_range(F.lit(header).cast("string"), F.lit(size).cast("bigint"), suffixes)).first()[0]) == want


def test_stored_history_may_be_broken(spark):
    size = lambda raw: spark.range(1).select(F.size(S.parsed_history(F.lit(raw).cast("string")))).first()[0]
    assert [size(x) for x in (None, "", "{}", "[oops", '[{"episodeId":"a","time":1}]')][:4] in ([0, 0, 0, 0], [0, 0, 0, 1]) and size('[{"episodeId":"a","time":1}]') == 1


def test_registry_and_diarizer_choice():
    r = X.stand_ins()
    with pytest.raises(ValueError, match="tagged"):
        r.get("translator", "other")
    r.preflight({"translator": "tagged"})
    assert X.pick_diarizer("auto", True, ["hosted", "clustering"]) == "hosted" and X.pick_diarizer("auto", True, ["clustering"]) == "clustering"
    with pytest.raises(ValueError):
        X.pick_diarizer("x", False, ["clustering"])


def test_blank_texts_arent_sent(spark):
    df = spark.createDataFrame([(1, " "), (2, None), (3, "Ab")], "i int, t string")
    r = X.stand_ins()
    assert {x["i"]: x["o"] for x in df.select("i", X.translate_column(r, "tagged", F.col("t"), F.lit("en"), "uz").alias("o")).collect()} == {1: "", 2: "", 3: "[en>uz] Ab"}


def test_settings_and_glossary(spark):
    assert W.settings("a: 1\nb: {c: 3}", {"a": 0, "b": {"c": 2, "d": 4}}) == {"a": 1, "b": {"c": 3, "d": 4}}
    with pytest.raises(ValueError):
        W.settings("z: 1", {"a": 0})
    with pytest.raises(ValueError):
        W.glossary(spark, "- a")


def run(spark, df, name, mode, tmp_path):
    q = live.once(df, name, mode, str(tmp_path / "c")).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [entry("u", "1", "s", 5.0, 100.0, 1), entry("u", "1", "s", 7.0, 100.0, 2), entry("v", "1", "s", 1.0, 100.0, 3), entry("u", "2", "s", 1.0, 100.0, 4), entry("u", "1", "s", 3.0, 100.0, 0)]
    h = spark.createDataFrame(rows, H)
    h.write.parquet(str(tmp_path / "h"))
    stream = spark.readStream.schema(h.schema).parquet(str(tmp_path / "h"))
    views = run(spark, live.view_counts(stream), "views", "complete", tmp_path / "v")
    assert {r["episode_id"]: r["n_views"] for r in views.collect()} == {"1": 2, "2": 1}
    newest = run(spark, live.progress(stream.select("user_id", "episode_id", "time_s", "duration", "updated_at")), "newest", "update", tmp_path / "p")
    assert {(r["user_id"], r["episode_id"]): r["time_s"] for r in newest.collect()} == {("u", "1"): 7.0, ("v", "1"): 1.0, ("u", "2"): 1.0}


def test_speech_sessions(spark, tmp_path):
    at = datetime(2025, 1, 1)
    f = spark.createDataFrame([("m", at + timedelta(milliseconds=x)) for x in (0, 100, 300, 2000)], "media_id string, ts timestamp")
    f.write.parquet(str(tmp_path / "f"))
    got = run(spark, live.speech_sessions(spark.readStream.schema(f.schema).parquet(str(tmp_path / "f"))), "sessions", "complete", tmp_path / "s")
    assert sorted(r["n_frames"] for r in got.collect()) == [1, 3]


def test_slots_for_who_speaks_and_what(spark):
    r = X.stand_ins()
    sound = [0.2] * 30 + [0.0] * 15 + [0.2] * 15
    turns = spark.createDataFrame([("m", 1, "S", 1000, sound), ("m", 2, None, 0, []), (None, 3, "S", 0, None)], "media_id string, seg_id long, speaker_id string, start_ms long, samples array<double>")
    assert [tuple(w) for w in X.transcribed(r, "lengths", turns, rate=250).orderBy("word_idx").collect()] == [("m", 1, "S", 0, "xx", 1000, 1120), ("m", 1, "S", 1, "x", 1180, 1240)]
    r.add("transcriber", "named", lambda: lambda x, rate, names: [(n, 0, len(x)) for n in names])
    assert [w["text"] for w in X.transcribed(r, "named", turns, rate=250, names=["Anna"]).collect()] == ["Anna"]
    low, high = [0.3, 0.3] * 5, [0.3, -0.3] * 5
    frames = spark.createDataFrame([("m", i, low if i < 3 else high) for i in range(6)] + [("n", 0, low)], "media_id string, frame long, samples array<double>")
    got = [tuple(t) for t in X.diarized(r, "clustering", frames).orderBy("media_id", "start_ms").collect()]
    assert got == [("m", 0.0, 3000.0, "SPEAKER_00"), ("m", 3000.0, 6000.0, "SPEAKER_01"), ("n", 0.0, 1000.0, "SPEAKER_00")]
    assert [tuple(t) for t in X.diarized(r, "single", frames).orderBy("media_id").collect()] == [("m", 0.0, 6000.0, "SPEAKER_00"), ("n", 0.0, 1000.0, "SPEAKER_00")]
    with pytest.raises(ValueError):
        X.diarized(r, "none", frames)
