import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import timeline as T
from loomline.plans.timeline import QUERIES

SEG = "media_id string, seg_id long, seg_idx int, start_s double, end_s double, speaker_id string, text string, words array<struct<text:string,start_s:double,end_s:double>>"


def seg(i, start, end, speaker="S0", text="", words=(), media="m"):
    return (media, i, i, float(start), float(end), speaker, text, [(w[0], float(w[1]), float(w[2])) for w in words])


def cut(spark, segs, longest):
    lines = T.timeline(spark.createDataFrame(segs, SEG))
    got = T.sentences(T.words_of(lines), longest).orderBy("media_id", "sentence").collect()
    return [(r["text"], r["start_ms"], r["end_ms"], r["speaker_id"]) for r in got]


def test_sentences_cross_segments(spark):
    segs = [seg(1, 0, 1, words=[("you", 0, 0.2), ("for", 0.2, 0.4), ("joining", 0.4, 0.7), ("us.", 0.7, 1)]), seg(2, 1, 2.5, words=[("What", 1, 1.3), ("my", 1.3, 1.5), ("hope", 1.5, 1.8), ("is.", 1.8, 2.5)])]
    assert [x[:3] for x in cut(spark, segs, 12_000)] == [("you for joining us.", 0, 1000), ("What my hope is.", 1000, 2500)]


def test_sentences_split_at_marks_and_speakers(spark):
    one = [seg(1, 0, 2, words=[("Hi", 0, 0.2), ("there.", 0.2, 0.5), ("How", 1, 1.2), ("are", 1.2, 1.4), ("you?", 1.4, 2)])]
    assert [x[0] for x in cut(spark, one, 12_000)] == ["Hi there.", "How are you?"]
    two = [seg(1, 0, 1, "S0", words=[("hello", 0, 1)]), seg(2, 1, 2, "S1", words=[("hi", 1, 2)])]
    assert [x[3] for x in cut(spark, two, 12_000)] == ["S0", "S1"]
    assert cut(spark, [], 12_000) == []


def test_forced_split_prefers_the_largest_pause(spark):
    segs = [seg(1, 0, 6, words=[("alpha", 0, 1), ("beta", 1.1, 2), ("gamma", 4, 5), ("delta", 5.1, 6)])]
    assert [x[0] for x in cut(spark, segs, 3000)] == ["alpha beta", "gamma delta"]


def test_forced_split_keeps_every_word(spark):
    words = [(f"w{i}", i * 0.4, i * 0.4 + 0.3) for i in range(60)]
    got = cut(spark, [seg(1, 0, 24, words=words)], 5000)
    assert len(got) > 1 and " ".join(x[0] for x in got).split() == [w[0] for w in words]
    assert all(b - a <= 5400 for _, a, b, _ in got)
    tight = [(f"w{i}", i * 0.3, i * 0.3 + 0.3) for i in range(50)]
    got = cut(spark, [seg(1, 0, 15, words=tight)], 5000)
    assert len(got) <= 5 and all(len(x[0].split()) > 1 for x in got)


def test_forced_sizes_against_a_loop():
    rng = random.Random(1)
    for _ in range(300):
        t, starts, ends = 0, [], []
        for _ in range(rng.randrange(1, 40)):
            t += rng.choice([0, 0, 100, 150, 400])
            starts.append(t)
            t += rng.choice([100, 300, 900])
            ends.append(t)
        terminated, longest = rng.random() < 0.5, rng.choice([500, 1500, 4000])
        done, now = [], []
        for i in range(len(starts)):
            now.append(i)
            if terminated and i == len(starts) - 1:
                done.append(len(now))
                now = []
            elif ends[now[-1]] - starts[now[0]] > longest:
                n = T.split_index([starts[k] for k in now], [ends[k] for k in now], longest)
                done.append(n)
                now = now[n:]
        if now:
            done.append(len(now))
        assert T.forced_sizes(starts, ends, terminated, longest) == done


@pytest.mark.parametrize("turns,at,want", [
    ([(0, 5, "S0"), (5, 10, "S1"), (10, 15, "S0")], 2.5, "S0"),
    ([(0, 5, "S0"), (5, 10, "S1"), (10, 15, "S0")], 7.5, "S1"),
    ([(0, 5, "S0"), (5, 10, "S1"), (10, 15, "S0")], 5.0, "S1"),
    ([(0, 5, "S0"), (8, 12, "S1")], 6.0, "S0"),
    ([(0, 5, "S0"), (8, 12, "S1")], 6.6, "S1"),
    ([(0, 5, "S0"), (8, 12, "S1")], 6.5, "S0"),
    ([], 3.0, "SPEAKER_00"),
])
def test_speaker_at(spark, turns, at, want):
    t = spark.createDataFrame([("m", float(a), float(b), i, s) for i, (a, b, s) in enumerate(turns)], "media_id string, turn_start double, turn_end double, turn_order int, turn_speaker string") if turns else spark.createDataFrame([], "media_id string, turn_start double, turn_end double, turn_order int, turn_speaker string")
    p = spark.createDataFrame([("m", 1, float(at))], "media_id string, id int, at double")
    assert T.speaker_at(p, "at", "id", t).first()["speaker"] == want


@pytest.mark.parametrize("args,want", [((1.4, 1.6, 1.5, 1.25), 1.0), ((2.0, 1.8, 1.5, 1.25), 2.0 / 1.8), ((4.0, 1.0, 1.0, 1.25), 1.25), ((1.0, -0.3, 1.0, 1.25), 1.25), ((1.0, 3.0, 2.0, 1.25), 0.9), ((1.8, 3.0, 2.0, 1.25), 1.0), ((0.0, 1.0, 1.0, 1.25), 1.0)])
def test_choose_speed(spark, args, want):
    n, a, o, m = map(F.lit, args)
    assert spark.range(1).select(T.choose_speed(n, a, o, 0.9, m)).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("args,want", [((0.1, 1.2, 1.5), 1.25), ((0.6, 1.0, 2.0), 1.4), ((0.0, 6.75, 4.32), 1.4), ((0.0, 2.0, 1.5), 1.25)])
def test_speed_cap(spark, args, want):
    assert spark.range(1).select(T.speed_cap(*map(F.lit, args), 1.25, 1.4, 0.3)).first()[0] == want


def test_placed_is_the_loop(spark):
    rng = random.Random(2)
    segs, want = [], {}
    for m in "ab":
        end, t = None, 0
        for i in range(80):
            t += rng.randrange(3000)
            n = rng.randrange(1, 4000)
            segs.append(seg(i, t / 1000, (t + n) / 1000, media=m))
            at = t if end is None else max(t, end + 80)
            want[m, i], end = at, at + n
    lines = T.timeline(spark.createDataFrame(segs, SEG))
    got = T.placed(lines, F.col("start_ms"), F.col("end_ms") - F.col("start_ms"), 80).collect()
    assert {(r["media_id"], r["seg_id"]): r["placed_ms"] for r in got} == want


def test_planner_waits_catches_up_and_restarts_by_media(spark):
    segs = [seg(1, 0, 1.5), seg(2, 1.2, 2), seg(3, 2, 3), seg(1, 0, 1, media="n")]
    lines = T.timeline(spark.createDataFrame(segs, SEG)).drop("words").withColumns({"natural": F.lit(2.0), "track_end": F.lit(10_000)})
    got = {(r["media_id"], r["seg_id"]): r for r in T.plan_speeds(lines, "natural", "track_end").collect()}
    first, second = got["m", 1], got["m", 2]
    assert first["planned_start"] == 0 and first["speed"] == pytest.approx(1.4)
    assert second["planned_start"] == pytest.approx(first["spoken"] + 0.08)
    assert got["n", 1]["planned_start"] == 0 and got["n", 1]["speed"] == 1.0
    assert T.lateness(T.plan_speeds(lines, "natural", "track_end")).where("media_id = 'm'").first()["n_late"] == 2


def test_regions_bridge_before_they_drop(spark):
    segs = [seg(1, 0, 0.3), seg(2, 0.65, 0.9), seg(3, 2, 2.2), seg(4, 5, 6)]
    got = T.speech_regions(T.timeline(spark.createDataFrame(segs, SEG))).orderBy("start_ms").collect()
    assert [(r["start_ms"], r["end_ms"]) for r in got] == [(0, 900), (5000, 6000)]


def test_regions_take_the_nearest_window_and_split_in_the_middle(spark):
    regions = spark.createDataFrame([("m", 0, 4000), ("m", 9000, 10_000), ("k", 0, 1000)], "media_id string, start_ms long, end_ms long")
    windows = spark.createDataFrame([("m", 0, 1600, "x"), ("m", 1600, 3200, "y")], "media_id string, w_start long, w_end long, label string")
    got = T.identify_regions(regions, windows).orderBy("media_id", "start_ms").collect()
    assert [(r["media_id"], r["start_ms"], r["end_ms"], r["speaker_id"]) for r in got] == [("k", 0, 1000, "SPEAKER_00"), ("m", 0, 1600, "SPEAKER_00"), ("m", 1600, 4000, "SPEAKER_01"), ("m", 9000, 10000, "SPEAKER_01")]


def test_mix_is_below_the_ceiling_and_as_long_as_needed(spark):
    lines = spark.createDataFrame([("m", 500, 500, 0.2, 2000), ("n", 800, 700, 0.9, 1000), ("e", 0, 0, 0.9, 1000)], "media_id string, placed_ms long, length_ms long, level double, track_ms long")
    got = {}
    for r in T.mixed_frames(lines, 500, 0.1).collect():
        got.setdefault(r["media_id"], {})[r["frame"]] = round(r["mixed"], 6)
    assert got["m"] == {0: 0.1, 1: 0.3, 2: 0.1, 3: 0.1}
    assert len(got["n"]) == 3 and max(got["n"].values()) == 0.98
    assert got["e"] == {0: 0.1, 1: 0.1}


def test_mix_plays_long_lines_to_their_end(spark, tmp_path):
    segs = [seg(1, 0, 70), seg(2, 10, 12), seg(3, 1, 41, media="n"), seg(4, 50, 51, media="n")]
    spark.createDataFrame(segs, SEG).write.parquet(f"{tmp_path}/segments.parquet")
    got = {}
    for r in QUERIES["B18_mix"](spark, str(tmp_path)).collect():
        got.setdefault(r["media_id"], {})[r["frame"]] = r["mixed"]
    assert got["m"] == dict.fromkeys(range(72), 0.3)  # the second line waits for the first
    assert got["n"] == {i: 0.3 if 1 <= i <= 40 or i == 50 else 0.1 for i in range(51)}


def test_borrowing_prefers_the_earlier_of_equals(spark):
    rows = [("m", 1, 1, 0, "a"), ("m", 2, 2, 10, "default"), ("m", 3, 3, 20, "b"), ("n", 4, 1, 0, "default")]
    df = spark.createDataFrame(rows, "media_id string, seg_id long, seg_idx int, start_ms long, reference string")
    assert {r["seg_id"]: r["borrowed"] for r in T.borrowed(df, "reference", "default").collect()} == {1: "a", 2: "a", 3: "b", 4: "default"}
