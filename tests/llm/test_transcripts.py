import random

import pytest

from loomline.llm.languages import fit
from loomline.llm.transcripts import Transcripts, arranged, clean_words, cues, is_hesitation, label_evidence, n_words, parts, speaker_number

SCHEMA = "line_id long, media_id string, start_s double, end_s double, speaker_id string, text string, turn_no int"


@pytest.mark.parametrize("label,want", [("SPEAKER_03", 3), (" speaker #1", 1), ("Spk. 2", 2), ("S0", 0), ("ＳＰＥＡＫＥＲ　０３", 3), ("spk３", 3), ("Speaker01 ", 1), ("SPK-12", 12), ("Anna", None), (None, None), ("", None)])
def test_numbers(label, want):
    assert speaker_number(label) == want


@pytest.mark.parametrize("token,lang,want", [("um", "en", True), ("um", "pt", False), ("Ummmm,", "pt", True), ("er", "de", False), ("Er...", "en", True), ("hmm", None, True), ("э-ээээ", None, True), ("eee", None, True), ("e", "pt", False), ("euhhh", None, True), ("Iııı,", None, True), ("u" + "m" * 90, "pt", True), ("x" * 90, None, False), ("hum", None, False), ("Aaaah", None, False), ("now", "en", False), ("...", None, False)])
def test_hesitations(token, lang, want):
    assert is_hesitation(token, lang) is want


def test_times_in_the_text():
    assert cues("00:00:11,273 --> 00:00:17,093 der") == (11.273, 17.093, 11.273)
    assert cues("(0:19) x") == (None, None, 19.0) and cues("at 9:06?") == (None, None, None)


@pytest.mark.parametrize("text,want", [
    ("[00:02:40.915] ♪♪ Hello {Crosstalk} there at 9:06.", [(None, "Hello there at 9:06.")]),
    ("<v Anna>(1:05) Uh... um, Not now.", [(1, "Not now.")]),
    ("Anna (O.S.): <i>Go.</i>", [(1, "Go.")]), ("ANNA: Listen: go", [(1, "Listen: go")]), ("[Anna] go", [(1, "go")]), ("(ANNA) {\\an8}go", [(1, "go")]), ("- Anna : go", [(1, "go")]), ("[Spk 2] go", [(2, "go")]), ("speaker 0 - go", [(0, "go")]),
    ("We left. >> ANNA: And then?", [(None, "We left."), (1, "And then?")]), ("*laughs*", []), ("*door\nslams* Go.", [(None, "Go.")]), ("2 * 3 is six", [(None, "2 * 3 is six")]), ("♪♪", []), ("[music] (hmm) ...", []), ("Nobody: go", [(None, "Nobody: go")]),
])
def test_parts(text, want):
    assert [(n, said) for n, _, said in parts(text, {"anna": 1}, "en")] == want


def test_words():
    assert n_words("a – b1 ... c") == 3 and clean_words("the (er) boat, um, left", "en") == "the boat, left"


def turns(spark, rows):
    got = Transcripts(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).turns().orderBy("media_id", "turn_no").collect()
    return [(r["media_id"], r["turn_no"], r["speaker_id"], r["from_ms"], r["to_ms"], r["n_words"]) for r in got]


def test_turns(spark):
    rows = [
        (1, "m", 0.0, 1.0, "S0", "Hello there."), (2, "m", 1.0, 2.0, "Spk. 0", "(laughs)"), (3, "m", 1.5, 1.9, "S1", "♪♪"), (4, "m", 2.0, 3.0, "speaker_0", "Again um, here."), (12, "m", 2.0, 3.0, None, "Again um, here."), (12, "m", 2.0, 3.0, None, "Again um, here."),
        (5, "m", None, None, "S1", "00:00:03,500 --> 00:00:04,000\nBob: Yes."), (6, "m", 4.0, 9.0, None, "BOB: No. >> S0: Why?"), (7, "m", 5.0, 6.0, "S0", "Because."),
        (8, None, 0.0, 1.0, "S3", "Alone."), (9, "n", 0.0, 1.0, None, "Who?"), (10, "n", 1.0, 1.5, None, None), (11, "n", None, None, "S1", "Late."),
    ]
    assert turns(spark, rows) == [
        (None, 1, "SPEAKER_03", 0, 1000, 1),
        ("m", 1, "SPEAKER_00", 0, 3000, 4), ("m", 2, "SPEAKER_01", 3500, 9000, 2), ("m", 3, "SPEAKER_00", 4000, 9000, 2),
        ("n", 1, "SPEAKER_00", 0, 1000, 1), ("n", 2, "SPEAKER_01", 1000, 1000, 1),
    ]
    assert turns(spark, []) == []


def test_a_hot_item_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(i, "hot", float(i), i + 0.5, rng.choice(["S0", "S0", "S1", None]), "word here.") for i in range(700)] + [(1000 + i, m, float(i), i + 0.5, rng.choice(["S0", "S1"]), "x y z") for m in "ab" for i in range(20)]
    want = []
    for media in ("a", "b", "hot"):
        now, number = None, 0
        for r in sorted((r for r in rows if r[1] == media), key=lambda r: r[2]):
            who = f"SPEAKER_0{r[4][1]}" if r[4] else now or "SPEAKER_00"
            if who != now:
                number += 1
                want.append([media, number, who, int(r[2] * 1000), 0, 0])
                now = who
            want[-1][4] = max(want[-1][4], int((r[2] + 0.5) * 1000))
            want[-1][5] += len(r[5].split())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert turns(spark, rows) == [tuple(w) for w in want]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def plain_order(lines):
    """Edges one by one, each kept unless the graph so far leads back; then the first free line, but those that follow one at once."""
    n = len(lines)
    after = {i: set() for i in range(n)}

    def leads(a, b):
        return a == b or any(leads(x, b) for x in after[a])

    by_cue = sorted((i for i in range(n) if lines[i][0] is not None), key=lambda i: lines[i])
    by_arrival = sorted(range(n), key=lambda i: lines[i][1])
    for way in (by_cue, by_arrival):
        for a, b in zip(way, way[1:]):
            if not leads(b, a):
                after[a].add(b)
    return after


@pytest.mark.parametrize("seed", range(40))
def test_windows_keep_every_edge_that_contradicts_none_before_it(seed):
    rng = random.Random(seed)
    arrival = rng.sample(range(100), rng.randrange(1, 9))
    lines = [(rng.choice([None, float(rng.randrange(4))]), a) for a in arrival]
    way = arranged(lines)
    place = {i: k for k, i in enumerate(way)}
    assert sorted(way) == list(range(len(lines)))
    for a, following in plain_order(lines).items():
        assert all(place[a] < place[b] for b in following)


def test_lines_without_times_follow_the_line_before_them(spark):
    rows = [(1, "m", None, None, "S2", "first"), (2, "m", 5.0, 6.0, "S0", "five"), (3, "m", None, None, "S1", "behind five"), (4, "m", 1.0, 2.0, "S3", "one"), (5, "m", None, None, "S3", "behind one"), (6, "m", 5.0, 9.0, "S4", "also at five")]
    got = [(r["speaker_id"], r["from_ms"], r["to_ms"], r["text"]) for r in Transcripts(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).turns().orderBy("turn_no").collect()]
    assert got == [("SPEAKER_02", 0, 0, "first"), ("SPEAKER_03", 1000, 2000, "one behind one"), ("SPEAKER_00", 5000, 6000, "five"), ("SPEAKER_01", 6000, 6000, "behind five"), ("SPEAKER_04", 5000, 9000, "also at five")]
    long = [(i, "m", None if i else 0.0, None if i else 1.0, f"S{i // 3 % 2}", "word") for i in range(3000)]
    assert [t[2] for t in turns(spark, long)] == [f"SPEAKER_0{i % 2}" for i in range(1000)]


def test_names_are_judged_within_their_media_item(spark):
    one = [(0, "Maria: Good day.", "S0"), (1, "Tomas: Good day.", "S1"), (2, "Maria: And then?", None), (3, "Tomas: Listen: we left.", None)]
    rows = [(i + 10 * k, m, float(i), i + 0.5, who, text) for k, m in enumerate("abc") for i, text, who in one]
    alone = turns(spark, [r for r in rows if r[1] == "a"])
    assert [(t[2], t[5]) for t in alone] == [("SPEAKER_00", 2), ("SPEAKER_01", 2), ("SPEAKER_00", 2), ("SPEAKER_01", 3)]
    for m in "abc":
        assert [t[1:] for t in turns(spark, rows) if t[0] == m] == [t[1:] for t in alone]
    # names that no line numbers have the first free numbers; a word that several say is no name
    rows = [(1, "m", 0.0, 1.0, None, "Zoe: Hello."), (2, "m", 1.0, 2.0, None, "Bob: Hi."), (3, "m", 2.0, 3.0, "S0", "Now: go."), (4, "m", 3.0, 4.0, "S3", "Now: stay.")]
    assert [(t[2], t[5]) for t in turns(spark, rows)] == [("SPEAKER_02", 1), ("SPEAKER_01", 1), ("SPEAKER_00", 2), ("SPEAKER_03", 2)]
    assert ("now", False, "speech") in label_evidence("[Spk 1] Now: go") and label_evidence("Listen: go") == []


def test_the_language_of_an_item_settles_words_that_are_sounds_elsewhere(spark):
    de, en = "wir gehen um acht Uhr nach Hause und er wartet nicht", "we went home at eight and the old door was closed"
    model = fit([de, en] * 40, ["de", "en"] * 40)
    rows = [(i, m, float(i), i + 0.5, "S0", text) for i, (m, text) in enumerate([("d", "wir gehen um acht Uhr"), ("d", "er wartet nicht"), ("e", "um, the old door er, was closed"), ("e", "we went home")])]
    got = Transcripts(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), model).turns().orderBy("media_id").collect()
    assert [r["n_words"] for r in got] == [8, 8]
