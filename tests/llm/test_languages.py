import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm.languages import LANGUAGES, Model, _features, _lexicon, code_matrix, fit, fit_on, identify, label_column, label_languages, language_of_label

BASE = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test data")


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{BASE}/segments.parquet").select("seg_id", "text", "detected_language")


@pytest.fixture(scope="module")
def model(lines):
    return fit_on(lines, "seg_id", "text", "detected_language")


@pytest.mark.parametrize("label,want", [("en", "en"), ("EN", "en"), ("en-US", "en"), ("en_GB", "en"), ("eng", "en"), ("English", "en"), ("es-419", "es"), ("uz-Latn", "uz"), ("jpn", "ja"), ("日本語", "ja"), (" ru ", "ru"), ("und", None), ("xx", None), ("", None), (None, None), ("it", "it"), ("ko_KR", "ko"), ("unknown", None)])
def test_labels(spark, label, want):
    assert language_of_label(label) == want
    assert spark.range(1).select(label_column(F.lit(label).cast("string"))).first()[0] == want


def test_codewords_are_far_apart():
    m = code_matrix(len(LANGUAGES), 15)
    apart = [(m[i] != m[j]).sum() for i in range(len(m)) for j in range(i)]
    assert min(apart) >= 5 and (np.abs(m.sum(0)) < len(m)).all()


def pieces(model, text, **options):
    return [(k, lang) for _, found in identify(model, [text], **options) for k, lang, *_ in found]


def test_mixed_and_plain(model):
    en, ja, es = "The captain stole the gate under the bridge while everyone was asleep", "灯台守は何も言わずに港の地図を売ってしまった", "El farero vendió el abrigo de su padre después del ensayo"
    assert pieces(model, en) == [(0, "en")]
    assert pieces(model, f"{en} / {ja} - {es}.") == [(1, "en"), (2, "ja"), (3, "es")]
    assert pieces(model, f"{en}. {en}.") == [(0, "en")]
    assert pieces(model, f"{en}, de su padre.") == [(0, "en")]  # three words are no piece
    assert pieces(model, "") == [] and pieces(model, "12:30 – 4 / 7") == []


def test_a_cry_is_in_no_language(spark, model):
    rows = [(1, "N" + "u" * 300 + "h!", "en"), (2, None, None), (3, "", "en"), (4, "12345 --", "en"), (5, "The old pilot sold the last ticket near the old market.", "de")]
    df = spark.createDataFrame(rows, "id long, text string, piece string")
    got = {r["id"]: r for r in label_languages(df, model, "id", "text", "piece").collect()}
    assert [got[i]["language"] for i in (1, 2, 3, 4, 5)] == [None, None, None, None, "en"]
    assert got[5]["label_language"] == "de" and got[5]["confidence"] > 0.9 and not got[5]["ambiguous"]
    assert label_languages(df.limit(0), model, "id", "text", "piece").count() == 0


def test_thin_evidence_is_flagged_and_kept(spark, model):
    texts = ["Thank you.", "Quédate aquí.", "Wo ist mein Hut?", "Hahahahahahahahahahahahaha!", "Oa" + "a" * 400, "Mmmmmm... Shhhhh!", "カタカナ"]
    weak = Model(model.code, model.weights / 64, model.trust, model.size, model.lexicon, model.names, model.languages)  # so that longer lines are unclear too
    long = ["The old pilot sold the last ticket near the old market.", "El farero vendió el abrigo de su padre después del ensayo"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("label", F.lit("fr"))
    got = {r["id"]: r for r in label_languages(df, model, "id", "text", "label").collect()}
    assert all(got[i]["language"] and got[i]["confidence"] > 0.5 for i in (0, 1, 2)) and got[0]["ambiguous"]
    assert got[0]["language"] == "en" and got[1]["language"] == "es"
    assert [(got[i]["language"], got[i]["confidence"], got[i]["ambiguous"]) for i in (3, 4, 5, 6)] == [(None, 0.0, True)] * 4
    df = spark.createDataFrame(list(enumerate(long)), "id long, text string").withColumn("label", F.lit("fr"))
    got = {r["id"]: r for r in label_languages(df, weak, "id", "text", "label").collect()}
    assert [(got[i]["language"], got[i]["ambiguous"], got[i]["confidence"] > 0.5) for i in (0, 1)] == [("en", True, True), ("es", True, True)]
    counts = Counter({("Marlo", 0): 3, ("Marlo", 1): 3, ("Marlo", 2): 3, ("the", 0): 9, ("el", 1): 9, ("o", 2): 9})
    known = Model(model.code, model.weights, model.trust, model.size, *_lexicon(counts, len(model.code)), model.languages)
    named = {r["id"]: r["language"] for r in label_languages(spark.createDataFrame([(0, "Marlo, Marlo!"), (1, "Marlo, the captain of the old bridge")], "id long, text string").withColumn("label", F.lit("fr")), known, "id", "text", "label").collect()}
    assert named == {0: None, 1: "en"}
    nothing = {r["id"]: r["language"] for r in label_languages(df, fit([], []), "id", "text", "label").collect()}
    assert nothing == {0: None, 1: None}


def test_a_long_text_is_read_to_its_end(model):
    en, tr = "The captain stole the gate under the bridge. " * 3000, "Gece bekçisi yol kapalı olduğu için son sahneyi anlattı. "
    assert pieces(model, en + tr + en) == [(1, "en"), (2, "tr"), (3, "en")]


def test_held_out_accuracy(lines):
    rows = [(r["text"], language_of_label(r["detected_language"])) for r in lines.orderBy(F.xxhash64("seg_id")).collect() if r["text"] and len(r["text"]) > 30]
    rows = [r for r in rows if r[1]]
    model = fit(*zip(*rows[: len(rows) // 2]))
    held = rows[len(rows) // 2 :]
    plain = [(found[0][1], held[i][1]) for i, found in identify(model, [t for t, _ in held]) if len(found) == 1]
    assert np.mean([a == b for a, b in plain]) > 0.88  # about a tenth of the labels is wrong


def test_fit_on_nothing():
    m = fit([], [])
    assert [found for _, found in identify(m, ["a few plain words here"])][0][0][3]  # ambiguous


def test_languages_outside_the_codes_are_rejected(model):
    for text in ("Il capitano ha venduto la mappa del porto senza dire una parola a nessuno durante la tempesta", "선장은 아무 말도 하지 않고 항구의 지도를 팔아 버렸다 그리고 우리는 집으로 갔다", "Kapitan sprzedał mapę portu bez słowa i nikt nie wiedział gdzie są klucze"):
        assert [p[1:4] for _, found in identify(model, [text]) for p in found] == [(None, 0.0, True)]


def test_no_line_of_the_sample_is_rejected(lines, model):
    rows = [r["text"] for r in lines.where("length(text) BETWEEN 60 AND 400").collect()]
    rejected = [i for i, found in identify(model, rows) if any(p[1] is None for p in found)]
    assert len(rejected) <= 0.001 * len(rows)


def test_the_labels_name_the_languages():
    it, ko, en = "il capitano ha venduto la mappa del porto", "선장은 항구의 지도를 팔아 버렸다", "the captain sold the map of the harbour"
    m = fit([it, ko, en] * 30 + ["la la la"], ["it", "ko", "en"] * 30 + ["sv"])
    assert m.languages == ("en", "it", "ko") and [pieces(m, t) for t in (it, ko, en)] == [[(0, "it")], [(0, "ko")], [(0, "en")]]


def test_runs_count_from_end_to_end(model):
    a = _features("ab" * 50 + "q" + "cd" * 50, 1 << 16)
    assert set(a) != set(_features("ab" * 50 + "cd" * 50, 1 << 16)) and _features("カタカナ", 64) == []
    assert set(_features("灯台守は港", 1 << 16)) != set(_features("市場町は駅", 1 << 16))
