import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm.canonical import canonical, canonical_column, equal_looking_pairs, quick_check
from loomline.llm.splitting import longest_sentence, sentence_ends, split, split_rows


@pytest.mark.parametrize("odd,plain", [
    ("ｔｅｓｔ　１２", "test 12"), ("été", "été"), ("e​́", "é"), ("a b c", "a b c"), ("soft­hyphen﻿", "softhyphen"), ("o’q oʻq", "o'q o'q"), ("a…", "a..."), ("x‑y–z", "x-y-z"),
    ("mοscow", "moscow"), ("Мoscоw", "Moscow"), ("oн", "он"), ("ﬁn", "fin"), ("ﾍﾞﾙ", "ベル"), ("“q”", '"q"'), ("Сашa", "Саша"),
    ("hօuse", "house"), ("ᎪᏞexᎪ", "ALexA"), ("𝐇𝐨𝐭 ℌ𝟑", "Hot H3"), ("հայ", "հայ"), ("հայo", "հայօ"),
])
def test_one_form(odd, plain):
    assert canonical(odd) == plain and canonical(plain) == plain


@pytest.mark.parametrize("a,b", [("Case", "case"), ("resume", "résumé"), ("a b", "a  b"), ("a!", "a?"), ("x²", "x2"), ("со", "ca"), ("a.", "a")])
def test_what_differs_stays_different(a, b):
    assert canonical(a) != canonical(b)


def test_nothing_stays_nothing():
    assert canonical(None) is None and canonical("") == "" and canonical("​") == ""


def test_signs_of_several_scripts_by_their_neighbours():
    assert canonical("島から二番目のエンジン") == "島から二番目のエンジン"
    assert canonical("カ口ベ") == canonical("カロベ") and canonical("ベルへミ") == canonical("ベルヘミ")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aoеоcсрΑοABКé́​ｅ  '’-–…ﬁロ口二カあｶﾞ.") , max_size=14))
def test_idempotent_and_composed(text):
    one = canonical(text)
    assert canonical(one) == one and unicodedata.is_normalized("NFC", one)


def test_words_of_one_script_are_spliced_as_they_are():
    """Outside the words that change, not a character is normalised again: what isn't stable there stays."""
    apart = "\u0ddc\u0ddd"  # letters with marks of a script without look-alikes
    text = f"Первый йогурт {apart} and mοre"
    assert canonical(text) == f"Первый йогурт {apart} and more"
    assert canonical("Й" * 20_000 + " mοre") == "Й" * 20_000 + " more"


def test_quick_check_misses_nothing(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aeоеcжшр οΆé ’…ｅ口二カあ1.") for _ in range(rng.randrange(9))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", canonical_column(F.col("t")).alias("c"), quick_check(F.col("t")).alias("q")).collect():
        assert r["c"] == canonical(r["t"])
        assert r["q"] or canonical(r["t"]) == r["t"]


def test_pairs_with_hot_lines_nulls_and_clashing_names(spark):
    rows = [(i, "m", "s", "Yes.", None, "x") for i in range(200)] + [(500, "m", "s", "Ｙes.", "", "x"), (501, "m", "s", "Y​es.", "ok", "x"), (502, "m", None, "Ye​s.", "o​k", "x"), (503, "n", "s", "Ye​s.", "o​k", "x"), (504, "m", "s", "", "o​k", "x")]
    df = spark.createDataFrame(rows, "seg_id long, media_id string, speaker_id string, text string, translated_text string, field string")
    got = [tuple(r) for r in equal_looking_pairs(df, "seg_id", ["media_id", "speaker_id"], ["text", "translated_text"]).collect()]
    want = {(i, 500, "text") for i in range(200)} | {(i, 501, "text") for i in range(200)} | {(500, 501, "text"), (501, 504, "translated_text")}
    assert len(got) == len(want) and set(got) == want
    assert equal_looking_pairs(df.limit(0), "seg_id", ["media_id", "speaker_id"], ["text"]).count() == 0


@pytest.mark.parametrize("text,n", [
    ("One. Two! Three?", 3), ("Dr. Who met J. Doe at No. 8, 4.7 km away.", 1), ("No. He left.", 2), ("At 5:30. Then", 2), ("a... b", 1), ("Well... Then", 2), ("一。二！三", 3), ("Really?! Yes.", 2), ('He said "Go." Then left.', 2), ("e.g. this U.S. thing.", 1), ("no end", 1), ("Ｗｈａｔ． Ｙｅｓ", 2), ("", 1),
])
def test_sentences(text, n):
    assert len(sentence_ends(text)) == n


def whole(text, pieces, limit):
    last = 0
    for a, b, repeated in pieces:
        assert 0 < b - a <= limit and text[a:b] == text[a:b].strip() and a >= 0
        assert a <= last or not text[last:a].strip()
        assert repeated <= limit // 2 + 1
        last = max(last, b)
    assert not text[last:].strip()
    assert all(x[1] < y[1] for x, y in zip(pieces, pieces[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", "other.", "End!", "x", "longerwordhere,", "あいう漢字", "。", "y" * 70, "\n", "é"]), max_size=80), st.sampled_from([20, 60]))
def test_pieces_hold_everything(words, limit):
    text = " ".join(words)
    whole(text, split(text, limit, 3), limit)


def test_cuts_at_topics_and_repeats_words():
    first = "the cat sat near the cat door. " * 4
    second = "ships sail over deep seas today. " * 4
    text = (first + second).strip()
    pieces = split(text, 200, 5)
    assert text[pieces[0][0] : pieces[0][1]] == first.strip()
    assert text[pieces[1][0] : pieces[0][1]].split() == "sat near the cat door.".split()
    assert split("  short  ", 280) == [(2, 7, 0)] and split(" \n", 280) == [] and split("z" * 700, 280, 5)[0] == (0, 280, 0)
    assert longest_sentence("a" * 300) == 300


def test_rows_take_words_where_text_is_blank(spark):
    w = [("w" * 9, 0.0, 1.0)] * 40
    rows = [(1, "short", None), (2, " ", w), (3, None, w[:2]), (4, None, None), (5, "Too. " * 200, None), (5, "Too. " * 200, None), (6, "", [(None, 0.0, 1.0)])]
    df = spark.createDataFrame(rows, "id long, text string, words array<struct<text:string,start_s:double,end_s:double>>")
    got = split_rows(df, "id", "text", "words").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
        assert len(r["text"]) <= 280
    assert set(by) == {1, 2, 3, 5} and by[2][0]["breakable"] == 0 and by[2][0]["size"] == 399 and by[5][0]["breakable"] == 1
    assert by[3][0]["text"] == "w" * 9 + " " + "w" * 9 and split_rows(df.limit(0), "id", "text", "words").count() == 0
