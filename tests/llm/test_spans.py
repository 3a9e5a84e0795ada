import random

import numpy as np
import pandas as pd
import pytest

from loomline.llm.spans import SharedSpans, _codes, _rows_of, chains, kmer_hashes

SCHEMA = "id long, text string, h string, cls long"


def brute(rows, n):
    seen = {}
    for i, t, *_ in rows:
        for k in {t[j : j + n] for j in range(len(t) - n + 1)} if t else ():
            seen.setdefault(k, set()).add(i)
    return {(a, b) for ids in seen.values() for a in ids for b in ids if a < b}


def shared_chars(rows, n):
    owners, out = {}, {}
    for i, t, *_ in rows:
        for k in {t[j : j + n] for j in range(len(t) - n + 1)} if t else ():
            owners.setdefault(k, set()).add(i)
    for i, t, *_ in rows:
        covered = set()
        for j in range(len(t or "") - n + 1):
            if len(owners[t[j : j + n]]) > 1:
                covered |= set(range(j, j + n))
        out[i] = len(covered)
    return out


def text(rng, n, letters="abcdefgh éあ\U0001f600"):
    return "".join(rng.choice(letters) for _ in range(n))


def made(seed):
    rng = random.Random(seed)
    common = [text(rng, rng.choice([39, 40, 41, 60, 120])) for _ in range(6)]
    rows = []
    for i in range(60):
        t = text(rng, rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(common) + t[at:]
        rows.append((i, t, "x", 1))
    return rows + [(60, rows[0][1] + common[4], "", 2), (61, common[4], "", 2), (62, common[4], "", 2), (63, None, "", 2), (64, "", "", 2)]


@pytest.mark.parametrize("seed,hot", [(1, 64), (2, 1), (3, 2)])
def test_pairs_and_report_against_brute_force(spark, seed, hot):
    rows = made(seed)
    s = SharedSpans(spark.createDataFrame(rows, SCHEMA), "id", "text", min_chars=40, hot=hot)
    got = [tuple(r) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 40)
    report = {r["id"]: r for r in s.report().collect()}
    assert {i: r["shared_chars"] for i, r in report.items()} == shared_chars(rows, 40)
    assert report[61]["n_copies"] == (len(rows[61][1]) >= 40) and report[63]["n_chars"] == 0 and len(report) == len(rows)


def test_periodic_texts(spark):
    rows = [(1, "ab" * 60, "", 0), (2, "xy" + "ab" * 25, "", 0), (3, "a" * 300, "", 0), (4, "b" + "a" * 41, "", 0), (5, "a" * 39, "", 0), (6, "abc" * 30, "", 0), (7, "bca" * 20 + "z", "", 0)]
    s = SharedSpans(spark.createDataFrame(rows, SCHEMA), "id", "text", min_chars=40)
    assert {tuple(r) for r in s.pairs().collect()} == brute(rows, 40)


@pytest.mark.parametrize("hot", [64, 1])
def test_repeated_lines_and_rules_against_brute_force(spark, hot):
    """Periods up to the window, in unequal phases and between other text: every shift counts."""
    rng = random.Random(7)
    rows = [(0, "-" * 1000, "", 0), (1, "x" + "-" * 600 + "y", "", 0)]
    for i in range(2, 42, 2):
        unit = text(rng, rng.randrange(30, 73))
        for j, n in enumerate((rng.randrange(200, 261), rng.randrange(400, 1501))):
            at = rng.randrange(len(unit))
            rows.append((i + j, text(rng, rng.randrange(90), "klmn") + (unit * 60)[at : at + n] + text(rng, rng.randrange(90), "opqr"), "", 0))
    s = SharedSpans(spark.createDataFrame(rows, SCHEMA), "id", "text", min_chars=200, hot=hot)
    assert {tuple(r) for r in s.pairs().collect()} == brute(rows, 200)
    assert {r["id"]: r["shared_chars"] for r in s.report().collect()} == shared_chars(rows, 200)
    assert max(r["exact_chars"] for r in s.passages().where("id_a = 0").collect()) == 1000


def test_rows_of_seeds_hold_every_seed():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = rng.integers(0, 30)
        seeds = pd.DataFrame({"h": rng.integers(0, 3, n), "cls": rng.integers(0, 2, n), "pos": rng.integers(0, 40, n).astype(np.int32)}).drop_duplicates()
        items = _rows_of(seeds, 5)
        held = {(r.h, r.cls, p) for r in items.itertuples() for p in range(r.pos, r.last + 1, r.step or 1)}
        assert held == set(seeds.itertuples(index=False, name=None)) and len(items) <= len(seeds)
    row = _rows_of(pd.DataFrame({"h": 1, "cls": 1, "pos": np.arange(0, 50, 5, dtype=np.int32)}), 5)
    assert row[["pos", "last", "step"]].to_numpy().tolist() == [[0, 45, 5]]


def test_exactly_at_the_limit(spark):
    rng = random.Random(9)
    span = text(rng, 200)
    rows = [(1, "p" + span + "q", "", 0), (2, "r" + span + "s", "", 0), (3, "t" + span[:199] + "u", "", 0), (4, span[1:] + "v", "", 0)]
    s = SharedSpans(spark.createDataFrame(rows, SCHEMA), "id", "text", min_chars=200)
    assert {tuple(r) for r in s.pairs().collect()} == {(1, 2)}
    assert {(r["id_a"], r["id_b"], r["exact_chars"]) for r in s.passages().where("exact_chars > 0").collect()} == {(1, 2, 200)}


def test_a_text_longer_than_a_chunk(spark):
    rng = random.Random(4)
    span = text(rng, 250)
    long = "".join(rng.choice("klmnop") for _ in range(1_048_500)) + span + text(rng, 2000, "uvw")
    rows = [(1, long, "", 0), (2, "x" + span, "", 0)]
    s = SharedSpans(spark.createDataFrame(rows, SCHEMA), "id", "text", min_chars=200)
    assert {tuple(r) for r in s.pairs().collect()} == {(1, 2)}


def test_empty_table(spark):
    s = SharedSpans(spark.createDataFrame([], SCHEMA), "id", "text")
    assert s.pairs().count() == 0 and s.report().count() == 0 and s.passages().count() == 0


def test_hashes_follow_the_text_alone():
    h = kmer_hashes(_codes("xxabcabc"), 3)
    assert h[2] == h[5] and len(set(h.tolist())) == 5


def best_chain(pa, pb, weight, gap):
    order = sorted(range(len(pa)), key=lambda i: (pa[i], pb[i]))
    score = {}
    for i in order:
        score[i] = weight + max([0.0, *(score[j] - gap * (pa[i] - pa[j] + pb[i] - pb[j]) for j in score if pa[j] < pa[i] and pb[j] < pb[i])])
    return max(score.values())


def test_chains_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = rng.integers(1, 40)
        pa, pb = rng.integers(0, 60, n), rng.integers(0, 60, n)
        got = chains(pa, pb, 10.0, 0.5)
        assert got[0][0] == pytest.approx(best_chain(pa, pb, 10.0, 0.5))
        assert sorted(i for _, path in got for i in path) == list(range(n))
        for _, path in got:
            assert (np.diff(pa[path]) > 0).all() and (np.diff(pb[path]) > 0).all()


@pytest.mark.parametrize("period,long,short", [(1, 1000, 600), (10, 1000, 400), (60, 2400, 600)])
def test_the_report_holds_the_whole_of_periodic_texts(spark, period, long, short):
    unit = text(random.Random(period), period)
    rows = [(1, "(" + (unit * 2400)[:long] + ")", "", 0), (2, "[" + (unit * 2400)[3 : 3 + short] + "]", "", 0), (3, "apart " * 60, "", 0)]
    s = SharedSpans(spark.createDataFrame(rows, SCHEMA), "id", "text", min_chars=200)
    assert {r["id"]: r["shared_chars"] for r in s.report().collect()} == shared_chars(rows, 200) == {1: long, 2: short, 3: 0}


def test_a_passage_of_a_thousand_texts_makes_no_pairs(spark):
    rng = random.Random(8)
    passage = text(rng, 260)
    rows = [(i, text(rng, 20) + passage + text(rng, 20), "", 0) for i in range(1000)] + [(1000, passage[:210], "", 0), (1001, text(rng, 300), "", 0)]
    s = SharedSpans(spark.createDataFrame(rows, SCHEMA), "id", "text", min_chars=200)
    got = {r["id"]: (r["shared_chars"], r["n_texts"]) for r in s.report().collect()}
    want = shared_chars(rows, 200)
    assert {i: n for i, (n, _) in got.items()} == want
    assert {n for i, (_, n) in got.items() if i < 1001} == {1000} and got[1001] == (0, 0)
    assert s._chains is None


def test_classes_and_their_pairs_hold_all_pairs(spark):
    rows = made(5)
    s = SharedSpans(spark.createDataFrame(rows, SCHEMA), "id", "text", min_chars=40)
    members = {}
    for r in s.classes().collect():
        members.setdefault(r["class_id"], []).append(r["id"])
    pairs = {(a, b) for ids in members.values() for a in ids for b in ids if a < b}
    for r in s.class_pairs().collect():
        pairs |= {(min(a, b), max(a, b)) for a in members[r["class_a"]] for b in members[r["class_b"]]}
    assert pairs == brute(rows, 40)
