import hashlib
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import tokens
from loomline.llm.mixing import Mix, enough, source_name
from loomline.llm.packing import fill_containers, fill_report, limits_of, pack

PATH = os.path.join(tokens.FOLDER, tokens.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.mark.parametrize("seed", range(5))
def test_pack_keeps_every_limit(seed):
    rng = np.random.default_rng(seed)
    limits = np.array([512.0, 20, 400])
    size = rng.integers(0, 400, 300)
    sizes = np.stack([size, np.ones(300), np.minimum(size, rng.integers(0, 400, 300))], 1).astype(float)
    where = pack(sizes, limits)
    for k in range(where.max() + 1):
        assert (sizes[where == k].sum(0) <= limits + 1e-6).all() and (where == k).any()
    least = math.ceil((sizes.sum(0) / limits).max())
    assert where.max() + 1 <= least * 1.15 + 1


@pytest.mark.parametrize("seed", range(4))
def test_each_limit_binds(seed):
    """Without any one of the limits the packing is another, and some container is over that limit."""
    rng = np.random.default_rng(seed)
    limits = limits_of(512, 64, 0.8)
    size = np.concatenate([rng.integers(1, 20, 150), rng.integers(20, 400, 150)])
    sizes = np.stack([size, np.ones(300), size * rng.choice([0.4, 0.95], 300)], 1)
    whole = pack(sizes, limits)
    assert all((sizes[whole == k].sum(0) <= limits + 1e-6).all() for k in range(whole.max() + 1))
    for d in range(3):
        free = limits.copy()
        free[d] = 1e9
        other = pack(sizes, free)
        assert (other != whole).any() and any(sizes[other == k].sum(0)[d] > limits[d] for k in range(other.max() + 1))


def docs(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "12:30", "–", "γάμμα", "日本"]) for _ in range(rng.choice([1, 5, 30, 90]))), i) for i in range(300)]
    rows += [(900, None, 0), (901, "", 0), (902, "word " * 500, 0), (903, "word " * 500, 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, container int")


def test_all_items_once_and_only_large_ones_divided(spark):
    rows, df = docs(spark)
    packed = fill_containers(df, "doc_id", "text", [64, 256], tokens_per_segment=16, block_items=50).collect()
    n = {i: len(tokens.tokens(t, PATH)) for i, t, _ in rows}
    for c in (64, 256):
        mine = [r for r in packed if r["capacity"] == c]
        fill, items = {}, {}
        for r in mine:
            fill[r["container"]] = fill.get(r["container"], 0) + r["token_to"] - r["token_from"]
            items[r["container"]] = items.get(r["container"], 0) + 1
        assert max(fill.values()) <= c and max(items.values()) <= max(4, c // 16)
        loss = {}
        for r in mine:
            loss.setdefault(r["container"], []).append(r["loss_tokens"])
        assert all(sum(x) <= 0.85 * c or sum(map(bool, x)) == 1 for x in loss.values())
        for i in n:
            pieces = sorted((r["piece"], r["token_from"], r["token_to"]) for r in mine if r["doc_id"] == i)
            assert len(pieces) == max(1, math.ceil(n[i] / c))
            assert [a for _, a, _ in pieces] == [k * c for k in range(len(pieces))] and pieces[-1][2] == n[i]
    report = {r["capacity"]: r for r in fill_report(spark.createDataFrame(packed)).collect()}
    assert report[64]["most_tokens"] <= 64
    assert all(r["by_tokens"] + r["by_segments"] + r["by_loss"] == r["n_containers"] for r in report.values())
    with pytest.raises(ValueError):
        fill_containers(df, "doc_id", "text", [])
    assert fill_containers(df.limit(0), "doc_id", "text", [64]).count() == 0


def test_counts_are_those_of_the_tokenizer(spark):
    rows, df = docs(spark)
    got = {r["doc_id"]: r["n"] for r in df.select("doc_id", tokens.count(F.col("text")).alias("n")).collect()}
    assert got == {i: len(tokens.tokens(t, PATH)) for i, t, _ in rows} and got[900] == got[901] == 0


def mix_of(spark, sizes, targets, **options):
    """Documents of so many tokens: a word is a token."""
    rows = [(f"{s}{i}", "a" + " a" * (n - 1) if n else "", s, 1) for s, ns in sizes.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, copy int")
    t = spark.createDataFrame(targets, "mix string, source_name string, weight double, max_repeats int, total_tokens long")
    return Mix(df, t, "doc_id", "text", "source", **options)


def plain_mix(sizes, targets, seed=7):
    """The queue row by row: finish times of all copies, sorted, taken until the next is too much."""
    out = {}
    for mix in {t[0] for t in targets}:
        queue, total = [], next(t[4] for t in targets if t[0] == mix)
        for _, source, weight, repeats, _t in (t for t in targets if t[0] == mix and t[2] and t[2] > 0):
            docs = sorted((hashlib.md5(f"{seed}:{source}{i}".encode()).hexdigest(), f"{source}{i}", n) for i, n in enumerate(sizes.get(source, [])) if n)
            upto = 0
            for copy in range(1, (repeats or 1) + 1):
                for u, i, n in docs:
                    upto += n
                    queue.append((upto / weight, source, copy, u, i, n))
        taken, got = 0, []
        for _, source, copy, _u, i, n in sorted(queue):
            if taken + n > total:
                break
            taken += n
            got.append((i, copy))
        out[mix] = got
    return out


@pytest.mark.parametrize("seed", range(3))
def test_the_selection_is_the_prefix_of_the_queue(spark, seed):
    rng = random.Random(seed)
    sizes = {s: [rng.choice([0, 1, 3, 9, 40]) for _ in range(rng.choice([3, 60, 400]))] for s in "abc"}
    targets = [(m, s, rng.choice([0.5, 1.0, 3.0]), rng.choice([1, 2, 5]), total) for m, total in (("m", 900), ("n", 10**6), ("o", 0)) for s in "abd"]
    got = mix_of(spark, sizes, targets).selection().collect()
    assert {m: [(r["doc_id"], r["copy"]) for r in got if r["mix"] == m] for m in "mno"} == plain_mix(sizes, targets)
    assert [r["total"] for r in got if r["mix"] == "m"] == list(itertools.accumulate(r["n_tokens"] for r in got if r["mix"] == "m"))


def test_shares_follow_weights(spark):
    rng = random.Random(3)
    sizes = {"big": [rng.randrange(1, 20) for _ in range(2000)], "Small One": [rng.randrange(1, 20) for _ in range(300)]}
    m = mix_of(spark, sizes, [("m", "big", 3.0, 1, 8000), ("m", "small_one", 0.5, 1, 8000), ("m", " Small-One ", 0.5, 1, 8000)])
    by = {r["source"]: r for r in m.shares().collect()}
    assert 5980 <= by["big"]["tokens"] <= 6020 and 1980 <= by["small_one"]["tokens"] <= 2020 and by["small_one"]["target_share"] == 0.25
    assert 7980 <= sum(r["tokens"] for r in by.values()) <= 8000


def test_one_order_at_every_number_of_documents(spark):
    """A document more changes no place of the others."""
    orders = []
    for n in (4999, 5000):
        got = mix_of(spark, {"a": [1] * n}, [("m", "a", 1.0, 1, 10**6)]).selection().collect()
        orders.append([r["doc_id"] for r in got if r["doc_id"] != "a4999"])
    assert orders[0] == orders[1] and len(orders[0]) == 4999


def test_repeats_are_capped_and_what_is_short_goes_to_the_others(spark):
    m = mix_of(spark, {"a": [10] * 10, "b": [10] * 100, "z": [5]}, [("m", "a", 1.0, 3, 1000), ("m", "b", 1.0, 9, 1000), ("m", "none", 2.0, 1, 1000), ("m", "z", 0.0, 1, 1000), ("n", "z", None, None, 10)])
    shares = {(r["mix"], r["source"]): r for r in m.shares().collect()}
    assert shares["m", "a"]["tokens"] == 300 and shares["m", "a"]["most_copies"] == 3
    assert shares["m", "b"]["tokens"] == 700 and shares["m", "b"]["most_copies"] == 1
    assert shares["m", "none"]["tokens"] == shares["m", "z"]["tokens"] == shares["n", "z"]["tokens"] == 0
    short = mix_of(spark, {"a": [10] * 3}, [("m", "a", 1.0, 2, 1000)])
    assert short.shares().first()["tokens"] == 60


def test_the_time_by_which_a_total_is_reached():
    assert enough(100, [(1.0, 1000, 0), (3.0, 1000, 0)]) == 25 and enough(100, [(1.0, 1000, 10), (1.0, 20, 10)]) == 100
    assert enough(100, [(1.0, 60, 0)]) == float("inf") and enough(0, []) == float("inf")


def test_sources_in_one_spelling_and_empty_tables(spark):
    df = spark.createDataFrame([(" Subtitle  Export ",), ("SUBTITLE_EXPORT",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(source_name(F.col("s"))).collect()] == ["subtitle_export", "subtitle_export", None, ""]
    assert mix_of(spark, {"a": [1]}, [("m", "a", 1.0, 1, 0)]).selection().count() == 0
