"""Long exact spans shared between records, by chained seeds.

Seeds are k-mers picked by winnowing: of every ``window`` consecutive k-mers the one
with the least hash. Any span of ``k + window - 1 = min_chars`` characters therefore
holds a seed that is picked wherever the span occurs. Seeds that occur in two texts
are joined; per pair of texts the matches are chained in order with gap costs, the
best predecessor coming from a Fenwick tree; each chain is aligned on the texts
themselves, which gives the exact spans and the fuzzy passages around them.
Periodic text repeats a seed at even steps: such a row is one item (first, last, step),
chained by its ends and aligned over its whole extent on every shift.

Exact copies of one text form a class, so a group of copies is matched once. How much of
a text occurs elsewhere needs no pairs: the spans of min_chars around shared seeds are
counted by hash, and those of several classes are laid together, so the work grows with
the occurrences of shared text, not with the pairs of texts that share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.intervals import periods_and_gaps
from loomline.session import stored
from loomline.sources.tables import spread_by

#: Odd multipliers of the rolling hash, fixed values.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
_POS_BITS = 21
_CHUNK = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, kept per worker."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))))
    return _powers


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-mer; equal k-mers have equal hashes wherever they stand."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        terms = (codes.astype(np.uint64) * np.uint64(MIX) + np.uint64(1)) * power[:n]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        h = (total[k:] - total[:-k]) * inverse[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(29)
        h *= np.uint64(BASE)
        h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _pick(parts: list[tuple[int, int, np.ndarray]], k: int, window: int):
    """Winnowed seeds of some pieces of texts: arrays (text number, position, hash)."""
    lengths = np.array([len(c) for _, _, c in parts])
    codes = np.concatenate([c for _, _, c in parts])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    h = kmer_hashes(codes, k)
    low = np.uint64((1 << _POS_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    least = _sliding_min(key, window)
    # windows that lie within one piece
    inside = np.zeros(len(codes) + 1, np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + lengths - (k + window - 1) + 1, -1)
    ok = np.cumsum(inside)[: len(least)] > 0
    at = np.unique((least[ok] & low).astype(np.int64))
    piece = np.searchsorted(begin, at, "right") - 1
    number = np.array([n for n, _, _ in parts])[piece]
    offset = np.array([o for _, o, _ in parts])[piece]
    return number, at - begin[piece] + offset, h[at]


def _rows_of(seeds: pd.DataFrame, widest: int) -> pd.DataFrame:
    """Seeds (h, cls, pos) as items (h, cls, pos, last, step): rows of equal seeds at one step of at most ``widest``, and single ones with step 0.

    Every seed is in an item; where the step changes, one seed is in two.
    """
    seeds = seeds.sort_values(["cls", "h", "pos"], kind="stable")
    h, cls, pos = (seeds[c].to_numpy() for c in ("h", "cls", "pos"))
    step = np.diff(pos)
    linked = (cls[1:] == cls[:-1]) & (h[1:] == h[:-1]) & (step <= widest)
    alone = np.flatnonzero(~(np.append(linked, False) | np.append(False, linked)))[: len(pos)]
    # links of one step that follow each other are one row
    follows = linked[1:] & linked[:-1] & (step[1:] == step[:-1])
    first = np.flatnonzero(linked & ~np.append(False, follows)[: len(linked)])
    last = np.flatnonzero(linked & ~np.append(follows, False)[: len(linked)]) + 1
    at = np.concatenate([alone, first])
    return pd.DataFrame({"h": h[at], "cls": cls[at], "pos": pos[at], "last": np.concatenate([pos[alone], pos[last]]), "step": np.concatenate([np.zeros(len(alone), np.int32), step[first]])})


_ITEM = "h long, cls long, pos int, last int, step int"


def _seed_batches(batches: Iterator[pd.DataFrame], k: int, window: int) -> Iterator[pd.DataFrame]:
    span = k + window - 1

    def flush(cls: np.ndarray, parts):
        number, pos, h = _pick(parts, k, window)
        out = pd.DataFrame({"h": h.view(np.int64), "cls": cls[number], "pos": pos.astype(np.int32)})
        return _rows_of(out.drop_duplicates(), window)

    for pdf in batches:
        cls = pdf["cls"].to_numpy()
        parts, total = [], 0
        for i, text in enumerate(pdf["text"]):
            codes = _codes(text)
            for at in range(0, max(1, len(codes) - span + 1), _CHUNK - span):
                part = codes[at : at + _CHUNK]
                if len(part) < span:
                    continue
                if total + len(part) > _CHUNK and parts:
                    yield flush(cls, parts)
                    parts, total = [], 0
                parts.append((i, at, part))
                total += len(part)
        if parts:
            yield flush(cls, parts)


class Fenwick:
    """Prefix maxima with the index that holds them."""

    def __init__(self, n: int):
        self.best = [(-float("inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Largest of the places below ``i``."""
        found = (-float("inf"), -1)
        while i > 0:
            found = max(found, self.best[i])
            i -= i & -i
        return found


def chains(pos_a: np.ndarray, pos_b: np.ndarray, weight: float, gap: float) -> list[tuple[float, list[int]]]:
    """Collinear chains of anchors, best first; each anchor is in exactly one chain.

    A chain's score is ``weight`` an anchor less ``gap`` for every character that
    it skips in either text. Both positions rise strictly along a chain.
    """
    order = np.lexsort((-pos_b, pos_a))  # of one place in a, the farthest in b first: none follows another
    rank = np.searchsorted(np.unique(pos_b), pos_b)
    tree = Fenwick(int(rank.max()) + 1)
    score, back = np.zeros(len(order)), np.full(len(order), -1)
    for i in order:
        cost = gap * (pos_a[i] + pos_b[i])
        value, j = tree.upto(int(rank[i]))
        score[i] = weight
        if j >= 0 and value - cost > 0:
            score[i], back[i] = weight + value - cost, j
        tree.put(int(rank[i]), (score[i] + cost, int(i)))
    used, found = np.zeros(len(order), bool), []
    for i in sorted(range(len(order)), key=lambda i: (-score[i], i)):
        path, top = [], score[i]
        j = i
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(int(j))
            j = back[j]
        if path:
            found.append((float(top - (score[j] if j >= 0 else 0)), path[::-1]))
    return found


#: a_from to b_to: bounds of the whole chain; delta to delta_to by step: shifts on which lo_a to hi_a meets lo_b to hi_b.
_CHAIN = "cls_a long, cls_b long, chain int, score double, n_seeds int, a_from int, a_to int, b_from int, b_to int, delta int, delta_to int, step int, lo_a int, hi_a int, lo_b int, hi_b int"


def _chain_batches(batches: Iterator[pd.DataFrame], k: int, window: int, gap: float) -> Iterator[pd.DataFrame]:
    """One row a chain and diagonal, and one a pair of rows of seeds; what belongs to a pair comes together and in order."""

    def of_pair(pdf: pd.DataFrame) -> list[tuple]:
        a, b = pdf["cls_a"].iat[0], pdf["cls_b"].iat[0]
        fa, la, sa, fb, lb, sb = (pdf[c].to_numpy(np.int64) for c in ("pos_a", "last_a", "step_a", "pos_b", "last_b", "step_b"))
        ends = np.concatenate([np.stack([x, y], 1) for x in (fa, la) for y in (fb, lb)])
        ends = np.unique(ends, axis=0) if (sa | sb).any() else ends[: len(fa)]
        pa, pb = ends[:, 0], ends[:, 1]
        rows, of = [], {}
        for n, (score, path) in enumerate(chains(pa, pb, float(window), gap)):
            ca, cb = pa[path], pb[path]
            delta = cb - ca
            whole = (a, b, n, score, len(path), int(ca.min()), int(ca.max()) + k, int(cb.min()), int(cb.max()) + k)
            of |= dict.fromkeys(zip(ca.tolist(), cb.tolist()), whole)
            for d in np.unique(delta):
                on = ca[delta == d]
                lo, hi = int(on.min()), int(on.max()) + k
                rows.append((*whole, int(d), int(d), 1, lo, hi, lo + int(d), hi + int(d)))
        for i in np.flatnonzero(sa | sb):
            whole, x, y = of[int(fa[i]), int(fb[i])], range(fa[i], la[i] + 1, sa[i] or 1), range(fb[i], lb[i] + 1, sb[i] or 1)
            one = x if sa[i] and sb[i] and sa[i] != sb[i] else None  # steps differ: the seeds of one side by themselves
            for x in [range(p, p + 1) for p in one] if one else [x]:
                rows.append((*whole, y[0] - x[-1], y[-1] - x[0], int(sb[i] if one else sa[i] or sb[i]), x[0], x[-1] + k, y[0], y[-1] + k))
        return rows

    names = _CHAIN.replace(",", "").split()[::2]
    kept: pd.DataFrame | None = None
    for pdf in batches:
        if kept is not None:
            pdf = pd.concat([kept, pdf])
        last = (pdf["cls_a"] == pdf["cls_a"].iat[-1]) & (pdf["cls_b"] == pdf["cls_b"].iat[-1])
        kept, pdf = pdf[last], pdf[~last]
        rows = [r for _, g in pdf.groupby(["cls_a", "cls_b"], sort=False) for r in of_pair(g)]
        if rows:
            yield pd.DataFrame(rows, columns=names)
    if kept is not None and len(kept):
        yield pd.DataFrame(of_pair(kept), columns=names)


def _runs(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return [(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2]) if y - x >= least]


def _align_batches(batches: Iterator[pd.DataFrame], min_chars: int) -> Iterator[pd.DataFrame]:
    """Exact runs on the shifts of each chain; the part of a text begins at ``at_a`` or ``at_b``."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            a, b = _codes(r.part_a), _codes(r.part_b)
            for delta in range(r.delta, r.delta_to + 1, r.step):
                shift = delta + r.at_a - r.at_b  # place in part b of the first character of part a
                x, y = max(0, -shift), max(0, shift)
                n = min(len(a) - x, len(b) - y)
                if n >= min_chars:
                    for lo, hi in _runs(a[x : x + n] == b[y : y + n], min_chars):
                        rows.append((r.cls_a, r.cls_b, r.chain, r.at_a + x + lo, r.at_b + y + lo, hi - lo))
        if rows:
            yield pd.DataFrame(rows, columns=["cls_a", "cls_b", "chain", "a_from", "b_from", "length"])


class SharedSpans:
    """Spans of ``min_chars`` characters and more that occur verbatim in several records.

    ``df`` has ``id`` and ``text``; a null text counts as empty, ids are taken to be
    unique, extra columns are ignored. Texts shorter than ``min_chars`` share nothing.
    ``k`` is the length of a seed; ``gap`` the cost of a skipped character in a chain.
    A seed in more than ``hot`` texts is replaced by all spans of ``min_chars`` that
    hold it, so texts are paired only where they share such a span: no list of seeds
    is cut, and short text that many records share makes no pairs.
    """

    def __init__(self, df: DataFrame, id: str, text: str, min_chars: int = 200, k: int | None = None, gap: float = 0.1, hot: int = 64):
        if min_chars < 2:
            raise ValueError("min_chars must be 2 at least")
        self.min_chars, self.gap, self.hot = min_chars, gap, hot
        self.k = k or max(1, min_chars * 16 // 25)
        self.window = min_chars - self.k + 1
        if self.window < 1:
            raise ValueError("k must not exceed min_chars")
        t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        self.docs = df.select(F.col(f"`{id}`").alias("id"), t.alias("text"), F.xxhash64(t).alias("cls")).where(F.length("text") >= min_chars)
        self.all = df.select(F.col(f"`{id}`").alias("id"), F.length(t).cast("bigint").alias("n_chars"), F.xxhash64(t).alias("cls"), F.xxhash64(F.lit(1), t).alias("fp"))
        # copies are confirmed by a second hash of the text, 128 bits in all
        self.members = self.docs.select("id", "cls", F.xxhash64(F.lit(1), "text").alias("fp"))
        self._seeds: DataFrame | None = None
        self._spans: DataFrame | None = None
        self._chains: DataFrame | None = None

    def seeds(self) -> DataFrame:
        """(h, cls, pos, last, step) of the winnowed seeds, once for each class of equal texts."""
        k, window = self.k, self.window
        picked = self.docs.select("cls", "text").mapInPandas(lambda b: _seed_batches(b, k, window), _ITEM)
        return picked

    def _shared(self) -> DataFrame:
        """Seeds of several classes, with the number of items that have them."""
        if self._seeds is None:
            seeds = stored(self.seeds())
            of = seeds.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("h", "n")
            self._seeds = stored(seeds.join(of, "h").distinct())
        return self._seeds

    def _anchors(self) -> DataFrame:
        shared = self._shared()
        cold = shared.where(F.col("n") <= self.hot).drop("n")
        hot = shared.where(F.col("n") > self.hot)
        wide = self._widened(hot.select("cls", "pos", "last"))
        more = wide.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("h")
        return cold.unionByName(wide.join(more, "h"))

    def _widened(self, hot: DataFrame) -> DataFrame:
        """All spans of min_chars around hot seeds, by hash and as items."""
        span, window = self.min_chars, self.window
        texts = self.docs.select("cls", "text").dropDuplicates(["cls"])
        of = hot.groupBy("cls").agg(F.sort_array(F.collect_set(F.struct("pos", "last"))).alias("rows"))

        def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    codes, parts, done = _codes(r.text), [], 0
                    for row in r.rows:
                        at, to = max(row["pos"] - window + 1, done), min(row["last"] + 1, len(codes) - span + 1)
                        for x in range(at, to, _CHUNK):
                            y = min(to, x + _CHUNK)
                            parts.append(pd.DataFrame({"h": kmer_hashes(codes[x : y + span - 1], span).view(np.int64), "cls": r.cls, "pos": np.arange(x, y, dtype=np.int32)}))
                        done = max(done, to)
                    if parts:
                        yield _rows_of(pd.concat(parts), window)

        return of.join(texts, "cls").select("cls", "text", "rows").mapInPandas(hashes, _ITEM)

    def chains(self) -> DataFrame:
        """Chains of seeds of each pair of different texts, one row a diagonal."""
        if self._chains is None:
            found = self._anchors().select("h", "cls", "pos", "last", "step")
            a, b = (found.select("h", *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "pos", "last", "step"))) for x in "ab")
            pairs = a.join(b, "h").where("cls_a < cls_b").drop("h")
            by = ["cls_a", "cls_b"]
            pairs = spread_by(pairs, *by).sortWithinPartitions(*by, "pos_a", "pos_b")
            k, window, gap = self.k, self.window, self.gap
            self._chains = stored(pairs.mapInPandas(lambda b: _chain_batches(b, k, window, gap), _CHAIN))
        return self._chains

    def spans(self) -> DataFrame:
        """Exact spans of pairs of different texts: cls_a, cls_b, chain, a_from, b_from, length."""
        if self._spans is None:
            margin, chains = self.window, self.chains()
            needed = chains.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
            texts = self.docs.select("cls", "text").join(needed, "cls", "left_semi").dropDuplicates(["cls"])

            def cut(df: DataFrame, side: str, lo, hi) -> DataFrame:
                at = F.greatest(lo - margin, F.lit(0))
                t = texts.select(F.col("cls").alias(f"cls_{side}"), "text")
                return df.join(t, f"cls_{side}").withColumns({f"at_{side}": at, f"part_{side}": F.substring("text", at + 1, hi + margin - at)}).drop("text")

            cols = chains.select("cls_a", "cls_b", "chain", "delta", "delta_to", "step", "lo_a", "hi_a", "lo_b", "hi_b")
            both = cut(cut(cols, "a", F.col("lo_a"), F.col("hi_a")), "b", F.col("lo_b"), F.col("hi_b"))
            least = self.min_chars
            out = both.mapInPandas(lambda b: _align_batches(b, least), "cls_a long, cls_b long, chain int, a_from int, b_from int, length int")
            self._spans = stored(out.distinct())
        return self._spans

    def pairs(self) -> DataFrame:
        """Every pair of records with a common span: id_a < id_b."""
        m = self.members.select("id", "cls")
        linked = self.spans().select("cls_a", "cls_b").distinct()
        a, b = (m.select(F.col("cls").alias(f"cls_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
        across = linked.join(a, "cls_a").join(b, "cls_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        twin = self.members.join(self._copied().where("n > 1").select("cls", "fp"), ["cls", "fp"], "left_semi")
        x, y = twin.select("cls", "fp", F.col("id").alias("id_a")), twin.select("cls", "fp", F.col("id").alias("id_b"))
        return across.unionByName(x.join(y, ["cls", "fp"]).where("id_a < id_b").select("id_a", "id_b"))

    def _copied(self) -> DataFrame:
        """Classes of equal texts with their size and least id."""
        return self.members.groupBy("cls", "fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))

    def classes(self) -> DataFrame:
        """id and class_id, the least id with the same text, of each record of min_chars and more: with ``class_pairs`` all that ``pairs`` holds."""
        return self.members.join(self._copied().select("cls", "fp", F.col("id").alias("class_id")), ["cls", "fp"]).select("id", "class_id")

    def class_pairs(self) -> DataFrame:
        """Pairs of classes of different texts with a common span, by their class_id: class_a < class_b."""
        rep = self._copied().groupBy("cls").agg(F.min("id").alias("id"))
        a, b = (rep.select(F.col("cls").alias(f"cls_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
        linked = self.spans().select("cls_a", "cls_b").distinct().join(a, "cls_a").join(b, "cls_b")
        return linked.select(F.least("id_a", "id_b").alias("class_a"), F.greatest("id_a", "id_b").alias("class_b"))

    def _elsewhere(self) -> DataFrame:
        """Spans of min_chars that several classes hold: h, cls, pos, last, step, n_texts. Linear in the occurrences."""
        wide = stored(self._widened(self._shared().select("cls", "pos", "last")))
        of = wide.groupBy("h", "cls").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("one").alias("n_texts")).where("n_texts > 1")
        return wide.join(of, "h")

    def report(self) -> DataFrame:
        """Of each record: n_chars, chars that occur in another record, their share, its copies, and n_texts.

        shared_chars counts the characters of spans of min_chars and more that another record holds, all of them for a
        record with copies; n_texts the other texts that hold one such span, for the span that most of them hold.
        """
        found = self._elsewhere().select("cls", F.col("pos").alias("lo"), (F.col("last") + self.min_chars).alias("hi"), "n_texts")
        covered = periods_and_gaps(found, ["cls"], "lo", "hi").where("kind = 'period'").groupBy("cls").agg(F.sum(F.col("to_s") - F.col("from_s")).cast("bigint").alias("part"))
        most = found.groupBy("cls").agg((F.max("n_texts") - 1).alias("most"))
        per = self.all.join(self._copied().select("cls", "fp", "n"), ["cls", "fp"], "left").join(covered, "cls", "left").join(most, "cls", "left")
        shared = F.when(F.col("n") > 1, F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0)))
        return per.select("id", "n_chars", shared.alias("shared_chars"), F.coalesce(F.round(shared / F.nullif("n_chars", F.lit(0)), 6), F.lit(0.0)).alias("shared_part"), F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_copies"), F.coalesce("most", F.lit(0)).alias("n_texts"))

    def passages(self) -> DataFrame:
        """Fuzzy passages: one row a chain of different texts, by representatives.

        Ends are those of its seeds; exact_chars counts the characters of its verbatim spans of min_chars
        and more, where they overlap once.
        """
        one = self.chains().groupBy("cls_a", "cls_b", "chain").agg(*(F.first(c).alias(c) for c in ("score", "n_seeds", "a_from", "a_to", "b_from", "b_to")))
        by = ["cls_a", "cls_b", "chain"]
        # of the first text: shifts of periodic text overlap
        exact = periods_and_gaps(self.spans().withColumn("a_to", F.col("a_from") + F.col("length")), by, "a_from", "a_to").where("kind = 'period'").groupBy(*by).agg(F.sum(F.col("to_s") - F.col("from_s")).cast("bigint").alias("exact_chars"))
        rep = self.members.groupBy("cls").agg(F.min("id").alias("id"))
        a, b = (rep.select(F.col("cls").alias(f"cls_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
        both = one.join(exact, ["cls_a", "cls_b", "chain"], "left").join(a, "cls_a").join(b, "cls_b")
        turned = F.col("id_a") > F.col("id_b")
        sides = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("id_a", "id_b"), ("id_b", "id_a"), ("a_from", "b_from"), ("a_to", "b_to"), ("b_from", "a_from"), ("b_to", "a_to"))]
        return both.select(*sides, "chain", F.round("score", 3).alias("score"), "n_seeds", F.coalesce("exact_chars", F.lit(0)).alias("exact_chars")).select("id_a", "id_b", "chain", "score", "n_seeds", "a_from", "a_to", "b_from", "b_to", "exact_chars")
