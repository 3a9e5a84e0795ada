"""Splitting oversized text at natural boundaries by lexical cohesion.

The words left and right of a boundary are compared as two blocks; where their
similarity is lowest against the peaks on either side lies a valley, the edge of a
topic. Within what still fits, the deepest valley at the best kind of boundary (end of
a sentence, of a clause, of a word) is taken, and the next piece repeats the last words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from math import sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs that can end a sentence, those that need no space after them, and signs that may close behind them.
FINAL = ".!?…‥‼⁇⁈⁉؟۔।॥։።"
FINAL_UNSPACED = "。！？｡．﹒﹗﹖"
CLOSERS = "\"'”’»›)]}）］｝」』】〉》*"
CLAUSE = ",;:،؛，；：、､–—"
# Abbreviations whose dot ends no sentence, lower case, of several languages.
ABBREVIATIONS = frozenset("dr dra prof profa mr mrs ms mx st ste jr sen gov gen col capt lt sgt rev hon sr sra srta sres don dna hr fr frl herr mme mlle mm me mgr dipl ing inh vs cf approx ca bzw evtl ggf sog vgl zb z.b d.h u.a e.g i.e p.ex p.ej ej pág pag vol fig ed eds op cit av sn doç yrd öğr uzm bkz örn alb проф акад доц др г-н г-жа гр тов им ул см стр рис т.е т.к т.д напр prof-r".split())
#: Abbreviations only before a number, fixed values.
BEFORE_NUMBER = frozenset("no nr nos num núm nº n° art abs kap cap p pp s bd vol fig tab № стр гл п ст".split())

_INVISIBLE = "\u00ad\u200b-\u200f\u2060\ufeff"
_END = re.compile(f"(?P<mark>[{re.escape(FINAL + FINAL_UNSPACED)}][{re.escape(FINAL + FINAL_UNSPACED)}{_INVISIBLE}]*)(?P<close>[{re.escape(CLOSERS)}{_INVISIBLE}]*)")
_BEFORE = re.compile(r"[^\s(\[«“\"'¿¡]+$")
_UNSPACED = "\u3040-ヿ㐀-鿿ｦ-ﾟ\u0e00-\u0e7f"
#: Words: runs between spaces; in unspaced script a run of kanji or katakana with the hiragana behind it.
_WORD = re.compile(f"[㐀-鿿々〆]+[\u3040-ゟ]*|[゠-ヿｦ-ﾟ]+[\u3040-ゟ]*|[\u3040-ゟ]+|[\u0e00-\u0e7f]+|[^\\s{_UNSPACED}]+")
_LETTERS = re.compile(r"\w+")
_MARK = re.compile("[̀-ͯ\u200d️ﾞﾟ\udc00-\udfff]")


def sentence_ends(text: str) -> list[int]:
    """Places just behind each sentence; the last is the end of the text.

    What stands around a mark is judged by the 24 characters before it, which hold any abbreviation, and by the signs and the letter
    within 40 behind it; text further off says nothing of it.

    A dot ends none within a number, after an initial or an abbreviation, or where a small letter follows.
    """
    ends = []
    for m in _END.finditer(text):
        mark = re.sub(f"[{_INVISIBLE}]", "", m["mark"])
        after = text[m.end() : m.end() + 40].lstrip("".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))))
        following = after.lstrip()
        if following:
            spaced = after[0].isspace()
            unspaced = mark[-1] in FINAL_UNSPACED and mark[-1] != "．" or re.match(f"[{_UNSPACED}]", after) is not None
            if not (spaced or unspaced):
                continue
            first = following.lstrip("\"'“‘«([¿¡")[:1]
            if mark in (".", "．"):
                word = _BEFORE.search(text[max(0, m.start() - 24) : m.start()])
                word = re.sub(f"[{_INVISIBLE}]", "", word.group() if word else "")
                low = word.lower()
                if low in ABBREVIATIONS or len(word) == 1 and word.isalpha() and not re.match(f"[{_UNSPACED}]", word) or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):
                    continue
                if low in BEFORE_NUMBER and first.isdigit():
                    continue
            if spaced and first.islower():
                continue
        ends.append(m.end())
    whole = len(text.rstrip())
    if not ends or ends[-1] < whole:
        ends.append(len(text))
    return ends


def longest_sentence(text: str) -> int:
    """Characters of the longest sentence, without white space around it."""
    ends = sentence_ends(text)
    return max(len(text[a:b].strip()) for a, b in zip([0, *ends], ends))


class _Cohesion:
    """Depth of the valley at each gap between words."""

    def __init__(self, words: list[str], block: int):
        self.terms = [tuple(_LETTERS.findall(w.lower())) for w in words]
        self.block, self.known = block, {}

    def similarity(self, gap: int) -> float:
        if gap not in self.known:
            left = Counter(t for w in self.terms[max(0, gap - self.block) : gap] for t in w)
            right = Counter(t for w in self.terms[gap : gap + self.block] for t in w)
            dot = sum(n * right[t] for t, n in left.items() if t in right)
            size = sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
            self.known[gap] = dot / size if size else 0.0
        return self.known[gap]

    def depth(self, gap: int) -> float:
        here, total = self.similarity(gap), 0.0
        for step in (-1, 1):
            peak, at = here, gap + step
            while 0 < at < len(self.terms) and abs(at - gap) <= 2 * self.block and self.similarity(at) >= peak:
                peak, at = self.similarity(at), at + step
            total += peak - here
        return total


def split(text: str, limit: int = 280, overlap: int = 5, block: int = 12) -> list[tuple[int, int, int]]:
    """Pieces of a text as (from, to, characters repeated from the piece before).

    Every piece is at most ``limit`` characters and begins and ends with no white space.
    From the second on a piece begins with the last ``overlap`` words of the one before,
    or as many of them as half a piece holds. A text within the limit is one piece, a
    blank one none.
    """
    begin, stop = len(text) - len(text.lstrip()), len(text.rstrip())
    if begin >= stop:
        return []
    if stop - begin <= limit:
        return [(begin, stop, 0)]
    spans = [m.span() for m in _WORD.finditer(text)]
    starts, behind = [a for a, _ in spans], [b for _, b in spans]
    cohesion = _Cohesion([text[a:b] for a, b in spans], block)
    sentences = set(sentence_ends(text))
    kinds: tuple[list[int], list[int], list[int]] = ([], [], [])  # gaps: the word that would begin the next piece
    for k in range(1, len(spans)):
        kinds[2].append(k)
        if text[behind[k - 1] - 1] in CLAUSE:
            kinds[1].append(k)
        if any(e in sentences for e in range(behind[k - 1], starts[k] + 1)):
            kinds[0].append(k)
    out, start, done, repeated = [], begin, begin, 0
    while stop - start > limit:
        # words that may begin the next piece: what lies before ends within the limit, and something new is in it
        last = bisect_right(behind, start + limit)
        first = bisect_right(starts, done)
        cut = None
        for gaps in kinds:
            there = gaps[bisect_left(gaps, first) : bisect_right(gaps, last)]
            late = [k for k in there if starts[k] - done > limit // 4]
            if late or there:
                cut = max(late or there, key=lambda k: (round(cohesion.depth(k), 9), k))
                break
        if cut is not None:
            end, following = behind[cut - 1], starts[cut]
        else:  # a word longer than a piece
            end = start + limit
            while end > max(start, done) + 1 and _MARK.match(text[end]):
                end -= 1
            if end <= done:  # the repeated words left no room
                start, repeated = done, 0
                continue
            following = end
        stripped = len(text[start:end].rstrip()) + start
        out.append((start, stripped, repeated))
        done = following
        k = bisect_left(starts, end)
        back = max(0, k - overlap)
        while back < k and (following - starts[back] > limit // 2 or starts[back] <= start):
            back += 1
        start = starts[back] if back < k else following
        repeated = following - start
    out.append((start, stop, repeated))
    return out


def split_column(text: Column, limit: int = 280, overlap: int = 5, block: int = 12) -> Column:
    """(breakable, pieces) of a text: pieces are (piece from 1, char_from, char_to, repeated, text).

    breakable: 1 if no sentence is longer than the limit, else 0. Only texts above the limit
    go to Python; null and blank texts have no pieces.
    """

    @F.pandas_udf("struct<breakable:int,pieces:array<struct<piece:int,char_from:int,char_to:int,repeated:int,text:string>>>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, None))
                continue
            parts = split(t, limit, overlap, block)
            rows.append((int(longest_sentence(t) <= limit), [{"piece": i, "char_from": a, "char_to": b, "repeated": r, "text": t[a:b]} for i, (a, b, r) in enumerate(parts, 1)]))
        return pd.DataFrame(rows, columns=["breakable", "pieces"])

    return cut(F.when(F.length(text) > limit, text))


def split_rows(df: DataFrame, id: str, text: str, words: str | None = None, limit: int = 280, overlap: int = 5) -> DataFrame:
    """Pieces of each row: ``id``, size (characters of the whole), breakable, piece, char_from, char_to, repeated, text.

    The text is ``text``, or where that is null or blank the ``words`` (array of structs
    with a text) joined by single spaces; null words are left out. Rows within the limit are
    one piece as they are; rows without any text give none. Repeated rows are cut alike.
    """
    t = F.col(f"`{text}`")
    if words:
        joined = F.array_join(F.transform(F.col(f"`{words}`"), lambda w: w["text"]), " ")
        t = F.when(t.isNull() | ~t.rlike(r"(?U)\S"), joined).otherwise(t)
    base = df.select(F.col(f"`{id}`").alias(id), t.alias("_t")).where("_t IS NOT NULL AND _t <> ''").withColumn("size", F.length("_t"))
    cut = base.withColumn("_c", split_column(F.col("_t"), limit, overlap))
    whole = F.array(F.struct(F.lit(1).alias("piece"), F.lit(0).alias("char_from"), F.col("size").alias("char_to"), F.lit(0).alias("repeated"), F.col("_t").alias("text")))
    rows = cut.select(id, "size", F.coalesce("_c.breakable", F.lit(1)).alias("breakable"), F.explode(F.coalesce("_c.pieces", whole)).alias("_p"))
    return rows.select(id, "size", "breakable", "_p.*")
