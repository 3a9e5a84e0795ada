"""One form for text that looks the same, normalising only where a quick check fails.

A quick check finds the places whose characters are not in canonical form: wide and
narrow forms, marks that compose with their neighbour, invisible characters, unusual
spaces, typographic variants and, in words of another script, look-alike letters. Only
these places, with the characters at their borders, are normalised and spliced back
into the unchanged text. Rows without such a place never leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.session import stored

# Look-alike letters of other scripts beside the Latin letters they resemble.
CYRILLIC = "АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝ"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTXYaesijopcxyhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXocj"
ARMENIAN = "ՕՏՍօոսհցզյ"
ARMENIAN_AS_LATIN = "OSUonuhgqj"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏞᏟᏢᏦᏙᏴᎥᏌᏕ"
CHEROKEE_AS_LATIN = "DRTAJEWMHGZSLCPKVBiUS"
# Kanji, hiragana and bopomofo that resemble katakana.
KATAKANA_LIKE = "口力工夕卜八二千へべぺり"
KATAKANA_AS = "ロカエタトハニチヘベペリ"
# Typographic variants and the plain sign they stand for.
APOSTROPHES = "\u2018\u2019\u201a\u201b\u02bb\u02bc\u02bd\u02b9\u02c8\u2032\u2035`\u00b4\u055a\ua78c\u05f3\u02bf\u02be"
QUOTES = "\u201c\u201d\u201e\u201f\u2033\u2036\u3003\u05f4\u02ba"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\u2043\u02d7"
OTHER_SIGNS = {"…": "...", "⋯": "...", "‥": "..", "․": ".", "⁄": "/", "∕": "/", "∶": ":", "꞉": ":", "ː": ":", "‹": "<", "›": ">", "∼": "~", "˜": "~", "ǃ": "!"}
# Characters that show nothing, as ranges of a character class.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
# Wide and narrow forms, and Latin ligatures.
WIDE = "\uff01-\uff60\uff61-\uff9f\uffa1-\uffdc\uffe0-\uffee"
LIGATURES = "\ufb00-\ufb06\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3"
# Marks that combine, and letters that have a composed form other than themselves.
MARKS = "\u0300-\u034e\u0350-\u036f\u0483-\u0487\u1161-\u11ff\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099-\u309c\ufe20-\ufe2f"
# Letters and digits in other fonts, as mathematics and letter-like signs have them.
FONTS = "\u2102\u210a-\u2113\u2115\u2119-\u211d\u2124\u2128\u212c\u212d\u212f-\u2131\u2133\u2134\u2139\u213c-\u2140\u2145-\u2149\U0001d400-\U0001d7ff"
SINGLETONS = "\u0374\u037e\u0387\u1f71\u1f73\u1f75\u1f77\u1f79\u1f7b\u1f7d\u1fbe\u2126\u212a\u212b\uf900-\ufaff"

_SIGN_MAP = str.maketrans({**dict.fromkeys(APOSTROPHES, "'"), **dict.fromkeys(QUOTES, '"'), **dict.fromkeys(DASHES, "-"), **{k: v for k, v in OTHER_SIGNS.items() if len(k) == 1}})
#: Scripts with look-alikes: the range of their letters, and the Latin letter that each look-alike resembles.
_SCRIPTS = (
    ("A-Za-zÀ-ɏḀ-ỿ", {}),
    ("Ѐ-ԯ", dict(zip(CYRILLIC, CYRILLIC_AS_LATIN))),
    ("\u0370-\u03ff\u1f00-\u1fff", dict(zip(GREEK, GREEK_AS_LATIN))),
    ("\u0531-\u0587", dict(zip(ARMENIAN, ARMENIAN_AS_LATIN))),
    ("\u13a0-\u13ff\uab70-\uabbf", dict(zip(CHEROKEE, CHEROKEE_AS_LATIN))),
)
_AS_LATIN = {c: latin for _, doubles in _SCRIPTS for c, latin in doubles.items()}
#: Letters that say nothing of a word's script: the look-alikes, and the Latin letters that Cyrillic and Greek ones resemble. Those
#: of the rarer scripts leave Latin letters their say.
_SILENT = {*_AS_LATIN, *CYRILLIC_AS_LATIN, *GREEK_AS_LATIN}
_DOUBLES = {*_AS_LATIN, *_AS_LATIN.values()}
_RARE = {*ARMENIAN, *CHEROKEE}


def _table(doubles: dict[str, str]) -> dict[int, str]:
    """Every look-alike, and the Latin letter itself, as its form in a script; without a form there a letter of a rarer script is the Latin one, others stay."""
    own = {latin: c for c, latin in reversed(doubles.items())}
    latin = lambda c: _AS_LATIN.get(c, c)
    return {ord(c): own.get(latin(c), latin(c) if c in _RARE or not doubles else c) for c in _DOUBLES if c not in doubles}


_INTO = [_table(doubles) for _, doubles in _SCRIPTS]
_TO_KANA, _FROM_KANA = str.maketrans(KATAKANA_LIKE, KATAKANA_AS), str.maketrans(KATAKANA_AS, KATAKANA_LIKE)
_KANA_RUN = re.compile(f"[{KATAKANA_LIKE}{KATAKANA_AS}]+")
_KATAKANA, _KANJI, _HIRAGANA = re.compile("[\u30a1-\u30ff]"), re.compile("[\u4e00-\u9fff]"), re.compile("[\u3041-\u309f]")
_SIGNS = "".join(map(chr, _SIGN_MAP))
_CLASS = INVISIBLE + SPACES + WIDE + LIGATURES + FONTS + SINGLETONS + re.escape(_SIGNS)
#: Places that aren't canonical: the character or marks, with a base to their left.
_UNSTABLE = re.compile(f"[^\\s{MARKS}]?[{MARKS}]+|[{_CLASS}]")
_LETTER = [re.compile(f"[{letters}]") for letters, _ in _SCRIPTS]
_OTHER = re.compile("[" + "".join(letters for letters, _ in _SCRIPTS[1:]) + "]")
_WORD = re.compile(f"[^\\W\\d_](?:[^\\W\\d_]|[{MARKS}])*(?:'[^\\W\\d_](?:[^\\W\\d_]|[{MARKS}])*)*")


def _wide(c: str) -> str:
    kind = unicodedata.decomposition(c)
    if kind.startswith(("<wide>", "<narrow>", "<compat>", "<font>")) or not kind.startswith("<"):
        return unicodedata.normalize("NFKC", c)
    return c


@lru_cache(maxsize=1 << 16)
def _splice(piece: str) -> str:
    """Canonical form of an unstable place."""
    out = []
    for c in piece:
        if _INVISIBLE.match(c):
            continue
        if _SPACE.match(c):
            out.append(" ")
        elif _FORM.match(c):
            out.append(_wide(c))
        else:
            out.append(c)
    return unicodedata.normalize("NFC", "".join(out)).translate(_SIGN_MAP)


_INVISIBLE, _SPACE, _FORM = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{SPACES}]"), re.compile(f"[{WIDE}{LIGATURES}{FONTS}{SINGLETONS}]")


@lru_cache(maxsize=1 << 16)
def _own_script(word: str) -> tuple[int, ...]:
    """Letters of a word that only Latin, Cyrillic and so on has: no other script has one that looks so."""
    bases = [c for c in unicodedata.normalize("NFD", word) if c not in _SILENT]  # a letter with an accent is judged by its base
    return tuple(sum(1 for c in bases if letter.match(c)) for letter in _LETTER)


@lru_cache(maxsize=1 << 16)
def _in_script(word: str, script: int) -> str:
    """A word with its look-alikes in one script; the word itself where it has none of another."""
    apart = unicodedata.normalize("NFD", word)
    changed = apart.translate(_INTO[script])
    return word if changed == apart else unicodedata.normalize("NFC", changed)


def _settle_kana(m: re.Match) -> str:
    """Signs that katakana share with kanji or hiragana, by the characters at their border."""
    before, after = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
    if _KANJI.match(after) or not _KATAKANA.match(before + after) and not _KATAKANA.match(after) and (_KANJI.match(before) or _HIRAGANA.match(before) or _HIRAGANA.match(after)):
        return m.group().translate(_FROM_KANA)
    return m.group().translate(_TO_KANA)


def canonical(text: str | None) -> str | None:
    """The one form of all texts that look like this one; None stays None.

    Width, composition of accents, invisible characters, kinds of space, look-alike letters
    and typographic variants are made one; case, accents, punctuation and the number of
    spaces stay. The script of a word is that of its letters that have no double in the
    other scripts; a word without such letters follows the text, so two texts that look the
    same get the same scripts. Idempotent.
    """
    if not text or (text.isascii() and not _UNSTABLE.search(text)):
        return text
    # an invisible character must not part a letter from its mark
    seen = _INVISIBLES.sub("", text)
    seen = _UNSTABLE.sub(lambda m: _splice(m.group()), seen)
    if not unicodedata.is_normalized("NFC", seen):  # marks that met only now
        seen = unicodedata.normalize("NFC", seen)
    if any(c in seen for c in KATAKANA_LIKE):
        seen = _KANA_RUN.sub(_settle_kana, seen)
    if not _OTHER.search(seen):
        return seen
    own = [_own_script(w) for w in _WORD.findall(seen)]
    whole = tuple(map(sum, zip(*own))) if own else (1,)
    default = whole.index(max(whole))

    def settle(m: re.Match) -> str:
        mine = _own_script(m.group())
        return _in_script(m.group(), mine.index(max(mine)) if any(mine) else default)

    # word by word: a word of one script is spliced as it is
    return _WORD.sub(settle, seen)


_INVISIBLES = re.compile(f"[{INVISIBLE}]+")


def _java(chars: str) -> str:
    """A character class for the JVM's regular expressions."""
    return "".join(c if c == "-" else f"\\x{{{ord(c):x}}}" for c in chars)


def quick_check(text: Column) -> Column:
    """True where a text may not be canonical: it must be normalised to know. Null for null."""
    forms = text.rlike(f"[{_java(INVISIBLE + SPACES + WIDE + LIGATURES + FONTS + SINGLETONS + MARKS + KATAKANA_LIKE)}{_java(_SIGNS)}]")
    other = text.rlike("[\\x{370}-\\x{587}\\x{13a0}-\\x{13ff}\\x{1f00}-\\x{1fff}\\x{ab70}-\\x{abbf}]")
    # one script only, and a letter that no other script has: every word stays as it is
    doubled = CYRILLIC + "".join(c for c in map(chr, range(0x400, 0x530)) if unicodedata.normalize("NFD", c)[0] in CYRILLIC)
    plain = ~text.rlike("[A-Za-z\\x{c0}-\\x{24f}\\x{1e00}-\\x{1eff}]") & ((text.rlike("[\\x{400}-\\x{52f}&&[^" + _java(doubled) + "]]") & ~text.rlike("[\\x{370}-\\x{3ff}\\x{531}-\\x{587}\\x{13a0}-\\x{13ff}\\x{1f00}-\\x{1fff}\\x{ab70}-\\x{abbf}]")))
    return forms | (other & ~plain)


def canonical_column(text: Column) -> Column:
    """``canonical`` of a column; only rows that fail the quick check go to Python."""

    @F.pandas_udf("string")
    def fix(texts: pd.Series) -> pd.Series:
        return texts.map(canonical, na_action="ignore")

    return F.coalesce(fix(F.when(quick_check(text), text)), text)


def equal_looking_pairs(df: DataFrame, id: str, by: list[str], fields: list[str]) -> DataFrame:
    """Pairs of rows of one group whose values of a field differ but look the same.

    Columns: id_a, id_b (id_a < id_b), field. Rows with a null in ``by`` and values that
    are null or empty make no pairs. Values are paired, not rows: of each canonical form
    the different spellings are joined, then the rows that have them, so that repeated
    rows cost no more than the pairs they make.
    """
    long = None
    for f in fields:
        part = df.select(F.col(f"`{id}`").alias("id"), *(F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(by)), F.lit(f).alias("field"), F.col(f"`{f}`").alias("value"))
        long = part if long is None else long.unionByName(part)
    keys = [f"g{i}" for i in range(len(by))]
    long = long.where("value <> ''").dropna(subset=keys)
    form = long.withColumn("form", F.xxhash64(F.col("field"), canonical_column(F.col("value"))))
    rows = stored(form.select("id", *keys, "field", "form", "value", F.xxhash64("value").alias("v")))
    group = [*keys, "field", "form"]
    mixed = rows.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select(*group)
    rows = rows.join(mixed, group, "left_semi")
    spellings = rows.groupBy(*group, "v").agg(F.first("value").alias("value"))
    # the forms are compared by hash; the texts of the few spellings that meet decide
    spellings = spellings.withColumn("text", canonical_column(F.col("value")))
    a = spellings.select(*group, F.col("v").alias("v_a"), F.col("text").alias("t_a"))
    b = spellings.select(*group, F.col("v").alias("v_b"), F.col("text").alias("t_b"))
    both = a.join(b, group).where("v_a <> v_b AND t_a = t_b").select(*group, "v_a", "v_b")
    ids = rows.select(*group, "v", "id")
    left = both.join(ids.withColumnsRenamed({"v": "v_a", "id": "id_a"}), [*group, "v_a"])
    right = left.join(ids.withColumnsRenamed({"v": "v_b", "id": "id_b"}), [*group, "v_b"])
    return right.where("id_a < id_b").select("id_a", "id_b", "field")
