"""Languages of texts and of their pieces by error-correcting output codes.

Every language has a codeword; for each bit a binary classifier over the character
n-grams of a word predicts it. A word's loss against a codeword is the sum of the bits'
logistic losses, each weighted by how well that bit's classifier does on that language;
the codeword with the least loss wins, and where the next is close the decision is
flagged as ambiguous. The losses of the words of a text add up, and the cheapest path
through them, with a price on each change of language, gives the pieces. A piece whose
best codeword fits worse than one guessed without any evidence is in a language outside
the codes: it is rejected.

The classifiers are fitted on a bounded sample of labelled rows; labels may be wrong in
a part of them, as rows that a first fit contradicts are left out of the second.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.canonical import INVISIBLE, canonical

#: Languages of a model whose sample names fewer than two.
LANGUAGES = ("en", "es", "pt", "fr", "de", "tr", "uz", "ru", "ja")

# Two-letter codes of other languages, as labels write them.
OTHER_CODES = (
    "aa ab af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da dv dz ee el eo et eu fa ff fi fj fo fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu "
    "jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps qu rm rn ro rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw "
    "ta te tg th ti tk tl tn to ts tt tw ty ug uk ur ve vi vo wa wo xh yi yo za zh zu"
).split()
# Names and codes of the common languages, as labels write them.
NAMES = {
    "en": "en eng english inglés ingles inglês anglais englisch ingilizce ingliz английский 英語",
    "es": "es spa spanish español espanol castellano espanhol espagnol spanisch ispanyolca испанский スペイン語",
    "pt": "pt por portuguese português portugues portugués portugais portugiesisch portekizce португальский ポルトガル語",
    "fr": "fr fra fre french français francais francés francês französisch fransızca французский フランス語",
    "de": "de deu ger german deutsch alemán alemão allemand almanca nemis немецкий ドイツ語",
    "tr": "tr tur turkish türkçe turkce turco turc türkisch turk турецкий トルコ語",
    "uz": "uz uzb uzbek o'zbek o'zbekcha oʻzbek oʻzbekcha ozbek ўзбек ўзбекча узбекский uzbeco usbekisch ウズベク語",
    "ru": "ru rus russian русский ruso russo russe russisch rusça rus ロシア語",
    "ja": "ja jpn japanese 日本語 japonés japonês japonais japanisch japonca yapon японский",
}
_CODE = {code: code for code in OTHER_CODES} | {name: code for code, names in NAMES.items() for name in names.split()}

#: Words, and characters of words, whose scores a worker keeps.
_CACHE, _CACHE_CHARS = 1 << 18, 1 << 23
_UNSEEN = dict.fromkeys(c for a, b in (((0xAD, 0xAD), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFEFF, 0xFEFF), (0x180B, 0x180E), (0xFE00, 0xFE0F))) for c in range(a, b + 1))
assert all(re.match(f"[{INVISIBLE}]", chr(c)) for c in _UNSEEN)
_CJK = "ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿ｦ-ﾟ々〆"
_UNIT = re.compile(f"[{_CJK}]+|[^\\W\\d_{_CJK}]+(?:['’ʻʼ‘`´-][^\\W\\d_{_CJK}]+)*")
_IS_CJK = re.compile(f"[{_CJK}]")


def language_of_label(label: str | None) -> str | None:
    """Two-letter code of the language that a label names, however it writes it; None if it names none of these."""
    if not label:
        return None
    plain = canonical(unicodedata.normalize("NFKC", label)).strip().casefold().replace("i̇", "i")
    return _CODE.get(plain) or _CODE.get(re.split(r"[\s_\-(/,;.@]", plain, maxsplit=1)[0])


def label_column(label: Column) -> Column:
    """``language_of_label`` in the JVM."""
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    codes = F.create_map(*[F.lit(x) for pair in _CODE.items() for x in pair])
    return F.coalesce(codes[plain], codes[F.element_at(F.split(plain, r"[\s_\-(/,;.@]"), 1)])


def _shape(run: str) -> str:
    """A run of unspaced script by kinds of characters, repeats written once: h hiragana, k katakana, c kanji."""
    out = []
    for c in run:
        o = ord(c)
        kind = "h" if 0x3041 <= o <= 0x309F else "k" if 0x30A0 <= o <= 0x30FF or 0x31F0 <= o <= 0x31FF or 0xFF66 <= o <= 0xFF9F else "c"
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def units(text: str) -> list[str]:
    """Words of a text, and runs of unspaced script, without digits and signs."""
    text = text.translate(_UNSEEN)
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return _UNIT.findall(text)


def _spelled(word: str) -> str:
    word = word if word.isascii() else canonical(unicodedata.normalize("NFKC", word))
    return word.lower().replace("i\u0307", "i").replace("\u2019", "'")


def _key(word: str) -> int:
    return zlib.crc32((_shape(word) if _IS_CJK.match(word) else _spelled(word)).encode("utf-8", "surrogatepass"))


def _features(word: str, size: int) -> list[int]:
    """Hashed n-grams of 1 to 4 characters and the word itself; none for a run of katakana, which may be a name.

    Of a run of unspaced script the 1- and 2-grams of its characters, hiragana more telling than kanji, and of its kinds of characters.
    """
    if _IS_CJK.match(word):
        shape = _shape(word)
        if "h" not in shape and "c" not in shape:
            return []
        grams = {word[i : i + n] for n in (1, 2) for i in range(len(word) - n + 1)} | {"\u3000" + shape[i : i + n] for n in (1, 2, 3) for i in range(len(shape) - n + 1)}
        return sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % size for g in grams})
    w = f"^{_spelled(word)}$"
    grams = {w} | {w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)}
    grams -= {"^", "$"}
    return sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % size for g in grams})


def code_matrix(n: int, bits: int, seed: int = 1) -> np.ndarray:
    """Codewords (-1 and 1) of n classes: of many random matrices that with the farthest rows and no constant column."""
    rng, best, most = np.random.default_rng(seed), None, -1.0
    for _ in range(400):
        m = np.ones((n, bits), np.int8)
        for b in range(bits):
            m[rng.permutation(n)[: n // 2 + b % 2], b] = -1
        apart = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        spread = apart + 0.01 * np.mean([abs(int(m[:, i] @ m[:, j])) < n for i in range(bits) for j in range(i)])
        if spread > most:
            best, most = m, spread
    return best


@dataclass
class Model:
    """Bit classifiers over hashed n-grams, codewords and the weight of each bit for each language."""

    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    size: int
    lexicon: frozenset = frozenset()
    names: frozenset = frozenset()
    languages: tuple = LANGUAGES
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        feats = [_features(w, self.size) for w in words]
        out = np.zeros((len(words), self.code.shape[1]))
        for i, f in enumerate(feats):
            if f:
                out[i] = self.weights[f].sum(0) / np.sqrt(len(f))
        return out

    def parts(self, words: list[str]) -> np.ndarray:
        """What part of its score a word counts with: words that the sample doesn't have count half, and with a capital, as names do, a tenth."""
        return np.array([1.0 if _key(w) in self.lexicon else 0.1 if w[:1].isupper() else 0.5 for w in words])

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words in a table of scores, and that table; words are scored once a worker.

        Behind a word's scores stand, for each language, how much worse than without evidence its codeword fits, all NaN for a word without n-grams.
        """
        if "table" not in self.known or len(self.known["table"]) > _CACHE or self.known["chars"] > _CACHE_CHARS:
            self.known.update(index={}, table=np.zeros((0, 2 * len(self.code))), chars=0)
        index = self.known["index"]
        new = list(dict.fromkeys(w for w in words if w not in index))
        if new:
            start = len(index)
            index.update({w: start + i for i, w in enumerate(new)})
            margins = self.margins(new)
            loss = _losses(margins, self.code, self.trust)
            worse = loss - np.log(2) * self.trust.sum(1)
            worse[~margins.any(1)] = np.nan
            self.known["table"] = np.concatenate([self.known["table"], np.concatenate([(loss.mean(1, keepdims=True) - loss) * self.parts(new)[:, None], worse], 1)])
            self.known["chars"] += sum(map(len, new))
        return np.fromiter((index[w] for w in words), np.int64, len(words)), self.known["table"]


def _losses(margins: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    loss = np.zeros((len(margins), len(code)))
    for b in range(code.shape[1]):
        plus, minus = np.logaddexp(0, -margins[:, b]), np.logaddexp(0, margins[:, b])
        loss += np.where(code[:, b] > 0, plus[:, None], minus[:, None]) * trust[:, b]
    return loss


def fit(texts: list[str], labels: list[str], bits: int = 15, size: int = 1 << 16, steps: int = 60, rounds: int = 2, least_share: float = 0.002) -> Model:
    """Fit on labelled texts; the result depends on nothing else.

    The languages are those that ``least_share`` of the labels, and three at least, name.
    """
    named = Counter(lab for lab, t in zip(labels, texts) if lab and t)
    languages = tuple(sorted(lab for lab, n in named.items() if n >= max(3, least_share * named.total())))
    languages = languages if len(languages) > 1 else tuple(sorted({*LANGUAGES, *languages}))
    code = code_matrix(len(languages), bits)
    number = {lang: i for i, lang in enumerate(languages)}
    rows = [(words, number[lab]) for t, lab in zip(texts, labels) if lab in number and t and (words := units(t))]
    model = None
    for last in [False] * (rounds - 1) + [True]:
        kept = rows
        if model is not None and rows:
            found, table = model.numbers([w for words, _ in rows for w in words])
            begin = np.cumsum([0, *(len(words) for words, _ in rows[:-1])])
            best = np.add.reduceat(table[found, : len(code)], begin, axis=0).argmax(1)
            kept = [row for row, lang in zip(rows, best) if row[1] == lang]
        counts = Counter((w, lang) for words, lang in kept for w in words)
        # a first fit only has to tell wrong labels
        model = _fit(counts, code, size, steps if last else max(1, steps // 3))
        model.lexicon, model.names = _lexicon(counts, len(code))
        model.languages = languages
    return model


def _lexicon(counts: Counter, n: int) -> tuple[frozenset, frozenset]:
    """Keys of words that occur in the sample three times and mostly in one language, and of names, which occur in all alike and with a capital only."""
    per: dict[int, np.ndarray] = {}
    small, total = set(), np.zeros(n)
    for (word, lang), c in counts.items():
        per.setdefault(_key(word), np.zeros(n))[lang] += c
        total[lang] += c
        if not word[:1].isupper():
            small.add(_key(word))
    words, names = [], []
    for key, c in per.items():
        rate = c / np.maximum(total, 1)
        if c.sum() >= 3 and rate.max() >= 0.4 * rate.sum():
            words.append(key)
        elif c.sum() >= 3 and key not in small:
            names.append(key)
    return frozenset(words), frozenset(names)


def _fit(counts: Counter, code: np.ndarray, size: int, steps: int) -> Model:
    bits = code.shape[1]
    merged: dict[tuple, np.ndarray] = {}
    for (word, lang), n in counts.items():
        f = tuple(_features(word, size))
        if f:
            merged.setdefault(f, np.zeros(len(code)))[lang] += n
    if not merged:
        return Model(code, np.zeros((size, bits), np.float32), np.ones((len(code), bits)), size)
    feats, n = list(merged), np.array(list(merged.values()))
    share = n / np.maximum(n.sum(0), 1)  # each language weighs the same, whatever its rows
    # frequent words shall not drown the rest
    weight = share.sum(1, keepdims=True)
    share = share / np.sqrt(weight + 1e-12)
    share /= share.sum()
    indices = np.concatenate([np.array(f) for f in feats])
    lengths = np.array([len(f) for f in feats])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    scale = 1 / np.sqrt(lengths)
    used, local = np.unique(indices, return_inverse=True)
    plus = share @ (code > 0)  # weight of a word's ones and zeros, by bit
    minus = share @ (code < 0)
    plus, minus, scale = (x.astype(np.float32) for x in (plus, minus, scale))  # half the memory to move
    w = np.zeros((len(used), bits), np.float32)
    squares = np.full(w.shape, 1e-12, np.float32)
    order = np.argsort(local, kind="stable")  # of all n-grams, those of one place together
    row_of, edges = np.repeat(np.arange(len(feats)), lengths)[order], np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(used)))[:-1]])
    for _ in range(steps):
        margin = np.add.reduceat(w[local], begin, axis=0) * scale[:, None]
        p = 1 / (1 + np.exp(-margin))
        slope = ((plus + minus) * p - plus) * scale[:, None]
        grad = np.add.reduceat(slope[row_of], edges, axis=0) + np.float32(1e-7) * w
        squares += grad * grad
        w -= np.float32(0.6) * grad / np.sqrt(squares)
    margin = np.add.reduceat(w[local], begin, axis=0) * scale[:, None]
    # trust in a bit for a language: share of its words whose bit is predicted, above chance
    right = np.stack([(share[:, [k]] * (np.sign(margin) == code[k])).sum(0) / max(share[:, k].sum(), 1e-12) for k in range(len(code))])
    trust = np.clip(right - 0.5, 0.01, None)
    trust = trust / trust.sum(1, keepdims=True) * bits
    weights = np.zeros((size, bits), np.float32)
    weights[used] = w
    return Model(code, weights, trust, size)


#: Price of a change of language, in units of a word's score; margin below which a decision is ambiguous; words from which on a piece may be rejected.
CHANGE, CLEAR, ENOUGH = 30.0, 12.0, 6
#: Units of a batch that are scored at once.
_AT_ONCE = 100_000
#: Characters of unspaced script that count as a word.
_PER_WORD = 4


_DRAWN, _REPEAT, _SYLLABLES = re.compile(r"(.)\1{3}"), re.compile(r"(.)\1+"), re.compile(r"(.{1,3}?)\1{2,}.?")


def _paths(scores: list[np.ndarray], change: float) -> list[np.ndarray]:
    """Cheapest language of each unit of each text, all texts in step, the longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    width = scores[0].shape[1]
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([scores[i] for i in order])
    value = np.zeros((len(order), width), flat.dtype)
    froms, switched = [], []
    for t in range(lengths[0] if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -t, "left"))  # texts longer than t
        v = value[:n]
        best = v.argmax(1)
        least = v[np.arange(n), best][:, None] - change
        froms.append(best.astype(np.int8))
        switched.append(v < least)
        value[:n] = np.maximum(v, least) + flat[begin[:n] + t]
    out = np.empty(len(flat), np.int8)
    now = np.zeros(len(order), np.int8)
    for t in range((lengths[0] if len(lengths) else 0) - 1, -1, -1):
        n = len(froms[t])
        ends = lengths[:n] == t + 1
        now[:n][ends] = value[:n][ends].argmax(1)
        out[begin[:n] + t] = now[:n]
        jump = switched[t][np.arange(n), now[:n]]
        now[:n] = np.where(jump, froms[t], now[:n])
    parts = np.split(out, begin[1:])
    found: list = [None] * len(scores)
    for i, part in zip(order, parts):
        found[i] = part
    return found


def _pieces(words: list[str], path: np.ndarray, least_words: int, least_chars: int) -> list[tuple[int, int, int]]:
    """(language, first unit, last unit + 1) of stretches that are long enough; neighbours of one language are one."""
    edges = np.flatnonzero(np.diff(path)) + 1
    out: list[tuple[int, int, int]] = []
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(path)]):
        spaced = sum(1 for w in words[a:b] if not _IS_CJK.match(w))
        unspaced = sum(len(w) for w in words[a:b] if _IS_CJK.match(w))
        if spaced >= least_words or unspaced >= least_chars:
            if out and out[-1][0] == path[a]:
                out[-1] = (out[-1][0], out[-1][1], b)
            else:
                out.append((int(path[a]), a, b))
    return out


def identify(model: Model, texts: list[str | None], change: float = CHANGE, clear: float = CLEAR, least_words: int = 4, least_chars: int = 10) -> Iterator[tuple[int, list[tuple[int, str | None, float, bool, int, int]]]]:
    """Yield (index, pieces) of each text: (piece, language, confidence, ambiguous, first unit, last unit + 1).

    One piece, numbered 0, if the text is in one language; else its pieces numbered from 1. A text
    without units has no piece. A piece of ENOUGH words and more that is rejected has the language None and confidence 0.
    """
    width = len(model.code)
    at = 0
    while at < len(texts):
        group, total = [], 0
        while at < len(texts) and (not group or total < _AT_ONCE):
            words = units(texts[at]) if texts[at] else []
            if words:
                group.append((at, words))
                total += len(words)
            else:
                yield at, []
            at += 1
        if not group:
            continue
        every = [w for _, words in group for w in words]
        numbers, table = model.numbers(every)
        # a run of unspaced script counts as a word for every few characters
        s = table[numbers, :width] * np.fromiter((max(1.0, len(w) / _PER_WORD) if w[0] >= "\u3041" and _IS_CJK.match(w) else 1.0 for w in every), float, len(every))[:, None]
        lengths = np.array([len(words) for _, words in group])
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        whole = np.add.reduceat(s, begin, axis=0)
        lead = whole.argmax(1)
        # a change can pay only if some stretch speaks against the leading language by more than its price
        text_of = np.repeat(np.arange(len(group)), lengths)
        against = s - s[np.arange(len(s)), lead[text_of]][:, None]
        run = np.cumsum(against, axis=0)
        start = np.concatenate([np.zeros((1, run.shape[1])), run])[begin]
        run -= start[text_of]
        step = float(np.abs(run).max()) * 2 + 1
        fenced = run - text_of[:, None] * step  # a later text lies wholly below the one before
        low = np.minimum.accumulate(np.concatenate([np.full((1, run.shape[1]), 0.0), fenced[:-1]]), axis=0)
        low = np.minimum(low, -text_of[:, None] * step)  # nothing taken yet
        rise = np.maximum.reduceat((fenced - low).max(1), begin)
        mixed = np.flatnonzero(rise > change)
        paths = dict(zip(mixed.tolist(), _paths([s[begin[i] : begin[i] + lengths[i]] for i in mixed], change))) if len(mixed) else {}
        for i, (index, words) in enumerate(group):
            found = _pieces(words, paths[i], least_words, least_chars) if i in paths else []
            if len({p[0] for p in found}) < 2:
                found = [(int(lead[i]) if not found else found[0][0], 0, len(words))]
            out = []
            for k, (lang, a, b) in enumerate(found, 1):
                sums = s[begin[i] + a : begin[i] + b].sum(0)
                margin = float(sums[lang] - np.delete(sums, lang).max())
                worse = table[numbers[begin[i] + a : begin[i] + b], width + lang]
                worse = worse[~np.isnan(worse)]
                if len(worse) >= ENOUGH and worse.mean() > 0:
                    out.append((k if len(found) > 1 else 0, None, 0.0, True, a, b))
                else:
                    out.append((k if len(found) > 1 else 0, model.languages[lang], float(1 / (1 + np.exp(-margin / clear))), margin < clear, a, b))
            yield index, out


def _is_cry(word: str) -> bool:
    """Whether a unit is a sound: one letter drawn out between few others, or a syllable over and over."""
    w = re.sub(r"[^\w]", "", word.casefold())
    return bool(_DRAWN.search(w)) and len(_REPEAT.sub(r"\1", w)) <= 4 or bool(_SYLLABLES.fullmatch(w))


def _wordless(model: Model, text: str) -> bool:
    """Whether no unit is a word of a language: cries, names of the sample, and katakana, which may be names."""

    def none_of(words: list[str]) -> bool:
        return all(_is_cry(w) or _IS_CJK.match(w) and set(_shape(w)) == {"k"} or _key(w) in model.names for w in words)

    # most texts have a word near their start; the last unit of the start may be cut
    return none_of(units(text[:400])[:-1]) and none_of(units(text))


def sample(df: DataFrame, id: str, text: str, label: str, rows: int = 12_000, shortest: int = 20, longest: int = 600) -> tuple[list[str], list[str]]:
    """Labelled rows to fit on: at most ``rows`` of those with ``shortest`` to ``longest`` characters, taken by a hash of the id. The one bounded sample here."""
    t, code = F.col(f"`{text}`"), label_column(F.col(f"`{label}`"))
    named = df.select(F.col(f"`{id}`").alias("id"), t.alias("text"), code.alias("label"), F.xxhash64(F.col(f"`{id}`")).alias("u")).where(F.col("label").isNotNull() & F.length("text").between(shortest, longest))
    # a threshold on the hash first, so that each partition sends its part of the sample and no more
    n = named.count()
    if n > 2 * rows:
        named = named.where(F.col("u") < int(-(2**63) + 2**64 * min(1.0, 1.5 * rows / n)))
    got = named.orderBy("u", "id", "text").limit(rows).select("text", "label").collect()
    return [r["text"] for r in got], [r["label"] for r in got]


def fit_on(df: DataFrame, id: str, text: str, label: str, rows: int = 12_000) -> Model:
    """``fit`` on the ``sample`` of a table."""
    return fit(*sample(df, id, text, label, rows))


def label_languages(df: DataFrame, model: Model, id: str, text: str, label: str) -> DataFrame:
    """Language of each record and of each piece of a mixed one.

    Columns: ``id``, label_language (what the label names, null if none of the languages),
    n_letters, piece (0 for the whole of a record in one language, else from 1), language,
    confidence, ambiguous, piece_text (null for piece 0). A record whose evidence is thin has its
    nearest language, ambiguous. One without words of any language (null or empty, numbers, names
    of the sample or cries only), or that is as near to two languages, has one row with a null
    language and confidence 0; so has a piece in a language that the model doesn't know. Repeated rows come out alike; extra columns are ignored. Nothing is shuffled.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            ids, labels, texts = pdf["id"].to_numpy(), pdf["label_language"].to_numpy(dtype=object), pdf["text"].to_numpy(dtype=object)
            rows = []
            for i, found in identify(model, texts):
                letters = sum(map(str.isalpha, texts[i])) if texts[i] else 0
                # thin evidence is still an answer; only where nothing speaks, or no word is there, is there none
                if not found or len(found) == 1 and (found[0][2] - 0.5 < 1e-9 or _wordless(model, texts[i])):
                    rows.append((ids[i], labels[i], letters, 0, None, 0.0, True, None))
                    continue
                spans = None
                if len(found) > 1:
                    clean = unicodedata.normalize("NFC", texts[i].translate(_UNSEEN))
                    spans = [m.span() for m in _UNIT.finditer(clean)]
                for piece, lang, sure, unclear, a, b in found:
                    rows.append((ids[i], labels[i], letters, piece, lang, sure, unclear, clean[spans[a][0] : spans[b - 1][1]] if spans else None))
            yield pd.DataFrame(rows, columns=["id", "label_language", "n_letters", "piece", "language", "confidence", "ambiguous", "piece_text"])

    cols = df.select(F.col(f"`{id}`").alias("id"), label_column(F.col(f"`{label}`")).alias("label_language"), F.col(f"`{text}`").alias("text"))
    out = cols.mapInPandas(run, f"id {kind}, label_language string, n_letters long, piece int, language string, confidence double, ambiguous boolean, piece_text string")
    return out.withColumnRenamed("id", id)
