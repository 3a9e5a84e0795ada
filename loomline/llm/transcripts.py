"""Raw transcript lines into clean, ordered speaker turns.

Three families of precedence constraints order the lines of a media item: timing (their
bounds), cues (times of the recording within the text) and dialogue order (arrival). A
range sort by time settles the timing edges between lines of different starts. What they
leave open, lines of one start and lines without any time, which follow the line before
them in arrival, is a small window: within it the edges of all families are built, an edge
that contradicts those of an earlier family is dropped, and the rest is ordered
topologically. The runs of one speaker are then numbered by a scan with carried state,
partition by partition.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.canonical import INVISIBLE
from loomline.llm.languages import Model, identify
from loomline.operators.intervals import milliseconds
from loomline.operators.scan import carried, key_text
from loomline.operators.timeline import DEFAULT_SPEAKER
from loomline.session import stored

# Hesitation sounds with repeated letters written once, of any language ...
HESITATIONS = frozenset("uhm erm hm mhm euh heu ehm ähm äh öhm öh ãh ahn hã uh eh эм хм э-э э-э-э えと えーと えっと ええと うーん んー あのー".split())
#: ... those that are words elsewhere, with the languages in which they are words ...
WORDS_IN = {"um": ("de", "pt"), "er": ("de", "tr", "uz")}
#: ... and letters that make a sound only when drawn out.
DRAWN = frozenset("meiıэмe")
# Words that open speech before a colon, by language: no names of speakers.
OPENERS = frozenset(
    "listen look note attention warning question answer remember wait well so hey okay quote today tomorrow "
    "mira mire escucha oye oiga atención nota pregunta respuesta recuerda espera bueno aviso "
    "olha olhe ouve escuta atenção pergunta resposta lembra espere bem "
    "écoute écoutez regarde regardez attention note question réponse rappel attends bon alors "
    "also hör hören schau achtung hinweis frage antwort warte moment gut merke "
    "dinle bak dikkat not soru cevap bekle tamam şöyle "
    "eshit eshiting qara qarang diqqat eslatma savol javob kut xo'sh mayli "
    "слушай слушайте смотри смотрите внимание заметка вопрос ответ помни подожди итак значит "
    "聞いて 見て 注意 質問 答え 待って".split()
)

_TIME = r"\d{1,3}:\d{2}:\d{2}(?:[.,]\d{1,3})?|\d{1,3}:\d{2}[.,]\d{3}"
_CUE = re.compile(rf"(?P<a>{_TIME})\s*-+>\s*(?P<b>{_TIME})")
_BARE_TIME = re.compile(rf"(?<![\d:])(?:{_TIME})(?![\d:])")
_BRACKET_TIME = re.compile(r"[\[({<]\s*(\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?)\s*[\])}>]")
_NUMBER = re.compile(r"^\W*(?:speaker|spk|sp|s)[\s._#-]*(\d{1,4})\W*$", re.I)
_VOICE = re.compile(r"<v(?:\.[^\s>]*)?\s+([^>]+)>", re.I)
_BRACKETED = re.compile(r"\(\(([^()]*)\)\)|\[([^\[\]]*)\]|\(([^()]*)\)|\{([^{}]*)\}|\*([^*\n]+(?:\n[^*\n]+)?)\*|<([^<>]*)>|【([^】]*)】|（([^）]*)）")
_NAME = r"[^\W\d_][\w'’.-]*(?: [^\W\d_][\w'’.-]*){0,2}"
#: A label with a colon, at the start of a line or behind a dash, chevrons or a sentence.
_COLON = re.compile(rf"(?:(?<=\s)|^)(?P<lead>(?:>>+\s*|[-–—]\s+)*)(?P<name>(?:speaker|spk|sp|s)[\s._#-]*\d{{1,4}}|{_NAME})(?P<os>\s*\((?:O\.?S\.?|V\.?O\.?|off)\))?\s?(?::|：)(?!\d)", re.I)
_NUMBER_DASH = re.compile(r"^(?:>>+\s*)?(?P<name>(?:speaker|spk)[\s._#-]*\d{1,4})\s+[-–—]\s+", re.I)
_NUMBERED = re.compile(r"(?<!\w)(?:(?:speaker|spk|sp)[\s._#-]*|s)(\d{1,4})(?!\w)", re.I)
_TOKEN = re.compile(r"\S+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SPACES = re.compile(r"\s+")
_UNSEEN = re.compile(f"[{INVISIBLE}]+")
_LONGER = re.compile(r"(.)\1{3,}")


def seconds(text: str) -> float:
    """Seconds of a time such as 1:02:03.5, 02:03 or 00:02:03,500."""
    total = 0.0
    for part in text.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def speaker_number(label: str | None) -> int | None:
    """Number of a speaker label in any of its spellings; None if it holds none."""
    if label is None:
        return None
    found = _NUMBER.match(unicodedata.normalize("NFKC", label))
    return int(found[1]) if found else None


def numbers_in(text: str) -> list[int]:
    """Numbers of the numbered labels in a text."""
    return [int(n) for n in _NUMBERED.findall(text)]


def _key(name: str) -> str:
    """A name whatever its case, width and spaces; dotless i counts as i."""
    return _SPACES.sub(" ", _folded(name)).strip().casefold().replace("\u0131", "i").replace("\u0307", "")


def _folded(text: str) -> str:
    """Without invisible characters, in compatibility form."""
    return unicodedata.normalize("NFKC", _UNSEEN.sub("", text))


def cues(text: str) -> tuple[float | None, float | None, float | None]:
    """(start, end) of a cue line in the text, and its first recording time."""
    cue = _CUE.search(text)
    if cue:
        return seconds(cue["a"]), seconds(cue["b"]), seconds(cue["a"])
    times = [m.group(1) for m in _BRACKET_TIME.finditer(text)] + [m.group() for m in _BARE_TIME.finditer(text)]
    return None, None, seconds(times[0]) if times else None


def _unmarked(text: str) -> str:
    """Without cue lines, recording times and plain markup; labels and notes stay."""
    text = _CUE.sub("\n", text)
    text = _BRACKET_TIME.sub(" ", text)
    text = _BARE_TIME.sub(" ", text)
    text = re.sub(r"</?(?:i|b|u|s|c|em|strong|font|ruby|rt)(?:[\s.][^<>]*)?>|</v>|\{\\[^{}]*\}", " ", text, flags=re.I)
    return re.sub(r"[♪♫♬♩]+(?![^\[(]*[\])])", " ", text)


def label_evidence(text: str) -> list[tuple[str, bool, str]]:
    """Possible speaker names of a line: (key, at the start, kind of evidence).

    A name in a voice tag, with an off-screen mark or in capitals before a colon is 'certain';
    'colon' and 'bracket' are possible only, as words of speech and notes stand there, too; 'speech' is a
    word with a colon right behind another label, so one that is spoken.
    """
    plain, found = _unmarked(text), []
    labels = {m.end() for m in _VOICE.finditer(plain)}
    labels |= {m.end() for m in _BRACKETED.finditer(plain) if speaker_number(next(g for g in m.groups() if g is not None)) is not None}

    def at_start(m: re.Match) -> bool:
        return not _EDGES.sub("", _BRACKETED.sub(" ", plain[: m.start()]))

    for m in _VOICE.finditer(plain):
        found.append((_key(m[1]), at_start(m), "certain"))
    for m in _COLON.finditer(plain):
        numbered = speaker_number(m["name"]) is not None
        certain = bool(m["os"]) or m["name"].isupper() and len(m["name"]) > 1 and _key(m["name"]) not in OPENERS
        if not numbered and not certain and any(0 <= m.start() - e and not plain[e : m.start()].strip() for e in labels):
            found.append((_key(m["name"]), False, "speech"))
        elif not numbered and (certain or at_start(m) and m["name"][0].isupper() and _key(m["name"]) not in OPENERS and not any(is_hesitation(t, None) for t in m["name"].split())):
            found.append((_key(m["name"]), at_start(m), "certain" if certain else "colon"))
        if numbered or certain:
            labels.add(m.end())
    for m in _BRACKETED.finditer(plain):
        inner = next(g for g in m.groups() if g is not None)
        if m.group()[0] in "[(" and re.fullmatch(_NAME, inner.strip()) and at_start(m):
            found.append((_key(inner), True, "bracket"))
    return [f for f in found if f[0]]


def _drawn_out(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def is_hesitation(token: str, lang: str | None) -> bool:
    """Whether a token is a hesitation sound, however drawn out and whatever signs are around it.

    Of those that some language has as words, it is one unless ``lang`` (of the media item) is such a language.
    """
    # more than three of a letter are as good as three
    return _is_sound(_LONGER.sub(r"\1\1\1", _EDGES.sub("", token).lower().replace("̇", "")), lang)


@lru_cache(maxsize=1 << 16)
def _is_sound(word: str, lang: str | None) -> bool:
    if not word:
        return False
    short = _drawn_out(word)
    if short in HESITATIONS:
        return True
    if short in WORDS_IN:
        # drawn out it is a sound in any language
        return lang not in WORDS_IN[short] or len(word) > len(short)
    letters = set(word) - {"-"}
    return len(word) > 1 and (letters <= {"i", "ı"} and "ı" in letters or len(letters) == 1 and letters <= DRAWN and (len(word) > 2 or word in ("mm", "мм", "ıı")))


def clean_words(text: str, lang: str | None) -> str:
    """Spoken words of a part without labels: no notes, no hesitations, single spaces."""
    text = _BRACKETED.sub(" ", text)
    text = re.sub(r"[♪♫♬♩]+|>>+", " ", text)
    kept = [t for t in _TOKEN.findall(text) if not is_hesitation(t, lang)]
    return " ".join(kept)


def n_words(text: str) -> int:
    """Tokens between white space that hold a letter or digit."""
    return sum(1 for t in text.split() if any(c.isalnum() for c in t))


def parts(text: str, names: dict[str, int], lang: str | None) -> list[tuple[int | None, bool, str]]:
    """Parts of a line by speaker: (number or None, has a label, clean text).

    ``names``: the speakers' names of the media item by key, with their numbers.
    """
    plain = _unmarked(text)
    marks: list[tuple[int, int, int | None]] = []  # from, to, number

    def add(m: re.Match, name: str, a: int, b: int) -> None:
        number = speaker_number(name)
        if number is not None or _key(name) in names:
            marks.append((a, b, number if number is not None else names[_key(name)]))

    for m in _VOICE.finditer(plain):
        add(m, m[1], *m.span())
    if m := _NUMBER_DASH.match(plain.lstrip()):
        shift = len(plain) - len(plain.lstrip())
        add(m, m["name"], m.start() + shift, m.end() + shift)
    for m in _COLON.finditer(plain):
        name, a = m["name"], m.start()
        if speaker_number(name) is None and _key(name) not in names:
            # speech before the label: only its last words can be the name
            words = name.split(" ")
            tail = next((k for k in range(1, len(words)) if _key(" ".join(words[k:])) in names), None)
            if tail is None:
                continue
            a, name = m.start("name") + len(" ".join(words[:tail])) + 1, " ".join(words[tail:])
        add(m, name, a, m.end())
    for m in _BRACKETED.finditer(plain):
        inner = next(g for g in m.groups() if g is not None)
        if m.group()[0] in "[(" and (speaker_number(inner) is not None or _key(inner) in names):
            b = m.end()
            if colon := re.match(r"\s?:", plain[b:]):
                b += colon.end()
            add(m, inner, m.start(), b)
    marks.sort()
    out, at, now, labelled = [], 0, None, False
    for a, b, number in marks:
        if a < at:
            continue
        said = clean_words(plain[at:a], lang)
        if n_words(said):
            out.append((now, labelled, said))
        at, now, labelled = b, number, True
    said = clean_words(plain[at:], lang)
    if n_words(said):
        out.append((now, labelled, said))
    return out


@dataclass
class _Turn:
    """State at a place in the order: the open turn."""

    media: str
    speaker: str
    number: int


def arranged(lines: Sequence[tuple[float | None, int]]) -> list[int]:
    """Places of the lines of one window, (cue or None, arrival), in topological order.

    Edges come by family, cues before arrival: each line with a cue precedes the next by cue, each line the next
    by arrival. An arrival edge that leads against those kept before it, through however many lines, is
    dropped. Of lines that are free the first by arrival comes first, after the lines that follow what was taken last.
    """
    n = len(lines)
    by_arrival = sorted(range(n), key=lambda i: lines[i][1])
    by_cue = sorted((i for i in range(n) if lines[i][0] is not None), key=lambda i: lines[i])
    rank = {i: k for k, i in enumerate(by_cue)}
    after: list[list[int]] = [[] for _ in lines]
    waits = [0] * n

    def edge(a: int, b: int) -> None:
        after[a].append(b)
        waits[b] += 1

    for a, b in zip(by_cue, by_cue[1:]):
        edge(a, b)
    # the place in the cues that each line lies behind by the edges kept so far: an edge to a line before that place would close a cycle
    behind = {i: k for i, k in rank.items()}
    last = -1
    for a, b in zip(by_arrival, by_arrival[1:]):
        last = behind.setdefault(a, last)
        if rank.get(b, n) > last:
            edge(a, b)
            behind.setdefault(b, last)
    free = [(lines[i][1], i) for i in range(n) if not waits[i]]
    heapify(free)
    out: list[int] = []
    while free:
        i = heappop(free)[1]
        stack = [i]
        while stack:  # a line without a cue follows the one before it in arrival at once
            i = stack.pop()
            out.append(i)
            for b in after[i]:
                waits[b] -= 1
                if not waits[b]:
                    if b in rank:
                        heappush(free, (lines[b][1], b))
                    else:
                        stack.append(b)
    return out


class Transcripts:
    """Clean speaker turns of transcript lines.

    ``df``: line_id, media_id, start_s, end_s, speaker_id, text; extra columns are ignored.
    A line delivered again (same media_id and bounds) counts once; of the copies that one is
    taken whose speaker is known, then the first to arrive; repeated rows are one. Bounds that are missing are those
    of the cue in the text, else its first recording time. A line without any is placed behind the one
    that arrived before it in its media item (before all others if there is none), with that one's end as its bounds. The
    speaker is that of the label in the text, else that of the column; a line with neither
    belongs to the speaker before it. Which words are names is decided within the media item alone. A name's
    number in it is the one that most of its lines have, for a name without any the first free one.
    ``model``, of problem 1, tells in which items "um" and "er" are words; without it they are sounds.
    Null media_id is a value like any other; null and blank texts say nothing.
    """

    #: Lines of one time that are arranged at once; where there are more, portions of as many by arrival.
    WINDOW = 1024

    def __init__(self, df: DataFrame, model: Model | None = None):
        cols = [F.col(c) for c in ("line_id", "media_id", "start_s", "end_s", "speaker_id", "text")]
        self.lines = df.select(*cols).withColumn("media_key", key_text(F.col("media_id")))
        self.model = model

    def _evidence(self) -> DataFrame:
        """Per media item: possible names with their numbers, numbers in use, and languages of the lines."""
        shared = self.lines.sparkSession.sparkContext.broadcast(self.model) if self.model is not None else None  # of fixed size

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                media = pdf["media_key"].to_numpy(dtype=object)
                folded = [_folded(t) if t else "" for t in pdf["text"]]
                for key, label, text in zip(media, pdf["speaker_id"], folded):
                    number = speaker_number(label)
                    if number is not None:
                        rows.append((key, "number", "", number))
                    rows.extend((key, "number", "", n) for n in numbers_in(text))
                    for name, at_start, kind in label_evidence(text):
                        rows.append((key, kind, name, number if at_start else None))
                if shared is not None:
                    for i, pieces in identify(shared.value, folded):
                        rows.extend((media[i], "lang", lang, None) for _, lang, _, unclear, _, _ in pieces if not unclear)
                out = pd.DataFrame(rows, columns=["media_key", "what", "value", "number"])
                # one row for equal evidence of a batch
                yield out.astype({"number": "Int32"}).groupby(["media_key", "what", "value", "number"], dropna=False, sort=False).size().rename("n").reset_index()

        seen = self.lines.select("media_key", "speaker_id", "text").mapInPandas(read, "media_key string, what string, value string, number int, n long")
        return stored(seen.groupBy("media_key", "what", "value", "number").agg(F.sum("n").alias("n")))

    def _profiles(self) -> DataFrame:
        seen = self._evidence()
        names = seen.where("what NOT IN ('lang', 'number')")
        per = names.groupBy("media_key", "value", "number").agg(F.sum("n").alias("n"), F.collect_set("what").alias("kinds")).groupBy("media_key", "value").agg(
            F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"),
            F.max_by("number", F.when(F.col("number").isNotNull(), F.struct("n", -F.col("number")))).alias("number"),
            F.sum(F.when(F.col("number").isNotNull(), F.col("n"))).alias("known"),
            F.max(F.when(F.col("number").isNotNull(), F.col("n"))).alias("most"),
        )
        has = lambda kind: F.array_contains("kinds", kind)
        # the lines of a name have one speaker; a word that is spoken, behind a label or by several, is none
        one = F.coalesce(F.col("most") >= 0.8 * F.col("known"), F.lit(True))
        per = per.where(has("certain") | (has("colon") & ~has("speech") & one))
        used = seen.where("what = 'number'").groupBy("media_key").agg(F.collect_set("number").alias("used"))
        known = per.groupBy("media_key").agg(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("value", "number"))).alias("named"), F.array_sort(F.collect_list(F.when(F.col("number").isNull(), F.col("value")))).alias("bare"))
        # names without a number take those that are free
        taken = F.coalesce("used", F.array().cast("array<int>"))
        free = F.slice(F.array_except(F.sequence(F.lit(0), F.size(taken) + F.size("bare")), taken), 1, F.size("bare"))
        bare = F.zip_with("bare", free, lambda v, n: F.struct(v.alias("value"), n.alias("number")))
        known = known.join(used, "media_key", "left").select("media_key", F.map_from_entries(F.concat("named", bare)).alias("names"))
        langs = seen.where("what = 'lang'").groupBy("media_key").agg(F.max_by("value", F.struct("n", "value")).alias("lang"))
        return known.join(langs, "media_key", "full")

    def spoken(self) -> DataFrame:
        """Parts of lines in which something is said, with speaker (null: as before), bounds and order.

        Order: at_ms is the start of the line, or of the line that it follows if it has none; chunk counts the lines
        without a time behind one line in portions of WINDOW, 0 for all others.
        """

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    if not r.text:
                        continue
                    text = _folded(r.text)
                    a, b, first = cues(text)
                    # the columns' bounds come first, then the cue's, then the first time in the text
                    start = r.start_s if r.start_s == r.start_s and r.start_s is not None else a if a is not None else first
                    end = r.end_s if r.end_s == r.end_s and r.end_s is not None else b if b is not None else start
                    start = end if start is None else start
                    names = {e["key"]: e["value"] for e in r.names} if r.names is not None else {}
                    own = speaker_number(r.speaker_id)
                    for k, (number, labelled, said) in enumerate(parts(text, names, r.lang)):
                        if number is None and (k == 0 or not labelled):
                            number = own
                        rows.append((r.media_key, start, end, first, r.line_id, k, None if number is None else f"SPEAKER_{number:02d}", said, n_words(said)))
                yield pd.DataFrame(rows, columns=["media_key", "start", "end", "cue", "line_id", "part", "speaker", "said", "n_words"])

        entries = F.when(F.col("names").isNotNull(), F.map_entries("names")).alias("names")
        joined = self.lines.join(self._profiles(), "media_key", "left").select("line_id", "media_key", "start_s", "end_s", "speaker_id", "text", entries, "lang")
        said = joined.mapInPandas(read, "media_key string, start double, end double, cue double, line_id long, part int, speaker string, said string, n_words int")
        # null and not NaN where there is none, in every column
        said = said.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("start", "end", "cue")})
        said = stored(said.withColumns({"from_ms": milliseconds(F.col("start")), "to_ms": milliseconds(F.col("end"))}).drop("start", "end"))
        # a line delivered again counts once; one without bounds is the same only as the same row
        again = F.when(F.col("from_ms").isNull(), F.col("line_id")).alias("own")
        lines = said.groupBy("media_key", "from_ms", "to_ms", again, "line_id").agg(F.max(F.when((F.col("part") == 0) & F.col("speaker").isNotNull(), 1).otherwise(0)).alias("known"))
        one = lines.groupBy("media_key", "from_ms", "to_ms", "own").agg(F.min_by("line_id", F.struct(-F.col("known"), "line_id")).alias("line_id")).select("media_key", "line_id", F.col("from_ms").alias("_from"))
        kept = said.join(one, ["media_key", "line_id"]).where(F.col("from_ms").eqNullSafe(F.col("_from"))).drop("_from").dropDuplicates(["media_key", "line_id", "part"])
        return self._placed(kept)

    def _placed(self, said: DataFrame) -> DataFrame:
        """With at_ms and chunk; a line without a time takes the place of the line that arrived before it."""
        timed = said.where("from_ms IS NOT NULL").withColumns({"at_ms": F.col("from_ms"), "chunk": F.lit(0).cast("bigint")})
        bare = said.where("from_ms IS NULL")
        items = bare.select("media_key").distinct()
        arrived = said.join(items, "media_key", "left_semi").groupBy("media_key", "line_id").agg(F.first("from_ms").alias("from_ms"), F.first("to_ms").alias("to_ms"))
        most = self.WINDOW

        def scan(batches: Iterator[pd.DataFrame], state: tuple | None):
            """(batch, states, state): a state is (media, from and to of the last timed line, lines since it)."""
            for pdf in batches:
                found = []
                for media, a, b in pdf[["media_key", "from_ms", "to_ms"]].itertuples(index=False):
                    if a == a and a is not None:
                        state = (media, int(a), int(b), 0)
                    elif state is None or state[0] != media:
                        state = (media, None, None, 1)
                    else:
                        state = (*state[:3], state[3] + 1)
                    found.append(state)
                yield pdf, found, state

        def summarise(batches: Iterator[pd.DataFrame]) -> tuple | None:
            state = None
            for _, _, state in scan(batches, None):  # noqa: B007
                pass
            return state

        def label(batches: Iterator[pd.DataFrame], state: tuple | None, _: bool) -> Iterator[pd.DataFrame]:
            for pdf, found, _state in scan(batches, state):
                free = pdf["from_ms"].isna().to_numpy()
                rows = [(m, line, s[1], s[3] // most, s[2]) for m, line, s, f in zip(pdf["media_key"], pdf["line_id"], found, free) if f]
                yield pd.DataFrame(rows, columns=["media_key", "line_id", "at_ms", "chunk", "end_ms"]).astype({"at_ms": "Int64", "end_ms": "Int64"})

        def combine(state: tuple | None, summary: tuple) -> tuple:
            if state is None or state[0] != summary[0] or summary[1] is not None:
                return summary
            return (*state[:3], state[3] + summary[3])

        if bare.isEmpty():
            return timed
        place = carried(arrived, ["media_key", "line_id"], summarise, combine, label, "media_key string, line_id long, at_ms long, chunk long, end_ms long", needs=["media_key", "from_ms", "to_ms"])
        bounds = {"from_ms": F.coalesce("end_ms", F.lit(0)), "to_ms": F.coalesce("end_ms", F.lit(0))}
        return timed.unionByName(bare.join(place, ["media_key", "line_id"]).withColumns(bounds).drop("end_ms"))

    def ordered(self) -> DataFrame:
        """Parts with their turn_no, from 1 in each media item."""
        order = ["media_key", "at_ms", "chunk"]
        most = self.WINDOW

        def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Batches in topological order: lines of one media item and time are arranged together, WINDOW of them at most."""
            held: pd.DataFrame | None = None
            for pdf in batches:
                pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                first = begins(pdf)
                cut = int(first[-1]) if len(pdf) - first[-1] <= most else len(pdf)
                held = pdf.iloc[cut:].reset_index(drop=True)
                if cut:
                    yield settled(pdf.iloc[:cut], first[first < cut])
            if held is not None and len(held):
                yield settled(held, begins(held))

        def begins(pdf: pd.DataFrame) -> np.ndarray:
            media, at, chunk = pdf["media_key"].to_numpy(dtype=object), pdf["at_ms"].fillna(-(2**62)).to_numpy(np.int64), pdf["chunk"].to_numpy(np.int64)
            return np.flatnonzero(np.concatenate([[True], (media[1:] != media[:-1]) | (at[1:] != at[:-1]) | (chunk[1:] != chunk[:-1])]))

        def settled(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
            line, cue = pdf["line_id"].to_numpy(np.int64), pdf["cue"].to_numpy(float)
            place = np.arange(len(pdf))
            for a, b in zip(first, np.append(first[1:], len(pdf))):
                if line[a] != line[b - 1]:  # more than the parts of one line
                    starts = a + np.flatnonzero(np.concatenate([[True], line[a + 1 : b] != line[a : b - 1]]))
                    ends = np.append(starts[1:], b)
                    way = arranged([(None if cue[i] != cue[i] else float(cue[i]), int(line[i])) for i in starts])
                    place[a:b] = np.concatenate([np.arange(starts[k], ends[k]) for k in way])
            return pdf.iloc[place]

        def scan(batches: Iterator[pd.DataFrame], state: _Turn | None):
            """(batch, turn numbers, speakers, state after it)"""
            for pdf in windows(batches):
                media, speaker = pdf["media_key"].to_numpy(), pdf["speaker"].to_numpy(dtype=object)
                numbers = np.empty(len(pdf), np.int64)
                for i in range(len(pdf)):
                    who = speaker[i]
                    if state is None or state.media != media[i]:
                        state = _Turn(media[i], who or DEFAULT_SPEAKER, 1)
                    elif who and who != state.speaker:
                        state = _Turn(media[i], who, state.number + 1)
                    numbers[i], speaker[i] = state.number, state.speaker
                yield pdf, numbers, speaker, state

        def summarise(batches: Iterator[pd.DataFrame]) -> tuple[str | None, _Turn] | None:
            """(first speaker, state at the end) of the last item; the first is None if lines of the speaker before are all there is."""
            first = state = None
            for pdf in windows(batches):
                own = pdf[pdf["media_key"] == pdf["media_key"].iat[-1]]
                for media, who in zip(own["media_key"].to_numpy(), own["speaker"].to_numpy(dtype=object)):
                    if state is None or state.media != media:
                        first, state = who, _Turn(media, who or "", 1 if who else 0)
                    elif who and who != state.speaker:
                        first = first or who
                        state = _Turn(media, who, state.number + 1)
            return (first, state) if state else None

        def combine(state: _Turn | None, summary: tuple[str | None, _Turn]) -> _Turn:
            first, end = summary
            if state is None or state.media != end.media:
                return _Turn(end.media, end.speaker or DEFAULT_SPEAKER, max(1, end.number))
            more = end.number - (first == state.speaker) if end.number else 0
            return _Turn(end.media, end.speaker or state.speaker, state.number + more)

        def label(batches: Iterator[pd.DataFrame], state: _Turn | None, _: bool) -> Iterator[pd.DataFrame]:
            at = TaskContext.get().partitionId() << 40  # partitions lie in order
            for pdf, numbers, speaker, _state in scan(batches, state):
                yield pdf.assign(speaker=speaker, turn_no=numbers, place=np.arange(at, at + len(pdf)))[["media_key", "turn_no", "place", "speaker", "from_ms", "to_ms", "line_id", "part", "said", "n_words"]]
                at += len(pdf)

        return carried(self.spoken(), order, summarise, combine, label, "media_key string, turn_no int, place long, speaker string, from_ms long, to_ms long, line_id long, part int, said string, n_words int", needs=["media_key", "at_ms", "chunk", "line_id", "cue", "speaker"], ties=["line_id", "part"])

    def turns(self) -> DataFrame:
        """media_id, turn_no, speaker_id, from_ms, to_ms, n_words, text."""
        texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), " ")
        per = self.ordered().groupBy("media_key", "turn_no").agg(F.first("speaker").alias("speaker_id"), F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms"), F.sum("n_words").cast("int").alias("n_words"), texts.alias("text"))
        return per.select(F.when(F.col("media_key") != "-", F.substring("media_key", 2, 1 << 30)).alias("media_id"), "turn_no", "speaker_id", "from_ms", "to_ms", "n_words", "text")
