"""Slots for models, with deterministic stand-ins, and the dataflow that runs through them.

A slot is a typed function over Arrow batches; a model is built once in a worker, on
first use. The stand-ins need no model: they let the dataflow be run and tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators import timeline as T
from loomline.operators import vectors as V
from loomline.session import stored

KINDS = ("separator", "diarizer", "transcriber", "translator", "synthesizer", "speech_mask", "embedder")


@dataclass
class Registry:
    """Factories of slots by kind and name; a factory is called in the worker that needs it."""

    factories: dict[tuple[str, str], Callable] = field(default_factory=dict)

    def add(self, kind: str, name: str, factory: Callable) -> None:
        if kind not in KINDS:
            raise ValueError(f"a slot is one of {', '.join(KINDS)}")
        self.factories[kind, name] = factory

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.factories if k == kind)

    def get(self, kind: str, name: str) -> Callable:
        """The factory; an unknown name is an error that lists those there are. Nothing is built."""
        if (kind, name) not in self.factories:
            raise ValueError(f"no {kind} is named {name!r}; there are: {', '.join(self.names(kind)) or 'none'}")
        return self.factories[kind, name]

    def preflight(self, chosen: dict[str, str]) -> None:
        """Check all choices before anything is built."""
        for kind, name in chosen.items():
            self.get(kind, name)


_built: dict[tuple[str, str], object] = {}


def built(kind: str, name: str, factory: Callable):
    """The model of a slot, built on first use in a worker; that of another name of the kind is released."""
    if (kind, name) not in _built:
        for key in [k for k in _built if k[0] == kind]:
            del _built[key]
        _built[kind, name] = factory()
    return _built[kind, name]


def pick_diarizer(wanted: str, has_token: bool, names: list[str], best: str = "hosted", plain: str = "clustering") -> str:
    """'auto' is the best diarizer where a token allows it, else the plain one; any other name must exist."""
    if wanted == "auto":
        return best if has_token and best in names else plain
    if wanted not in names:
        raise ValueError(f"no diarizer is named {wanted!r}; there are: {', '.join(names)}")
    return wanted


def translate_column(registry: Registry, name: str, text: Column, source: Column, target: str) -> Column:
    """Translations by a slot ``f(texts, sources, target) -> texts``; blank texts stay empty and aren't sent."""
    factory = registry.get("translator", name)

    @F.pandas_udf("string")
    def translate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = built("translator", name, factory)
        for texts, sources in batches:
            out = pd.Series([""] * len(texts), dtype=object)
            there = texts.fillna("").str.strip() != ""
            if there.any():
                out[there.to_numpy()] = model(list(texts[there]), list(sources[there]), target)
            yield out

    return translate(text, source)


def synthesize_rows(registry: Registry, name: str, lines: DataFrame) -> DataFrame:
    """Takes of lines (media_id, seg_id, text, speed) by a slot ``f(text, speed) -> samples``: adds samples and seconds at its rate."""
    factory = registry.get("synthesizer", name)
    schema = lines.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = built("synthesizer", name, factory)
        for pdf in batches:
            takes = [model(t or "", s) for t, s in zip(pdf["text"], pdf["speed"])]
            yield pdf.assign(samples=takes, seconds=[len(t) / model.rate for t in takes])

    return lines.mapInPandas(run, f"{schema},samples:array<double>,seconds:double")


def flag_frames(registry: Registry, name: str, frames: DataFrame) -> DataFrame:
    """Frames (media_id, frame, samples) with is_speech by a slot ``f(samples) -> bool``."""
    factory = registry.get("speech_mask", name)
    kind = frames.schema["media_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = built("speech_mask", name, factory)
        for pdf in batches:
            yield pd.DataFrame({"media_id": pdf["media_id"], "frame": pdf["frame"], "is_speech": [bool(model(np.asarray(s, float))) for s in pdf["samples"]]})

    return frames.select("media_id", "frame", "samples").mapInPandas(run, f"media_id {kind}, frame long, is_speech boolean")


def embed_frames(registry: Registry, name: str, frames: DataFrame) -> DataFrame:
    """Frames with a vector by a slot ``f(samples) -> vector``."""
    factory = registry.get("embedder", name)
    kind = frames.schema["media_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = built("embedder", name, factory)
        for pdf in batches:
            yield pd.DataFrame({"media_id": pdf["media_id"], "frame": pdf["frame"], "vector": [np.asarray(model(np.asarray(s, float)), float) for s in pdf["samples"]]})

    return frames.select("media_id", "frame", "samples").mapInPandas(run, f"media_id {kind}, frame long, vector array<double>")


def separate_frames(registry: Registry, name: str, frames: DataFrame) -> DataFrame:
    """Frames as two tracks, 'vocals' and 'background', by a slot ``f(samples) -> (vocals, background)``."""
    factory = registry.get("separator", name)
    kind = frames.schema["media_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = built("separator", name, factory)
        for pdf in batches:
            both = [model(np.asarray(s, float)) for s in pdf["samples"]]
            for k, track in enumerate(("vocals", "background")):
                yield pd.DataFrame({"media_id": pdf["media_id"], "track": track, "frame": pdf["frame"], "samples": [b[k] for b in both]})

    return frames.select("media_id", "frame", "samples").mapInPandas(run, f"media_id {kind}, track string, frame long, samples array<double>")


def diarized(registry: Registry, name: str, frames: DataFrame, speakers: int | None = None) -> DataFrame:
    """Turns of media items by a slot ``f(registry, frames, speakers) -> turns``, which plans over whole tables.

    ``frames``: media_id, frame, samples, one a second; turns: media_id, start_ms, end_ms, speaker_id. ``speakers`` is how many
    there are in each item, if known. The factory is called on the driver; models that it needs come from other slots, in the workers.
    """
    return registry.get("diarizer", name)()(registry, frames, speakers)


def transcribed(registry: Registry, name: str, turns: DataFrame, rate: int, names: Sequence[str] = ()) -> DataFrame:
    """Timed words of turns by a slot ``f(samples, rate, names) -> [(text, start_ms, end_ms)]``, times from the turn's start.

    ``turns``: media_id, seg_id, speaker_id, start_ms, samples; a null or empty sound has no words. Columns: media_id, seg_id,
    speaker_id, word_idx, text, start_ms, end_ms. ``names`` are those that the model shall know.
    """
    factory, known = registry.get("transcriber", name), list(names)
    kind = turns.schema["media_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = built("transcriber", name, factory)
        for pdf in batches:
            rows = []
            for media, seg, speaker, start, samples in zip(pdf["media_id"], pdf["seg_id"], pdf["speaker_id"], pdf["start_ms"], pdf["samples"]):
                words = model(np.asarray(samples, float), rate, known) if samples is not None and len(samples) else []
                rows += [(media, seg, speaker, i, text, start + a, start + b) for i, (text, a, b) in enumerate(words)]
            yield pd.DataFrame(rows, columns=["media_id", "seg_id", "speaker_id", "word_idx", "text", "start_ms", "end_ms"])

    return turns.select("media_id", "seg_id", "speaker_id", "start_ms", "samples").mapInPandas(run, f"media_id {kind}, seg_id long, speaker_id string, word_idx int, text string, start_ms long, end_ms long")


def by_clustering(registry: Registry, frames: DataFrame, speakers: int | None = None) -> DataFrame:
    """Diarizer: frames with speech are embedded and clustered within their item, and regions of speech named by the clusters in them."""
    speech = stored(flag_frames(registry, "energy", frames).where("is_speech").select("media_id", "frame"))
    voices = V.clustered(embed_frames(registry, "spectrum", frames.join(speech, ["media_id", "frame"], "left_semi")), "media_id", "frame", "vector", k=speakers, distance=0.4)
    voices = stored(voices)
    second = lambda c: ((c * 1000).alias("w_start"), ((c + 1) * 1000).alias("w_end"))
    windows = voices.select("media_id", *second(F.col("frame")), F.col("cluster").cast("string").alias("label"))
    spans = speech.select("media_id", *second(F.col("frame"))).withColumnsRenamed({"w_start": "start_ms", "w_end": "end_ms"})
    return T.identify_regions(T.speech_regions(spans), windows)


def by_one_voice(registry: Registry, frames: DataFrame, speakers: int | None = None) -> DataFrame:
    """Diarizer: one turn of SPEAKER_00 over each item."""
    ends = frames.groupBy("media_id").agg(((F.max("frame") + 1) * 1000).cast("double").alias("end_ms"))
    return ends.select("media_id", F.lit(0.0).alias("start_ms"), "end_ms", F.lit(T.DEFAULT_SPEAKER).alias("speaker_id"))


def _lengths(samples: np.ndarray, rate: int, names: Sequence[str]) -> list[tuple[str, int, int]]:
    """Stand-in for a transcriber: a stretch of sound is a word of a letter for each 60 ms."""
    step = max(1, int(0.06 * rate))
    loud = np.abs(samples[: len(samples) // step * step].reshape(-1, step)).max(1) > 0.05 if len(samples) >= step else np.zeros(0, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.view(np.int8), [0]])))
    return [("x" * (b - a), int(a) * 60, int(b) * 60) for a, b in zip(edges[::2], edges[1::2])]


class _Tone:
    """A tone for each letter: as long as a text at 0.06 s a character, over its speed."""

    rate = 250

    def __call__(self, text: str, speed: float) -> np.ndarray:
        n = int(round(len(text) * 0.06 * self.rate / max(speed, 1e-6)))
        return 0.2 * np.sin(np.arange(n) * 0.5)


def _tagged(texts: list[str], sources: list[str], target: str) -> list[str]:
    return [f"[{s}>{target}] {t}" for t, s in zip(texts, sources)]


def stand_ins() -> Registry:
    """A registry of deterministic stand-ins for every slot."""
    r = Registry()
    r.add("separator", "halves", lambda: lambda x: (np.where(np.abs(x) >= 0.1, x, 0.0), np.where(np.abs(x) < 0.1, x, 0.0)))
    r.add("diarizer", "clustering", lambda: by_clustering)
    r.add("diarizer", "single", lambda: by_one_voice)
    r.add("transcriber", "lengths", lambda: _lengths)
    r.add("translator", "tagged", lambda: _tagged)
    r.add("synthesizer", "tone", _Tone)
    r.add("speech_mask", "energy", lambda: lambda x: bool(len(x) and np.sqrt((x * x).mean()) > 0.06))
    r.add("embedder", "spectrum", lambda: lambda x: np.abs(np.fft.rfft(np.pad(x, (0, max(0, 16 - len(x))))[:16]))[:8] + 1e-3)
    return r
