"""Sources and sinks beside Parquet: JSON documents, text lists, YAML, audio containers, stored files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.formatting import strip


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str | None = None) -> DataFrame:
    """JSON documents of a folder, one a line; documents that are no JSON are left out."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).json(path)


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a text file, one a line; blank lines and those that begin with # are left out."""
    return spark.read.text(path).select(strip(F.col("value")).alias("name")).where("name <> '' AND NOT startswith(name, '#')")


def glossary(spark: SparkSession, text: str) -> DataFrame:
    """Terms and renderings of a YAML mapping; other YAML is an error, values become text."""
    import yaml

    loaded = yaml.safe_load(text) or {}
    if not isinstance(loaded, dict):
        raise ValueError("a glossary is a mapping of terms to renderings")
    return spark.createDataFrame([(str(k), str(v)) for k, v in loaded.items()], "term string, rendering string")


def settings(text: str, defaults: dict) -> dict:
    """Settings of a YAML text over defaults; unknown ones are an error, nested ones are merged."""
    import yaml

    def merge(base: dict, over: dict, at: str) -> dict:
        unknown = set(over) - set(base)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(at + k for k in unknown))}")
        return {k: merge(v, over[k] or {}, f"{at}{k}.") if isinstance(v, dict) and k in over else over.get(k, v) for k, v in base.items()}

    return merge(defaults, yaml.safe_load(text) or {}, "")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder by pattern: path, modificationTime, length, content; content is read only if selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


_WAV = "path string, sample_rate int, channels int, n_frames long, duration double"


def wav_headers(binary: DataFrame) -> DataFrame:
    """Sample rate, channels, frames and seconds of WAV files; files that aren't WAV get nulls."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rows.append((path, w.getframerate(), w.getnchannels(), w.getnframes(), w.getnframes() / w.getframerate()))
                except (wave.Error, EOFError, TypeError):
                    rows.append((path, None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "n_frames", "duration"]).astype({"sample_rate": "Int32", "channels": "Int32", "n_frames": "Int64"})

    return binary.select("path", "content").mapInPandas(read, _WAV)


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, mono samples in -1 to 1) of 8, 16 or 32 bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(float) / 2 ** (8 * width - 1)
    else:
        raise ValueError(f"PCM of {8 * width} bit isn't read")
    return rate, x.reshape(-1, channels).mean(1)


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    """16 bit mono PCM of samples in -1 to 1; NaN is silence."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(np.nan_to_num(np.asarray(x, float)) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def signal_of(binary: DataFrame) -> DataFrame:
    """Samples of WAV files as a signal: media_id (the path), n, x."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                _, x = decode_wav(content)
                yield pd.DataFrame({"media_id": path, "n": np.arange(len(x)), "x": x})

    return binary.select("path", "content").mapInPandas(read, "media_id string, n long, x double")


def wav_bytes(signal: DataFrame, rate: int) -> DataFrame:
    """Each signal as the content of a WAV file: media_id, content."""
    arrays = signal.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda v: v["x"]).alias("s"))

    @F.pandas_udf("binary")
    def encode(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: encode_wav(np.asarray(s), rate))

    return arrays.select("media_id", encode("s").alias("content"))


def streams(probe: Column) -> Column:
    """(has_video, has_audio) of a probe's CSV lines 'type,attached'; an attached picture is no video."""
    lines = F.transform(F.split(F.coalesce(probe, F.lit("")), r"\r?\n"), lambda x: F.split(F.trim(x), ","))
    video = F.exists(lines, lambda p: (F.get(p, F.lit(0)) == "video") & (F.coalesce(F.trim(F.get(p, F.lit(1))), F.lit("0")) != "1"))
    audio = F.exists(lines, lambda p: F.get(p, F.lit(0)) == "audio")
    return F.struct(F.coalesce(video, F.lit(False)).alias("has_video"), F.coalesce(audio, F.lit(False)).alias("has_audio"))


def result_path(path: Column, has_video: Column) -> Column:
    """Where a result goes: the wanted path, but for sound alone one that ends in .wav, .mp3 or .m4a ('.wav' in place of others)."""
    sound = F.lower(path).rlike(r"\.(wav|mp3|m4a)$")
    return F.when(has_video | sound, path).otherwise(F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".wav")))


def suffix(name: str) -> str:
    return PurePosixPath(name).suffix.lower()
