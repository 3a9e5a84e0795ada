"""Operators over ordered timelines of spoken segments.

A timeline has media_id, seg_id, seg_idx, start_ms, end_ms, speaker_id and more; its one
total order is (start_ms, seg_idx, seg_id). Times are whole milliseconds, so sums and
comparisons are exact. Rows without valid bounds are no part of a timeline.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.intervals import milliseconds, periods_and_gaps
from loomline.operators.joins import nearest, overlapping, stab
from loomline.operators.scan import counted, queued, runs, with_next
from loomline.session import stored

ORDER = ("start_ms", "seg_idx", "seg_id")
DEFAULT_SPEAKER = "SPEAKER_00"
#: Signs that end a sentence in resegmentation, fixed values.
TERMINATORS = (".", "!", "?", "。", "！", "？", "؟")


def timeline(segments: DataFrame) -> DataFrame:
    """Segments with bounds in milliseconds; those whose bounds are missing or impossible are left out."""
    rows = segments.withColumns({"start_ms": milliseconds(F.col("start_s")), "end_ms": milliseconds(F.col("end_s"))})
    return rows.where("start_ms IS NOT NULL AND end_ms > start_ms AND media_id IS NOT NULL").drop("start_s", "end_s")


def speaker_at(points: DataFrame, at: str, id: str, turns: DataFrame) -> DataFrame:
    """Each point with the speaker of the turn that holds it, else of the nearest turn, else SPEAKER_00.

    ``turns``: media_id, turn_start, turn_end, turn_order, turn_speaker. The first turn in order
    that holds the point counts (start <= t < end); the distance of a turn is that of its nearer
    bound, the first turn in order winning ties.
    """
    key = ["media_id"]
    held = stab(points.select("media_id", id, at), at, turns, "turn_start", "turn_end", key)
    first = stored(held.groupBy("media_id", id).agg(F.min_by("turn_speaker", F.struct("turn_start", "turn_order")).alias("_held")))
    # only what no turn holds looks for the nearest one
    free = points.join(first, ["media_id", id], "left_anti")
    bounds = turns.select("media_id", "turn_speaker", "turn_start", "turn_order", F.explode(F.array("turn_start", "turn_end")).alias("_bound"))
    near = nearest(free, at, bounds, "_bound", key, ["turn_start", "turn_order"], F.col("turn_speaker"), "_near")
    out = [*points.columns, "speaker"]
    of_turns = points.join(first, ["media_id", id]).withColumn("speaker", F.coalesce("_held", F.lit(DEFAULT_SPEAKER))).select(*out)
    return of_turns.unionByName(near.withColumn("speaker", F.coalesce("_near", F.lit(DEFAULT_SPEAKER))).select(*out))


def words_of(segments: DataFrame) -> DataFrame:
    """Timed words in order, with the segment they come from; words without text or times are left out."""
    w = F.posexplode("words").alias("word_idx", "word")
    rows = segments.select("media_id", *ORDER, "speaker_id", w)
    rows = rows.withColumns({"word_text": F.col("word.text"), "word_start": milliseconds(F.col("word.start_s")), "word_end": milliseconds(F.col("word.end_s"))})
    return rows.where("word_text IS NOT NULL AND word_start IS NOT NULL AND word_end IS NOT NULL").drop("word")


def split_index(starts: list[int], ends: list[int], longest: int, pause: int = 150) -> int:
    """Where to force a split of a run of words that is too long, as the number of words before it.

    The largest pause of at least ``pause``, the last of equal ones; without one the first word
    that reaches ``longest``; without that all but the last word.
    """
    gaps = [(starts[i] - ends[i - 1], i) for i in range(1, len(starts)) if starts[i] - ends[i - 1] >= pause]
    if gaps:
        return max(gaps)[1]
    reached = next((i for i, e in enumerate(ends) if e - starts[0] >= longest), None)
    return max(1, reached if reached is not None else len(starts) - 1)


def forced_sizes(starts: list[int], ends: list[int], terminated: bool, longest: int, pause: int = 150) -> list[int]:
    """Sizes of the chunks of one run of words; a terminating last word ends the last chunk however long it is."""
    sizes, first = [], 0
    for i in range(len(starts)):
        if terminated and i == len(starts) - 1:
            break
        if ends[i] - starts[first] > longest:
            # a split leaves a rest that is looked at again with the next word only
            n = split_index(starts[first : i + 1], ends[first : i + 1], longest, pause)
            sizes.append(n)
            first += n
    return [*sizes, len(starts) - first] if first < len(starts) else sizes


def sentences(words: DataFrame, longest_ms: int | None = 12_000, pause_ms: int = 150) -> DataFrame:
    """Sentences of timed words: a new one at a change of speaker and after a word that ends in a terminator.

    A run of words longer than ``longest_ms`` is split by force (see ``split_index``); None splits
    nothing. Runs are found by a scan; only runs that are too long are looked at word by word.
    Columns: media_id, sentence (from 1, in order), start_ms, end_ms, speaker_id, text, n_words.
    """
    order = [*ORDER, "word_idx"]
    ends = F.regexp_replace("word_text", r"(?U)\s+$", "").rlike("[" + "".join(TERMINATORS) + "]$")
    runs_ = runs(words.withColumn("_ends", ends), "media_id", order, F.col("speaker_id"), F.col("_ends"), "_run")
    item = F.struct(*order, "word_text", "word_start", "word_end", "_ends", "speaker_id")
    grouped = runs_.groupBy("media_id", "_run").agg(F.array_sort(F.collect_list(item)).alias("w"))  # a run is a sentence
    if longest_ms is None:
        sized = grouped.withColumn("sizes", F.array(F.size("w")))
    else:
        too_long = F.array_max(F.col("w.word_end")) - F.col("w")[0]["word_start"] > longest_ms

        @F.pandas_udf("array<int>")
        def sizes(starts: pd.Series, ends: pd.Series, terminated: pd.Series) -> pd.Series:
            return pd.Series([forced_sizes(list(a), list(b), bool(t), longest_ms, pause_ms) if a is not None else None for a, b, t in zip(starts, ends, terminated)])

        only = lambda c: F.when(too_long, c)
        forced = sizes(only(F.col("w.word_start")), only(F.col("w.word_end")), F.element_at("w", -1)["_ends"])
        sized = grouped.withColumn("sizes", F.coalesce(forced, F.array(F.size("w"))))
    begin = F.transform("sizes", lambda n, i: F.struct(F.aggregate(F.slice(F.col("sizes"), 1, i), F.lit(0), lambda a, x: a + x).alias("at"), n.alias("n")))
    chunks = sized.select("media_id", "_run", "w", F.posexplode(begin).alias("_part", "_c"))
    part = F.slice(F.col("w"), F.col("_c.at") + 1, F.col("_c.n"))
    rows = chunks.withColumn("w", part).select("media_id", "_run", "_part", F.col("w")[0]["word_start"].alias("start_ms"), F.element_at("w", -1)["word_end"].alias("end_ms"), F.col("w")[0]["speaker_id"].alias("speaker_id"), F.trim(F.array_join(F.col("w.word_text"), " ")).alias("text"), F.size("w").alias("n_words"))
    if longest_ms is None:  # runs are numbered already
        return rows.withColumnRenamed("_run", "sentence").drop("_part")
    return counted(rows, "media_id", ["_run", "_part"], "sentence").drop("_run", "_part")


def runs_of(frames: DataFrame, by: str, frame: str, flag: Column) -> DataFrame:
    """Runs of neighbouring frames whose flag is true: ``by``, first_frame, last_frame. A null flag is false."""
    on = frames.where(F.coalesce(flag, F.lit(False)))
    # a frame lasts until the next, so frames that follow each other touch
    spans = periods_and_gaps(on.select(by, F.col(frame).alias("_a"), (F.col(frame) + 1).alias("_b")), [by], "_a", "_b").where("kind = 'period'")
    return spans.select(by, F.col("from_s").cast("bigint").alias("first_frame"), (F.col("to_s").cast("bigint") - 1).alias("last_frame"))


def speech_regions(spans: DataFrame, pause_ms: int = 350, least_ms: int = 400) -> DataFrame:
    """Spans of a media item with pauses up to ``pause_ms`` bridged, then without those under ``least_ms``."""
    padded = spans.select("media_id", "start_ms", (F.col("end_ms") + pause_ms).alias("_to"))
    merged = periods_and_gaps(padded, ["media_id"], "start_ms", "_to").where("kind = 'period'")
    rows = merged.select("media_id", F.col("from_s").cast("bigint").alias("start_ms"), (F.col("to_s").cast("bigint") - pause_ms).alias("end_ms"))
    return rows.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def identify_regions(regions: DataFrame, windows: DataFrame, least_ms: int = 400) -> DataFrame:
    """Regions of speech with the labels of the windows in them.

    ``windows``: media_id, w_start, w_end, label. A region is split at the middle between the centres
    of neighbouring windows that disagree; pieces under ``least_ms`` are dropped. A region without a
    window takes the label of that whose centre is nearest to its own. Labels are numbered SPEAKER_NN
    by first use; media items without windows keep their regions with SPEAKER_00.
    """
    r = regions.select("media_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    centre = (F.col("w_start") + F.col("w_end")) / 2
    pairs = overlapping(r, "r_start", "r_end", windows, "w_start", "w_end", ["media_id"]).withColumn("centre", centre)
    w = Window.partitionBy("media_id", "r_start").orderBy("w_start", "w_end", "label")
    before = F.lag(F.struct("label", "centre")).over(w)
    cut = F.when(before.isNull(), F.col("r_start").cast("double")).when(before["label"] != F.col("label"), (before["centre"] + F.col("centre")) / 2)
    cuts = pairs.withColumn("cut", cut).where("cut IS NOT NULL")
    v = Window.partitionBy("media_id", "r_start").orderBy("w_start", "w_end", "label")
    inside = cuts.withColumn("to", F.coalesce(F.lead("cut").over(v), F.col("r_end").cast("double"))).where(F.col("to") - F.col("cut") >= least_ms).select("media_id", F.col("cut").alias("start_ms"), F.col("to").alias("end_ms"), "label")
    bare = r.join(pairs.select("media_id", "r_start").distinct(), ["media_id", "r_start"], "left_anti").withColumn("middle", (F.col("r_start") + F.col("r_end")) / 2)
    marks = windows.withColumn("centre", centre)
    lent = nearest(bare, "middle", marks, "centre", ["media_id"], ["w_start", "w_end", "label"], F.col("label"), "lent")
    rest = lent.select("media_id", F.col("r_start").cast("double").alias("start_ms"), F.col("r_end").cast("double").alias("end_ms"), F.coalesce("lent", F.lit("")).alias("label"))
    every = inside.unionByName(rest)
    first = every.groupBy("media_id", "label").agg(F.min("start_ms").alias("_first"))
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("_first", "label")) - 1
    names = first.withColumn("speaker_id", F.concat(F.lit("SPEAKER_"), F.format_string("%02d", number))).drop("_first")
    return every.join(names, ["media_id", "label"]).select("media_id", "start_ms", "end_ms", "speaker_id")


def covered_windows(windows: DataFrame, frames: DataFrame, at: str, flag: str, least: float = 0.5) -> DataFrame:
    """Windows of which at least ``least`` of the frames are flagged; those without frames are left out."""
    cols = windows.columns
    found = stab(frames.select("media_id", at, flag), at, windows, "w_start", "w_end", ["media_id"])
    return found.groupBy(*cols).agg(F.avg(F.col(flag).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n_frames")).where(F.col("coverage") >= least)


def words_in_clips(words: DataFrame, clips: DataFrame) -> DataFrame:
    """Text of each clip: the words of its speaker that overlap it, in order.

    ``clips``: media_id, speaker_id, clip_start, clip_end, one a speaker. Clips without words have an empty text.
    """
    found = clips.join(words, ["media_id", "speaker_id"], "left").where(F.col("word_start").isNull() | ((F.col("word_start") < F.col("clip_end")) & (F.col("word_end") > F.col("clip_start"))))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("word_text").isNotNull(), F.struct(*ORDER, "word_idx", "word_text")))), lambda x: x["word_text"])
    said = found.groupBy("media_id", "speaker_id").agg(F.array_join(texts, " ").alias("text"))
    return clips.join(said, ["media_id", "speaker_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def speaker_bounds(segments: DataFrame) -> DataFrame:
    """Each segment with the start and end of the run of its speaker around it."""
    rows = runs(segments, "media_id", ORDER, F.col("speaker_id"), name="_run")
    place = F.struct(*ORDER)
    spans = rows.groupBy("media_id", "_run").agg(F.min_by("start_ms", place).alias("run_start"), F.max_by("end_ms", place).alias("run_end"))
    return rows.join(spans, ["media_id", "_run"]).drop("_run")


def placed(segments: DataFrame, wanted: Column, length: Column, gap_ms: int) -> DataFrame:
    """Each line with placed_ms: its wanted start, or just after the line before if that still plays."""
    return queued(segments, "media_id", ORDER, wanted, length + gap_ms, "placed_ms")


def with_room(segments: DataFrame, track_end: str) -> DataFrame:
    """Each line with room_ms: the time until the next line is due, for the last line until the track ends."""
    rows = with_next(segments, "media_id", ORDER, "start_ms", "_due")
    return rows.withColumn("room_ms", F.coalesce("_due", F.col(track_end)) - F.col("start_ms")).drop("_due")


def choose_speed(natural: Column, available: Column, original: Column, slowest: float, fastest: float | Column) -> Column:
    """Speed of a line: faster where it doesn't fit, slower where it leaves more than 15 % of its slot empty."""
    fastest = F.lit(fastest) if not isinstance(fastest, Column) else fastest
    return (
        F.when(natural <= 0, F.lit(1.0))
        .when(available <= 0, fastest)
        .when(natural > available, F.least(fastest, natural / available))
        .when((original > 0) & (natural < original * 0.85), F.greatest(F.lit(slowest), natural / original))
        .otherwise(F.lit(1.0))
    )


def speed_cap(lag: Column, natural: Column, available: Column, on_time: float, catch_up: float, after: float) -> Column:
    """Fastest allowed speed: the higher one if a line is late, or would end late at the lower one."""
    overrun = natural / on_time - F.greatest(available, F.lit(0.0))
    return F.when((lag > after) | (overrun > after), F.lit(catch_up)).otherwise(F.lit(on_time))


def plan_speeds(segments: DataFrame, natural: str, track_end: str, gap: float = 0.08, slowest: float = 0.9, on_time: float = 1.25, catch_up: float = 1.4, after: float = 0.3) -> DataFrame:
    """Start and speed of each line, in order: each depends on the speeds of those before it.

    Columns added: planned_start, speed, spoken (seconds). The fold runs over sorted partitions and
    holds one line at a time; a media item is the unit of parallelism, as its lines feed back.
    """
    rows = with_next(segments, "media_id", ORDER, "start_ms", "_next")
    cols = segments.columns
    ready = rows.select(*cols, F.coalesce("_next", F.col(track_end)).alias("_due")).repartition("media_id").sortWithinPartitions("media_id", *ORDER)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        media, end = None, -np.inf
        for pdf in batches:
            out = np.empty((len(pdf), 3))
            of, start_ms, end_ms = pdf["media_id"].to_numpy(), pdf["start_ms"].to_numpy(), pdf["end_ms"].to_numpy()
            due_ms, length = pdf["_due"].to_numpy(float), pdf[natural].to_numpy(float)
            for i in range(len(pdf)):
                if of[i] != media:
                    media, end = of[i], -np.inf
                wanted, slot, n = start_ms[i] / 1000, (end_ms[i] - start_ms[i]) / 1000, length[i]
                start = max(wanted, end + gap)
                free = due_ms[i] / 1000 - start
                late = start - wanted > after or n / on_time - max(free, 0.0) > after
                cap = catch_up if late else on_time
                if n <= 0:
                    speed = 1.0
                elif free <= 0:
                    speed = cap
                elif n > free:
                    speed = min(cap, n / free)
                elif slot > 0 and n < slot * 0.85:
                    speed = max(slowest, n / slot)
                else:
                    speed = 1.0
                if abs(speed - 1.0) < 0.02:
                    speed = 1.0
                spoken = n / speed
                end = start + spoken
                out[i] = start, speed, spoken
            yield pdf.drop(columns="_due").assign(planned_start=out[:, 0], speed=out[:, 1], spoken=out[:, 2])

    schema = segments.schema.simpleString()[len("struct<") : -1]
    return ready.mapInPandas(fold, f"{schema},planned_start:double,speed:double,spoken:double")


def lateness(plan: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Of each media item: lines, those that start late, and the worst delay in seconds."""
    delay = F.col("planned_start") - F.col("start_ms") / 1000
    return plan.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(delay > tolerance).alias("n_late"), F.round(F.coalesce(F.max(F.when(delay > tolerance, delay)), F.lit(0.0)), 6).alias("worst_delay"))


def sample_offset(start_ms: Column, rate: int) -> Column:
    """First sample of a line; halves go to the even sample."""
    return F.bround(start_ms * rate / 1000.0).cast("bigint")


def mixed_frames(lines: DataFrame, frame_ms: int, background: float, ceiling: float = 0.98) -> DataFrame:
    """Level of each frame of a media item: the background plus the lines that sound in it, below the ceiling.

    ``lines``: media_id, placed_ms, length_ms, level, track_ms. The track is as long as its last line
    needs. A media item whose peak exceeds ``ceiling`` is scaled down as a whole.
    """
    last = lines.groupBy("media_id").agg(F.max(F.greatest("track_ms", F.col("placed_ms") + F.col("length_ms"))).alias("_last"))
    frames = last.select("media_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("_last") - 1) / frame_ms))).alias("frame"))
    sounding = lines.where("length_ms > 0").select("media_id", "level", F.explode(F.sequence(F.floor(F.col("placed_ms") / frame_ms), F.floor((F.col("placed_ms") + F.col("length_ms") - 1) / frame_ms))).alias("frame"))
    voice = sounding.groupBy("media_id", "frame").agg(F.sum("level").alias("voice"))
    mix = frames.join(voice, ["media_id", "frame"], "left").select("media_id", "frame", (F.lit(background) + F.coalesce("voice", F.lit(0.0))).alias("mixed"))
    peaks = mix.groupBy("media_id").agg(F.max(F.abs("mixed")).alias("peak"))
    scale = F.when(F.col("peak") > ceiling, F.lit(ceiling) / F.col("peak")).otherwise(F.lit(1.0))
    return mix.join(peaks, "media_id").select("media_id", "frame", (F.col("mixed") * scale).alias("mixed"))


def borrowed(segments: DataFrame, reference: str, default: str) -> DataFrame:
    """Lines on the default reference take that of the line nearest by start that has another.

    The first line in order wins ties; where no line has another reference nothing changes. Adds ``borrowed``.
    """
    own = segments.where(F.col(reference) != default)
    poor = segments.where(F.col(reference) == default)
    lent = nearest(poor, "start_ms", own, "start_ms", ["media_id"], ["start_ms", "seg_idx", "seg_id"], F.col(reference), "lent")
    taken = lent.withColumn("borrowed", F.coalesce("lent", F.col(reference))).drop("lent", "lent_distance", "lent_order")
    return taken.unionByName(own.withColumn("borrowed", F.col(reference)))


def media_checks(segments: DataFrame, most_speakers: int = 12) -> DataFrame:
    """Of each media item: distinct speakers, whether they are too many, and whether anything is said."""
    return segments.groupBy("media_id").agg(
        F.countDistinct("speaker_id").alias("n_speakers"),
        (F.countDistinct("speaker_id") > most_speakers).alias("too_many"),
        F.coalesce(F.bool_or(F.col("text").rlike(r"(?U)\S")), F.lit(False)).alias("has_speech"),
    )


def single_speaker(media: DataFrame, duration: str) -> DataFrame:
    """One turn of SPEAKER_00 over the whole of each media item that lasts."""
    return media.where(F.col(duration) > 0).select("media_id", F.lit(0.0).alias("start_s"), F.col(duration).cast("double").alias("end_s"), F.lit(DEFAULT_SPEAKER).alias("speaker_id"))


def two_digits(seconds: Column) -> Column:
    """Rounded to two digits as the nearest to the exact binary value."""
    return F.regexp_replace(F.format_number(seconds, 2), ",", "").cast("double")
