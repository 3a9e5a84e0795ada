"""Scalar formatting functions, as columns. A null argument gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(value: Column) -> Column:
    """At least two digits; longer numbers aren't cut."""
    return F.format_string("%02d", value.cast("bigint"))


def format_duration(seconds: Column) -> Column:
    """m:ss or h:mm:ss, rounded half up; empty for null and for less than a second."""
    total = F.floor(seconds + 0.5).cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    text = F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), pad(m), F.lit(":"), pad(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), pad(s)))
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (seconds < 1), F.lit("")).otherwise(text)


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with ``digits`` digits, nearest to the exact binary value, exact halves up (for values not below 0).

    format_number rounds the exact value, too, but halves to even: those it rounded down are put right.
    A half at so few digits can be exact only in a multiple of 1/1024.
    """
    v, scale = value.cast("double"), 10**digits
    low = F.floor(v * scale)
    half = (v * scale - low == 0.5) & (v * 1024 == F.floor(v * 1024))
    plain = lambda x: F.regexp_replace(F.format_number(x.cast("double"), digits), ",", "")
    return F.when(half, plain((low + 1) / scale)).otherwise(plain(v))


def format_count(value: Column) -> Column:
    """999, 1.4K, 12K, 3.5M: one digit below 10,000 and from a million on, a zero digit left out."""
    v = value.cast("double")
    trim = lambda c: F.regexp_replace(c, r"\.0$", "")
    return (
        F.when(v < 1000, value.cast("string"))
        .when(v < 10_000, F.concat(trim(fixed(v / 1000, 1)), F.lit("K")))
        .when(v < 1_000_000, F.concat(fixed(v / 1000, 0), F.lit("K")))
        .otherwise(F.concat(trim(fixed(v / 1_000_000, 1)), F.lit("M")))
    )


def format_bytes(size: Column) -> Column:
    """Two digits of GB from a GiB on, else one digit of MB."""
    v = size.cast("double")
    return F.when(v >= 2**30, F.concat(fixed(v / 2**30, 2), F.lit(" GB"))).otherwise(F.concat(fixed(v / 2**20, 1), F.lit(" MB")))


def episode_label(count: Column) -> Column:
    """'1 episode', '2 episodes'."""
    return F.concat(count.cast("string"), F.when(count == 1, F.lit(" episode")).otherwise(F.lit(" episodes")))


def parse_timestamp(text: Column) -> Column:
    """Timestamp of 'YYYY-MM-DD HH:MM:SS' in UTC, or of the form with T and a zone; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.when(text.contains("T"), F.try_to_timestamp(text)))


#: Units of time and their seconds, largest first.
UNITS = (("year", 31_536_000), ("month", 2_592_000), ("week", 604_800), ("day", 86_400), ("hour", 3_600), ("minute", 60))


def time_ago(then: Column, now: Column) -> Column:
    """'3 weeks ago' in the largest unit that fits; 'Just now' below a minute and for the future."""
    seconds = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / 1e6)
    text = F.lit("Just now")
    for name, size in reversed(UNITS):
        n = F.floor(seconds / size)
        text = F.when(n >= 1, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))).otherwise(text)
    return F.when(then.isNotNull() & now.isNotNull(), text)


def format_date(when: Column) -> Column:
    """'May 4, 2026' in UTC."""
    return F.date_format(when, "MMM d, yyyy")


def poster_hue(seed: Column) -> Column:
    """A stable hue from 0 to 359: a rolling hash by 31 over the code points, modulo 2**32, modulo 360."""
    chars = F.filter(F.split(seed, ""), lambda c: c != "")
    total = F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))
    return (total % 360).cast("int")


def split_list(text: Column) -> Column:
    """Parts of a comma list without outer blanks and empty parts."""
    return F.filter(F.transform(F.split(text, ","), lambda p: strip(p)), lambda p: p != "")


def normalize_list(text: Column, default: str, most: int = 6, longest: int = 30) -> Column:
    """At most ``most`` parts of at most ``longest`` characters, joined by ', '; ``default`` where there is none."""
    parts = F.transform(F.slice(split_list(text), 1, most), lambda p: F.substring(p, 1, longest))
    return F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), F.lit(default))


def valid_text(text: Column, most: int) -> Column:
    """The stripped text if it has 1 to ``most`` characters, else null."""
    t = strip(text)
    return F.when(F.length(t).between(1, most), t)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
