"""Ordered scans with carried state, spread over as many tasks as the rows need.

Rows are range-sorted by a total order and pinned, so partition i holds what comes before
partition i + 1. Each partition is summed up in one small value; the values, one a
partition, are combined from left to right; then every partition is scanned again from
the state that its left neighbours leave. No key is gathered in one task, whatever part
of all rows it has.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.session import pinned

Batches = Iterator[pd.DataFrame]


def carried(df: DataFrame, order: Sequence[str | Column], summarise: Callable[[Batches], Any], combine: Callable[[Any, Any], Any], label: Callable[[Batches, Any, bool], Batches], schema: str, partitions: int | None = None, needs: Sequence[str] | None = None, ties: Sequence[str | Column] = ()) -> DataFrame:
    """``label`` over the range-sorted partitions of ``df``.

    ``summarise`` gives the summary of a partition's rows (None for no rows), ``combine`` the state
    behind a partition from that before it (None at the start) and its summary, ``label`` the result
    rows of a partition from the state before it and whether it is the last that has rows. ``needs`` names
    the columns that ``summarise`` reads, all by default. Rows equal by ``order`` are in one partition,
    sorted by ``ties``.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged = pinned(ranged.sortWithinPartitions(*order, *ties))

    def first(batches: Batches) -> Batches:
        summary = summarise(pdf for pdf in batches if len(pdf))
        if summary is not None:
            yield pd.DataFrame({"pid": [TaskContext.get().partitionId()], "summary": [pickle.dumps(summary)]})

    before: dict[int, Any] = {}
    state, last = None, -1
    read = ranged.select(*needs) if needs else ranged
    for row in sorted(read.mapInPandas(first, "pid int, summary binary").collect(), key=lambda r: r["pid"]):  # one row a partition
        before[row["pid"]] = state
        state, last = combine(state, pickle.loads(row["summary"])), row["pid"]

    def second(batches: Batches) -> Batches:
        pid = TaskContext.get().partitionId()
        if pid in before:
            yield from label((pdf for pdf in batches if len(pdf)), before[pid], pid == last)

    return ranged.mapInPandas(second, schema)


def key_text(column: Column) -> Column:
    """A key as text that compares plainly, null among them: '-' for null, else '+' and the value."""
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), column.cast("string")))


def _schema(df: DataFrame) -> str:
    return df.schema.simpleString()[len("struct<") : -1]


def numbered(df: DataFrame, order: Sequence[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with the place of each row by ``order``, which must be total, from ``first``."""

    def count(batches: Batches) -> int | None:
        return sum(map(len, batches)) or None

    def label(batches: Batches, state: int | None, _: bool) -> Batches:
        at = first + (state or 0)
        for pdf in batches:
            yield pdf.assign(**{name: np.arange(at, at + len(pdf))})
            at += len(pdf)

    return carried(df, order, count, lambda state, n: (state or 0) + n, label, f"{_schema(df)},{name}:bigint", needs=order[:1])


def runs(df: DataFrame, by: str, order: Sequence[str], value: Column, closes: Column | None = None, name: str = "run") -> DataFrame:
    """``df`` with the number of each row's run in its group, from 1: a run ends where ``value`` changes or a row ``closes`` it.

    ``order`` must be total within ``by``. A null value is a value like any other, a null ``closes`` doesn't close.
    """
    columns = df.columns
    rows = df.withColumns({"_by": key_text(F.col(by)), "_value": key_text(value), "_closes": F.coalesce(closes, F.lit(False)) if closes is not None else F.lit(False)})

    def fresh(pdf: pd.DataFrame, state: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """Where a group and where a run begins; ``state``: group, value and closes of the row before."""
        group, val, done = pdf["_by"].to_numpy(), pdf["_value"].to_numpy(), pdf["_closes"].to_numpy(bool)
        new = np.ones(len(pdf), bool)
        new[1:] = group[1:] != group[:-1]
        new[0] = state is None or state[0] != group[0]
        start = new.copy()
        start[1:] |= (val[1:] != val[:-1]) | done[:-1]
        if not new[0]:
            start[0] = state[1] != val[0] or state[2]
        return new, start

    def scan(batches: Batches, state: tuple | None):
        """(batch, run numbers, state): state is group, value, closes and number of the row before."""
        for pdf in batches:
            new, start = fresh(pdf, state)
            total = np.cumsum(start)
            firsts = np.flatnonzero(new)
            base = np.zeros(len(pdf), np.int64)
            if len(firsts):
                base[firsts[0] :] = np.repeat(total[firsts] - 1, np.diff([*firsts, len(pdf)]))
            number = total - base
            if not new[0]:
                number[: firsts[0] if len(firsts) else None] += state[3]
            state = (pdf["_by"].iat[-1], pdf["_value"].iat[-1], bool(pdf["_closes"].iat[-1]), int(number[-1]))
            yield pdf, number, state

    def summarise(batches: Batches) -> tuple | None:
        head, state = None, None
        for pdf, _, state in scan(batches, None):  # noqa: B007
            head = head or (pdf["_by"].iat[0], pdf["_value"].iat[0])
        return (head, state) if head else None

    def combine(state: tuple | None, summary: tuple) -> tuple:
        (group, val), end = summary
        if state is None or state[0] != group or end[0] != group:
            return end
        goes_on = state[1] == val and not state[2]
        return (*end[:3], state[3] + end[3] - goes_on)

    def label(batches: Batches, state: tuple | None, _: bool) -> Batches:
        for pdf, number, _state in scan(batches, state):
            yield pdf.assign(**{name: number})[[*columns, name]]

    return carried(rows, ["_by", *order], summarise, combine, label, f"{_schema(df)},{name}:bigint", needs=["_by", "_value", "_closes"])


def queued(df: DataFrame, by: str, order: Sequence[str], wanted: Column, length: Column, name: str) -> DataFrame:
    """``df`` with the place of each row in a queue: its wanted one, or where the row before it in its group ends.

    place_i = C_i + max over j <= i of (wanted_j - C_j), C being the summed lengths before a row. Sums and
    maxima combine, so partitions are scanned apart. ``wanted`` and ``length`` are whole numbers, not null.
    """
    columns = df.columns
    rows = df.withColumns({"_by": key_text(F.col(by)), "_want": wanted.cast("bigint"), "_len": length.cast("bigint")})

    def scan(batches: Batches, state: tuple | None):
        """(batch, places, state): state is group, lengths so far, largest want less lengths before it."""
        for pdf in batches:
            group, want, n = pdf["_by"].to_numpy(), pdf["_want"].to_numpy(np.int64), pdf["_len"].to_numpy(np.int64)
            firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            sizes = np.diff([*firsts, len(pdf)])
            before = np.cumsum(n) - n
            before -= np.repeat(before[firsts], sizes)
            top = pd.Series(want - before).groupby(np.repeat(np.arange(len(firsts)), sizes)).cummax().to_numpy()
            if state is not None and state[0] == group[0]:
                head = slice(0, sizes[0])
                top[head] = np.maximum(top[head] - state[1], state[2])
                before[head] += state[1]
            state = (group[-1], int(before[-1] + n[-1]), int(top[-1]))
            yield pdf, before + top, state

    def summarise(batches: Batches) -> tuple | None:
        head, state = None, None
        for pdf, _, state in scan(batches, None):  # noqa: B007
            head = head or pdf["_by"].iat[0]
        return (head, state) if head else None

    def combine(state: tuple | None, summary: tuple) -> tuple:
        group, end = summary
        if state is None or state[0] != group or end[0] != group:
            return end
        return (group, state[1] + end[1], max(state[2], end[2] - state[1]))

    def label(batches: Batches, state: tuple | None, _: bool) -> Batches:
        for pdf, places, _state in scan(batches, state):
            yield pdf.assign(**{name: places})[[*columns, name]]

    return carried(rows, ["_by", *order], summarise, combine, label, f"{_schema(df)},{name}:bigint", needs=["_by", "_want", "_len"])


def summed(df: DataFrame, by: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to and with each, by ``order``, total within ``by``.

    ``value`` is a whole number, null counts as 0. The result is in that order.
    """
    columns = df.columns
    rows = df.withColumns({"_by": key_text(F.col(by)), "_value": F.coalesce(value.cast("bigint"), F.lit(0))})

    def scan(batches: Batches, state: tuple | None):
        """(batch, sums, state): state is the group of the row before and its sum."""
        for pdf in batches:
            group, total = pdf["_by"].to_numpy(), np.cumsum(pdf["_value"].to_numpy(np.int64))
            firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            before = np.where(firsts > 0, total[firsts - 1], 0)
            if state is not None and state[0] == group[0]:
                before[0] = -state[1]
            total = total - np.repeat(before, np.diff([*firsts, len(pdf)]))
            state = (group[-1], int(total[-1]))
            yield pdf, total, state

    def summarise(batches: Batches) -> tuple | None:
        head, state = None, None
        for pdf, _, state in scan(batches, None):  # noqa: B007
            head = head or pdf["_by"].iat[0]
        return (head, state) if head else None

    def combine(state: tuple | None, summary: tuple) -> tuple:
        head, end = summary
        return end if state is None or state[0] != end[0] or head != end[0] else (end[0], state[1] + end[1])

    def label(batches: Batches, state: tuple | None, _: bool) -> Batches:
        for pdf, total, _state in scan(batches, state):
            yield pdf.assign(**{name: total})[[*columns, name]]

    return carried(rows, ["_by", *order], summarise, combine, label, f"{_schema(df)},{name}:bigint", needs=["_by", "_value"])


def counted(df: DataFrame, by: str, order: Sequence[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with the place of each row in its group by ``order``, total within it, from ``first``."""
    return summed(df, by, order, F.lit(1), name).withColumn(name, F.col(name) + (first - 1))


def medians(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Median of ``value`` of each group: ``by``, ``name`` and its count ``n``. Nulls don't count; a null in ``by`` is a value.

    Values are first counted, so equal ones are one row, and the middle places are found by an ordered scan: no
    group's values are gathered.
    """
    key = F.concat_ws("\x1f", *[key_text(F.col(c)) for c in by])
    per = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_k", key)
    upto = summed(per, "_k", ["_v"], F.col("_c"), "_upto")
    total = per.groupBy("_k").agg(F.sum("_c").alias("n"))
    middle = upto.join(total, "_k").where((F.col("_upto") >= F.floor((F.col("n") + 1) / 2)) & (F.col("_upto") - F.col("_c") < F.floor(F.col("n") / 2) + 1))
    # one value holds both middle places, or two hold one each
    return middle.groupBy(*by, "n").agg(F.avg("_v").alias(name)).select(*by, name, "n")


def with_next(df: DataFrame, by: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with ``value`` of the next row of its group, null for the last: a scan from the end."""
    columns = df.columns
    rows = df.withColumn("_by", key_text(F.col(by)))
    kind = df.schema[value].dataType.simpleString()
    back = [F.col(c).desc() for c in ("_by", *order)]

    def summarise(batches: Batches) -> tuple | None:
        end = None
        for pdf in batches:
            end = (pdf["_by"].iat[-1], pdf[value].iat[-1])
        return end

    def label(batches: Batches, state: tuple | None, _: bool) -> Batches:
        for pdf in batches:
            own, held = pdf["_by"].to_numpy(), pdf[value]
            following = held.shift(1)
            if state is not None and state[0] == own[0]:
                following.iloc[0] = state[1]
            changed = np.flatnonzero(own[1:] != own[:-1]) + 1
            following.iloc[changed] = None
            state = (own[-1], held.iat[-1])
            yield pdf.assign(**{name: following.astype(held.dtype if held.dtype == object else "Int64" if kind in ("bigint", "int") else "Float64")})[[*columns, name]]

    return carried(rows, back, summarise, lambda _, s: s, label, f"{_schema(df)},{name}:{kind}", needs=["_by", value])


def last_marks(line: DataFrame, forwards: bool, name: str) -> DataFrame:
    """Of each place that isn't a mark the nearest mark at or before it (``forwards``), or at or behind it, as ``name``.

    ``line``: _g (group), _at (place), _mark. Columns: _g, _at, ``name``; null where there is no mark on that side.
    """
    order = [F.col("_g"), F.col("_at"), F.col("_mark").desc()] if forwards else [F.col("_g"), F.col("_at").desc(), F.col("_mark").desc()]

    def scan(batches: Batches, state: tuple | None):
        """(batch, mark of each row, state): state is the group of the row before and its last mark."""
        for pdf in batches:
            group, at, mark = pdf["_g"].to_numpy(), pdf["_at"].to_numpy(float), pdf["_mark"].to_numpy(bool)
            held = pd.Series(np.where(mark, at, np.nan)).groupby(np.cumsum(np.concatenate([[True], group[1:] != group[:-1]]))).ffill().to_numpy()
            if state is not None and state[0] == group[0]:
                head = np.flatnonzero(group != group[0])
                head = slice(0, head[0] if len(head) else len(group))
                held[head] = np.where(np.isnan(held[head]), state[1], held[head])
            state = (group[-1], held[-1])
            yield pdf, held, state

    def summarise(batches: Batches) -> tuple | None:
        head, state = None, None
        for pdf, _, state in scan(batches, None):  # noqa: B007
            head = head or pdf["_g"].iat[0]
        return (head, state) if state else None

    def combine(state: tuple | None, summary: tuple) -> tuple:
        _, end = summary
        return state if state is not None and state[0] == end[0] and np.isnan(end[1]) else end

    def label(batches: Batches, state: tuple | None, _: bool) -> Batches:
        for pdf, held, _state in scan(batches, state):
            free = ~pdf["_mark"].to_numpy(bool)
            yield pd.DataFrame({"_g": pdf["_g"][free], "_at": pdf["_at"][free], name: pd.arrays.FloatingArray(np.nan_to_num(held[free]), np.isnan(held[free]))})

    return carried(line, order, summarise, combine, label, f"_g string, _at double, {name} double")
