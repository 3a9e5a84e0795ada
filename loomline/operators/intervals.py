"""Continuous periods and gaps of overlapping intervals, without one task per entity.

The intervals are sorted globally by entity and start. Each partition is scanned
once for a summary (last entity, start of its last island, largest end), the
summaries, one small row a partition, are combined from left to right, and a second
scan labels islands with the state carried in from the left. An entity that holds
any share of all rows is thereby spread over as many partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.scan import carried, key_text


@dataclass
class Open:
    """State at a place in the sorted order: the entity's open period."""

    entity: tuple
    start: float
    end: float


def _after(left: Open | None, right: Open | None) -> Open | None:
    """State after a partition whose own final state is ``right``, entered with ``left``."""
    if right is None or left is None or left.entity != right.entity:
        return right or left
    # Sorted by entity, so the whole partition is of this entity. Its last island
    # stands on its own only if it starts after everything seen further left.
    own = right.start > left.end
    return Open(left.entity, right.start if own else left.start, max(left.end, right.end))


def _scan(batches: Iterator[pd.DataFrame], n_keys: int, state: Open | None, emit: bool):
    """Yield (closed periods and gaps of a batch, state after it)."""
    for pdf in batches:
        if not len(pdf):
            continue
        keys = [pdf.iloc[:, i].to_numpy() for i in range(n_keys)]
        start, end = pdf["_s"].to_numpy(float), pdf["_e"].to_numpy(float)
        change = np.ones(len(pdf), bool)
        change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        first = tuple(k[0] for k in keys)
        joins = state is not None and state.entity == first
        group = np.cumsum(change)
        reach = pd.Series(end).groupby(group).cummax().to_numpy()
        if joins:
            head = group == group[0]
            reach[head] = np.maximum(reach[head], state.end)
        before = np.empty(len(pdf))
        before[0] = state.end if joins else -np.inf
        before[1:] = reach[:-1]
        fresh = change.copy()
        fresh[0] = not joins
        breaks = np.flatnonzero(fresh | (start > before))
        rows = []
        if emit:
            # periods that close in this batch: the carried one, then all but the last
            ends = np.concatenate([breaks, [len(pdf)]])
            if state is not None and len(breaks):
                closed = reach[breaks[0] - 1] if breaks[0] else state.end
                rows.append(pd.DataFrame({**{f"_k{i}": [state.entity[i]] for i in range(n_keys)}, "kind": "period", "_s": state.start, "_e": closed}))
            if len(breaks) > 1:
                at, last = breaks[:-1], ends[1:-1] - 1
                rows.append(pd.DataFrame({**{f"_k{i}": k[at] for i, k in enumerate(keys)}, "kind": "period", "_s": start[at], "_e": reach[last]}))
            gaps = breaks[~fresh[breaks]]
            if len(gaps):
                rows.append(pd.DataFrame({**{f"_k{i}": k[gaps] for i, k in enumerate(keys)}, "kind": "gap", "_s": before[gaps], "_e": start[gaps]}))
        last_key = tuple(k[-1] for k in keys)
        state = Open(last_key, start[breaks[-1]] if len(breaks) else state.start, reach[-1])
        yield (pd.concat(rows) if rows else None), state


def periods_and_gaps(df: DataFrame, by: Sequence[str], start: str, end: str, partitions: int | None = None) -> DataFrame:
    """Merge the intervals of each entity; list its periods and the gaps between them.

    Columns of the result: ``by``, ``kind`` ('period' or 'gap'), ``from_s``, ``to_s``.
    Touching intervals are continuous. Rows whose start or end is null or NaN, or whose
    end is not after their start, are left out; a null in ``by`` is a value like any
    other. Repeated rows change nothing; an empty table gives an empty result. Extra
    columns are ignored.
    """
    n = len(by)
    s, e = F.col(f"`{start}`").cast("double"), F.col(f"`{end}`").cast("double")
    keys = [key_text(F.col(f"`{c}`")).alias(f"_k{i}") for i, c in enumerate(by)]
    rows = df.select(*keys, s.alias("_s"), e.alias("_e")).where("_e > _s AND NOT isnan(_s) AND NOT isnan(_e)")

    def summarise(batches: Iterator[pd.DataFrame]) -> Open | None:
        state = None
        for _, state in _scan(batches, n, None, False):  # noqa: B007
            pass
        return state

    def label(batches: Iterator[pd.DataFrame], now: Open | None, last: bool) -> Iterator[pd.DataFrame]:
        for out, now in _scan(batches, n, now, True):
            if out is not None:
                yield out
        if last:
            yield pd.DataFrame({**{f"_k{i}": [k] for i, k in enumerate(now.entity)}, "kind": ["period"], "_s": [now.start], "_e": [now.end]})

    order = [f"_k{i}" for i in range(n)]
    found = carried(rows, [*order, "_s"], summarise, _after, label, ", ".join(f"{k} string" for k in order) + ", kind string, _s double, _e double", partitions)
    back = [F.when(F.col(k) != "-", F.substring(k, 2, 1 << 30)).cast(df.schema[c].dataType).alias(c) for k, c in zip(order, by)]
    return found.select(*back, "kind", F.col("_s").alias("from_s"), F.col("_e").alias("to_s"))


def milliseconds(seconds: Column) -> Column:
    """Seconds times 1000, rounded, as a whole number."""
    return F.round(seconds * 1000).cast("bigint")
