"""Filling fixed-capacity containers: vector bin packing by dot products.

Items have three sizes (tokens, segments, loss-bearing tokens), containers a limit on
each. A container takes, as long as anything fits, the item whose sizes have the
largest dot product with the room that is left. Items are packed in random blocks of
bounded size, in parallel; containers that a block leaves too empty are dissolved and
their items packed again together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import tokens
from loomline.session import stored
from loomline.sources.tables import spread_by


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item. ``sizes`` is items by dimensions; an item above a limit takes all of it."""
    n = len(sizes)
    share = np.minimum(sizes / limits, 1.0)
    weights = share.sum(0)
    weights = weights / weights.sum() if weights.sum() else np.ones(len(limits)) / len(limits)
    order = np.lexsort((np.arange(n), -(share @ weights)))
    share = share[order]
    where = np.empty(n, np.int64)
    left, number = np.arange(n), 0
    while len(left):
        room = np.ones(len(limits)) - share[left[0]]
        taken = [left[0]]
        rest = left[1:]
        while len(rest):
            own = share[rest]
            rest = rest[(own <= room + 1e-9).all(1)]
            if not len(rest):
                break
            at = int(np.argmax(share[rest] @ (weights * room)))
            taken.append(rest[at])
            room = room - share[rest[at]]
            rest = np.delete(rest, at)
        where[taken] = number
        number += 1
        left = left[~np.isin(left, taken, assume_unique=True)]
    out = np.empty(n, np.int64)
    out[order] = where
    return out


def limits_of(capacity: int, tokens_per_segment: int, loss_share: float) -> np.ndarray:
    """Limits of a container on tokens, segments and loss-bearing tokens."""
    return np.array([capacity, max(4, capacity // tokens_per_segment), max(1.0, loss_share * capacity)], float)


#: fill: the largest share that a container has of one of its limits.
_COLUMNS = "capacity int, id string, piece int, n_pieces int, token_from int, token_to int, loss_tokens int, container string, fill double"


def _packed(items: DataFrame, per_block: int, segments: int, loss_share: float, mark: str) -> DataFrame:
    """Pack in blocks of about ``per_block`` items of one capacity."""
    counts = {r["capacity"]: r["count"] for r in items.groupBy("capacity").count().collect()}  # one row a capacity
    blocks = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, math.ceil(n / per_block))]) if counts else F.lit(None).cast("map<int,int>")
    block = F.pmod(F.xxhash64("id", "piece", F.lit(mark)), blocks[F.col("capacity")])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["capacity"].iat[0])
        pdf = pdf.sort_values(["id", "piece"]).reset_index(drop=True)
        size = (pdf["token_to"] - pdf["token_from"]).to_numpy(float)
        sizes = np.stack([size, np.ones(len(pdf)), pdf["loss_tokens"].to_numpy(float)], 1)
        limits = limits_of(c, segments, loss_share)
        number = pack(sizes, limits)
        fill = np.stack([np.bincount(number, x) for x in (sizes / limits).T]).max(0)
        return pdf.assign(container=[f"{mark}{c}-{b}-{k}" for b, k in zip(pdf["block"], number)], fill=fill[number]).drop(columns="block")

    # blocks are few bytes and much work, so they are spread by their number
    return spread_by(items.withColumn("block", block), "capacity", "block").groupBy("capacity", "block").applyInPandas(one, _COLUMNS)


def fill_containers(df: DataFrame, id: str, text: str, capacities: Iterable[int], tokens_per_segment: int = 128, loss_share: float = 0.85, block_items: int = 2000, full: float = 0.97, vocabulary: str | None = None) -> DataFrame:
    """Assign every text to containers of each capacity, in tokens.

    Only a text above the capacity is divided; its pieces are full but for the last. A
    container holds at most ``capacity`` tokens, ``capacity // tokens_per_segment`` items (4 at
    least) and ``loss_share * capacity`` loss-bearing tokens; an item that alone has more
    of these, as a text full of letters may, isn't divided for it but shares its container
    with items without such tokens only. Null and empty texts are items of 0 tokens.
    ``id`` is taken to be unique. Result: capacity, container, ``id``, piece, n_pieces,
    token_from, token_to, loss_tokens. Extra columns are ignored, no row gives no row.
    """
    capacities = sorted({int(c) for c in capacities})
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities must be 1 at least")
    kind = df.schema[id].dataType
    cut = df.select(F.col(f"`{id}`").cast("string").alias("id"), F.explode(tokens.pieces(F.col(f"`{text}`"), capacities, vocabulary)).alias("p"))
    items = stored(cut.select("id", "p.*"))
    first = stored(_packed(items, block_items, tokens_per_segment, loss_share, "a"))
    # what remains is a container or two a block, so packing it again is a small part of the work
    again = _packed(first.where(F.col("fill") < full).drop("container", "fill"), block_items * 2, tokens_per_segment, loss_share, "b")
    both = first.where(F.col("fill") >= full).unionByName(again)
    return both.select("capacity", "container", F.col("id").cast(kind).alias(id), "piece", "n_pieces", "token_from", "token_to", "loss_tokens")


def fill_report(packed: DataFrame, tokens_per_segment: int = 128, loss_share: float = 0.85) -> DataFrame:
    """Of each capacity: containers, the least number that could hold the tokens, the mean fill in tokens, the fullest container, and limits reached.

    by_tokens, by_segments, by_loss count the containers of which that limit is the one used most (the first of equal ones);
    the limits are those that ``fill_containers`` was given.
    """
    per = packed.groupBy("capacity", "container").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n"), F.count(F.lit(1)).alias("items"), F.sum("loss_tokens").alias("loss"))
    c = F.col("capacity")
    used = [F.col("n") / c, F.col("items") / F.greatest(F.lit(4), F.floor(c / tokens_per_segment)), F.col("loss") / F.greatest(F.lit(1.0), c * loss_share)]
    most = F.greatest(*used)
    by = [F.count_if(used[0] == most).alias("by_tokens"), F.count_if((used[0] < most) & (used[1] == most)).alias("by_segments"), F.count_if((used[0] < most) & (used[1] < most)).alias("by_loss")]
    return per.groupBy("capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.ceil(F.sum("n") / F.first("capacity")).alias("least_containers"), F.round(F.avg(F.col("n") / F.col("capacity")), 6).alias("mean_fill"), F.max("n").alias("most_tokens"), F.max("items").alias("most_items"), *by)
