"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in its source's shuffled order and a virtual finish time,
the tokens of its source up to and with it over the source's weight. All documents of
a mix are sorted by that time, so sources advance in step with their weights, and the
order is cut where its tokens reach the total. Both running sums are ordered scans, so
neither a source nor a mix is gathered in one task.
"""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm import tokens
from loomline.operators.scan import summed
from loomline.session import stored


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, no outer blanks, '_' between words; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"(?U)^[\s_-]+|[\s_-]+$", ""), r"(?U)[\s_-]+", "_")


def enough(total: float, sources: list[tuple[float, float, float]]) -> float:
    """A virtual time by which ``total`` is reached for sure; infinite if it never is.

    ``sources``: (weight, most tokens, largest document). By time t a source has given at least
    min(weight * t, most) less one document.
    """
    sources = [s for s in sources if s[0] > 0 and s[1] > 0]
    wanted = total + sum(s[2] for s in sources)
    given, now, rate = 0.0, 0.0, sum(s[0] for s in sources)
    for weight, most, _ in sorted(sources, key=lambda s: s[1] / s[0]):
        end = most / weight
        if given + rate * (end - now) >= wanted:
            return now + (wanted - given) / rate
        given, now, rate = given + rate * (end - now), end, rate - weight
    return float("inf")


class Mix:
    """Selections of documents in which sources advance in step with their weights, up to a total.

    ``targets`` has mix, source_name, weight, max_repeats and total_tokens; rows of one mix
    and source, however spelled, are one with their weights added. A document is taken in each of at most max_repeats
    rounds through its source. The order by finish time is cut before the document that would
    exceed total_tokens, so each source has its weight's share within a document, or all that
    max_repeats allows; what a short or absent source leaves goes to the others in step
    with their weights, and the report shows both. Weights that are null or not positive select nothing. Null sources are
    of no mix, null and empty texts have no tokens and are not selected. ``id`` is unique.
    Sizes are tokens, or the whole numbers of the column ``size``.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, id: str, text: str, source: str, seed: int = 7, vocabulary: str | None = None, size: str | None = None):
        self.id = id
        n = F.col(f"`{size}`").cast("bigint") if size else tokens.count(F.col(f"`{text}`"), vocabulary).cast("bigint")
        docs = df.select(F.col(f"`{id}`").alias("id"), source_name(F.col(f"`{source}`")).alias("source"), n.alias("n_tokens"))
        self.docs = stored(docs.where("n_tokens > 0 AND source IS NOT NULL").withColumn("u", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))))
        weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
        named = targets.select("mix", source_name(F.col("source_name")).alias("source"), weight.alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"), F.col("total_tokens").cast("bigint").alias("total_tokens"))
        one = named.groupBy("mix", "source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("total_tokens").alias("total_tokens"))
        supply = self.docs.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.max("n_tokens").alias("largest"))
        # one row a mix and source
        self.rows = one.withColumn("total_tokens", F.max("total_tokens").over(Window.partitionBy("mix"))).join(supply, "source", "left").collect()
        self.targets = df.sparkSession.createDataFrame(self._timed(), "mix string, source string, weight double, max_repeats int, total_tokens long, supply long, until double")
        self._selection: DataFrame | None = None

    def _timed(self) -> list[tuple]:
        """Rows of the targets with the time behind which their mix needs no document."""
        until = {}
        for mix in {r["mix"] for r in self.rows}:
            own = [r for r in self.rows if r["mix"] == mix]
            until[mix] = enough(own[0]["total_tokens"] or 0, [(r["weight"], r["max_repeats"] * (r["supply"] or 0), r["largest"] or 0) for r in own]) * (1 + 1e-9)
        return [(r["mix"], r["source"], r["weight"], r["max_repeats"], r["total_tokens"], r["supply"] or 0, until[r["mix"]] if isfinite(until[r["mix"]]) else None) for r in self.rows]

    def selection(self) -> DataFrame:
        """mix, source, id, copy (from 1), n_tokens, finish, total (tokens of the mix up to and with it); in the order of mix and finish time."""
        if self._selection is None:
            placed = summed(self.docs, "source", ["u", "id"], F.col("n_tokens"), "upto")
            rounds = placed.join(self.targets.where("weight > 0"), "source")
            # only rounds in which the document comes before the mix is full; null: all of them
            last = F.least(F.col("max_repeats").cast("double"), (F.col("until") * F.col("weight") - F.col("upto")) / F.col("supply") + 1)
            rounds = rounds.where(F.col("until").isNull() | (F.col("upto") <= F.col("until") * F.col("weight"))).withColumn("copy", F.explode(F.sequence(F.lit(1), last.cast("int"))))
            timed = rounds.withColumn("finish", ((F.col("copy") - 1) * F.col("supply") + F.col("upto")) / F.col("weight"))
            timed = timed.select("mix", "source", "id", "copy", "n_tokens", "finish", "u", "total_tokens")
            filled = summed(timed, "mix", ["finish", "source", "copy", "u", "id"], F.col("n_tokens"), "total").where(F.col("total") <= F.col("total_tokens"))
            self._selection = filled.select("mix", "source", F.col("id").alias(self.id), "copy", "n_tokens", "finish", "total")
        return self._selection

    def shares(self) -> DataFrame:
        """Of each mix and source: target and reached tokens and shares, supply, documents, most copies of one."""
        got = self.selection().groupBy("mix", "source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct(self.id).alias("n_docs"), F.max("copy").alias("most_copies"))
        t = self.targets.withColumns({"_mix": F.col("mix"), "_source": F.col("source")}).drop("mix", "source")
        every = t.join(got, t["_mix"].eqNullSafe(got["mix"]) & (t["_source"] == got["source"]), "left").drop("mix", "source").withColumnsRenamed({"_mix": "mix", "_source": "source"})
        w = Window.partitionBy("mix")
        own, part = F.coalesce("tokens", F.lit(0)), F.col("weight") / F.nullif(F.sum("weight").over(w), F.lit(0.0))
        return every.select("mix", "source", F.round(part, 6).alias("target_share"), F.round(part * F.col("total_tokens"), 3).alias("target_tokens"), F.col("supply").alias("supply_tokens"), "max_repeats", own.alias("tokens"), F.round(own / F.nullif(F.col("total_tokens"), F.lit(0)), 6).alias("share_of_total"), F.round(own / F.nullif(F.sum(own).over(w), F.lit(0)), 6).alias("share_reached"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
