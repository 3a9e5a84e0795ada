"""Similarity of vectors: nearest entries of a bank, upserts by score, clustering.

Cosines are computed in double precision; one with a zero vector is 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.scan import numbered


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is zero."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _blocks(df: DataFrame, id: str, vector: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Rows in blocks: one row for ``size`` vectors, flat, so that two blocks meet as two matrices."""
    kind = df.schema[id].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                yield pd.DataFrame({names[0]: [part["id"].to_numpy()], names[1]: [np.concatenate([np.asarray(v, np.float64) for v in part["v"]])]})

    rows = df.where(F.col(f"`{vector}`").isNotNull() & (F.size(f"`{vector}`") > 0)).select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    return rows.mapInPandas(run, T.StructType([T.StructField(names[0], T.ArrayType(kind)), T.StructField(names[1], T.ArrayType(T.DoubleType()))]))


def nearest_entries(queries: DataFrame, bank: DataFrame, id: str, vector: str, k: int = 1, at_least: float = -1.0, same: bool = False, block: int = 1024) -> DataFrame:
    """The ``k`` entries of the bank most similar to each query: query_id, entry_id, similarity, place.

    Exact: blocks of queries meet blocks of the bank as matrices, each pair keeps its best, and these are
    merged. Equal similarities go by the lower entry. An entry isn't its own neighbour unless ``same``.
    Vectors are of one length; null and empty ones are in no pair.
    """
    q = _blocks(queries, id, vector, block, ("q_ids", "q"))
    b = _blocks(bank, id, vector, block, ("b_ids", "b"))
    kind = queries.schema[id].dataType

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qi, bi = np.asarray(r.q_ids), np.asarray(r.b_ids)
                sims = _unit(np.asarray(r.q).reshape(len(qi), -1)) @ _unit(np.asarray(r.b).reshape(len(bi), -1)).T
                if not same:
                    sims[qi[:, None] == bi[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(bi, sims.shape), -np.round(sims, 12)), axis=1)[:, :k]
                best = np.take_along_axis(sims, order, 1)
                keep = (best >= at_least) & np.isfinite(best)
                rows, cols = np.nonzero(keep)
                if len(rows):
                    yield pd.DataFrame({"query_id": qi[rows], "entry_id": bi[order[rows, cols]], "similarity": best[rows, cols]})

    schema = T.StructType([T.StructField("query_id", kind), T.StructField("entry_id", kind), T.StructField("similarity", T.DoubleType())])
    found = q.crossJoin(b).mapInPandas(meet, schema)  # blocks, not rows
    # the window keeps k a query on either side of its shuffle
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "entry_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def merged_bank(bank: DataFrame, candidates: DataFrame, matches: DataFrame, threshold: float) -> DataFrame:
    """Bank after each candidate that is similar enough has met its entry.

    ``bank`` and ``candidates``: voice_id, text, score; ``matches``: query_id, entry_id, similarity. Of an
    entry's candidates the one with the best score (then the lowest id) replaces text and score, if its
    score is strictly greater. Adds replaced_by, null for entries that stay.
    """
    close = matches.where(F.col("similarity") >= threshold).join(candidates.select(F.col("voice_id").alias("query_id"), F.col("text").alias("new_text"), F.col("score").alias("new_score")), "query_id")
    best = close.groupBy(F.col("entry_id").alias("voice_id")).agg(F.max_by(F.struct("query_id", "new_text", "new_score"), F.struct("new_score", -F.col("query_id"))).alias("n"))
    joined = bank.join(best, "voice_id", "left")
    better = F.coalesce(F.col("n.new_score") > F.col("score"), F.lit(False))
    return joined.select("voice_id", F.when(better, F.col("n.new_text")).otherwise(F.col("text")).alias("text"), F.when(better, F.col("n.new_score")).otherwise(F.col("score")).alias("score"), F.when(better, F.col("n.query_id")).alias("replaced_by"))


def claimed(candidates: DataFrame, matches: DataFrame, run: str, order: str) -> DataFrame:
    """Entry of each candidate where a run claims an entry once: in order, the most similar one still free.

    ``matches``: query_id, entry_id, place, of each candidate as many as a run has members at least, so that
    those taken by others are never missed. A candidate without a free entry gets null. Columns: run, id, entry_id.
    A run is small (the voices of one item); runs are claimed in parallel.
    """
    lists = matches.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry_id"))), lambda x: x["entry_id"]).alias("_entries"))
    rows = candidates.select(F.col(run).alias("run"), F.col(order).alias("id")).join(lists, F.col("id") == F.col("query_id"), "left").drop("query_id")
    members = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("id", "_entries"))).alias("m"))
    kind = candidates.schema[order].dataType

    @F.pandas_udf(T.ArrayType(kind))
    def claim(ms: pd.Series) -> pd.Series:
        out = []
        for m in ms:
            taken: set = set()
            got = []
            for c in m:
                entries = c["_entries"] if c["_entries"] is not None else []
                free = next((e for e in entries if e not in taken), None)
                if free is not None:
                    taken.add(free)
                got.append(free)
            out.append(got)
        return pd.Series(out)

    both = members.withColumn("e", claim("m")).select("run", F.explode(F.arrays_zip(F.col("m.id").alias("id"), F.col("e").alias("entry_id"))).alias("p"))
    return both.select("run", F.col("p.id").alias("id"), F.col("p.entry_id").alias("entry_id"))


def allotted(new: DataFrame, order: Sequence[str], bank_ids: Column, bank: DataFrame, prefix: str = "speaker_") -> DataFrame:
    """Ids for new entries: numbers after the largest in the bank, three digits at least, in order."""
    last = bank.select(F.max(F.regexp_extract(bank_ids, rf"^{prefix}(\d+)$", 1).try_cast("bigint"))).first()[0] or 0
    return numbered(new, order, "_n", first=last + 1).withColumn("voice_id", F.concat(F.lit(prefix), F.format_string("%03d", "_n"))).drop("_n")


def linkage(vectors: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (height, a, b) of average linkage by cosine distance, lowest first; a and b are members of the clusters.

    Chains of nearest neighbours: every merge is one of mutual nearest clusters, which for average
    linkage gives the same tree as taking the closest pair of all each time.
    """
    # the mean cosine of two clusters is the product of the sums of their unit vectors over their sizes: no matrix of distances
    total = _unit(np.asarray(vectors, float)).copy()
    n = len(total)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []

    def apart(i: int) -> np.ndarray:
        far = 1.0 - (total @ total[i]) / (size * size[i])
        far[~alive] = np.inf
        far[i] = np.inf
        return far

    start = 0
    for _ in range(n - 1):
        if not chain:
            while not alive[start]:
                start += 1
            chain = [start]
        while True:
            far = apart(chain[-1])
            near = int(np.argmin(far))
            # of equal distances back to where the chain comes from, so that it ends
            if len(chain) > 1 and far[chain[-2]] <= far[near] + 1e-12:
                break
            chain.append(near)
        height = float(far[chain[-2]])
        a, b = chain.pop(), chain.pop()
        merges.append((height, a, b))
        total[a] += total[b]
        size[a] += size[b]
        alive[b] = False
    return sorted(merges, key=lambda m: m[0])


def clusters(vectors: np.ndarray, k: int | None = None, distance: float = 0.40, most: int = 12) -> np.ndarray:
    """Cluster of each vector, numbered by first member.

    With ``k`` that many (1 to n); else clusters nearer than ``distance`` are merged, and if more than ``most``
    remain, ``most`` are made. Nothing and one vector are themselves.
    """
    n = len(vectors)
    if n == 0:
        return np.empty(0, int)
    merges = linkage(vectors)
    take = n - max(1, min(k, n)) if k is not None else sum(m[0] < distance for m in merges)
    if k is None and n - take > most:
        take = n - most
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, a, b in merges[:take]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    first: dict[int, int] = {}
    return np.array([first.setdefault(find(i), len(first)) for i in range(n)])


def clustered(df: DataFrame, by: str, id: str, vector: str, k: int | None = None, distance: float = 0.40, most: int = 12) -> DataFrame:
    """Cluster of each vector within its group: ``by``, ``id``, cluster.

    A group is the windows of one media item; its vectors have one length, null and empty ones are left out. A group is
    clustered in one task: its vectors are held once, no distances are, and the time grows with the square of their number.
    """
    schema = T.StructType([df.schema[by], df.schema[id], T.StructField("cluster", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id)
        return pdf[[by, id]].assign(cluster=clusters(np.stack(pdf[vector].to_numpy()), k, distance, most).astype(np.int32))

    return df.select(by, id, vector).where(F.col(vector).isNotNull() & (F.size(vector) > 0)).groupBy(by).applyInPandas(run, schema)
