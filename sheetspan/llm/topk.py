"""Exact top-k inner products by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import stage

PAIRS = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no component null, NaN or infinite."""
    return vector.isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)
    )


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _sparse(vectors: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Postings by term: (term, rows with a weight other than 0, weights)."""
    width = max((len(v) for v in vectors), default=0)
    dense = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        dense[i, : len(v)] = v
    return [(t, rows, dense[rows, t]) for t in range(width) if len(rows := np.flatnonzero(dense[:, t]))]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the earlier place, in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _search(batches: Iterator[pd.DataFrame], queries: list[tuple[int, np.ndarray]], k: int, block: int) -> Iterator[pd.DataFrame]:
    """Each task's k best candidates of every query.  A block of candidates is turned into
    postings; for each term the queries that have it scatter weight * posting into the dense
    scores of (queries, block), and a selection keeps k."""
    ids = np.array([q for q, _ in queries], np.int64)
    weights = {t: (rows, w) for t, rows, w in _sparse([v for _, v in queries])}
    held_s = [np.empty(0, np.int64)] * len(ids)
    held_v = [np.empty(0, np.int64)] * len(ids)

    def merge(vec_ids: np.ndarray, vectors: list[np.ndarray]) -> None:
        order = np.argsort(vec_ids, kind="stable")
        vec_ids = vec_ids[order]
        postings = _sparse([vectors[i] for i in order])
        for a in range(0, len(ids), 256):
            b = min(a + 256, len(ids))
            scores = np.zeros((b - a, len(vec_ids)), np.int64)
            for t, rows, values in postings:
                if t in weights:
                    own, w = weights[t]
                    x, y = np.searchsorted(own, (a, b))
                    if x == y:
                        continue
                    part = np.multiply.outer(w[x:y], values)
                    if len(rows) == len(vec_ids) and y - x == b - a:
                        scores += part
                    elif len(rows) == len(vec_ids):
                        scores[own[x:y] - a] += part
                    else:
                        scores[np.ix_(own[x:y] - a, rows)] += part
            for q in range(a, b):
                s, v = scores[q - a], vec_ids
                own_row = np.searchsorted(vec_ids, (ids[q], ids[q] + 1))
                if own_row[0] < own_row[1]:
                    s, v = np.delete(s, np.arange(*own_row)), np.delete(v, np.arange(*own_row))
                top = _best(s, k)
                s, v = np.concatenate([held_s[q], s[top]]), np.concatenate([held_v[q], v[top]])
                keep = np.lexsort((v, -s))[:k]
                held_s[q], held_v[q] = s[keep], v[keep]

    for batch in batches:
        for at in range(0, len(batch), block):
            part = batch.iloc[at : at + block]
            merge(part["vec_id"].to_numpy(np.int64), list(part["x"]))
    for at in range(0, len(ids), 2000):
        out = slice(at, at + 2000)
        yield pd.DataFrame(
            {
                "query_id": np.repeat(ids[out], [len(s) for s in held_s[out]]),
                "vec_id": np.concatenate([*held_v[out], np.empty(0, np.int64)]),
                "score": np.concatenate([*held_s[out], np.empty(0, np.int64)]),
            }
        )


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", queries_at_once: int = 20_000, block: int = 4096
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products of
    floor(scale * x), over every row of ``vectors`` but those with the query's own key.

    Ties go to the smaller vec_id.  Vectors that are null or hold a null or non-finite component,
    and rows with a null key, take no part; shorter vectors count as padded with zeros.  Rows that
    repeat a key are candidates each by itself; a repeated query key is searched once, with its
    largest vector.  Scores are 64-bit integers, so results are exact while they fit.

    Queries go out in blocks of ``queries_at_once``, the only thing that is broadcast, so its size
    has a bound; every block reads all candidates, and with several each is searched and written
    before the next goes out, so one is held at a time.  A task returns k rows a query at most, and one
    window picks the best of them.
    """
    good = lambda df: df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), scaled(F.col(vector), scale).alias("x"))
    candidates = good(vectors)
    asked = good(queries).groupBy("vec_id").agg(F.max("x").alias("x"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    count = asked.count()
    blocks = max(1, -(-count // queries_at_once))
    parts = []
    for i in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)
        own = [(r["vec_id"], np.array(r["x"], np.int64)) for r in mine.orderBy("vec_id").toLocalIterator()]
        sent = vectors.sparkSession.sparkContext.broadcast(own)
        part = candidates.mapInPandas(lambda batches, sent=sent: _search(batches, sent.value, k, block), PAIRS)
        parts.append(stage(best(part), "found") if blocks > 1 else best(part))
        if blocks > 1:
            sent.destroy()
    return reduce(DataFrame.unionByName, parts)
