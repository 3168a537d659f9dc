"""Exact top-k inner products by term-at-a-time accumulation.

A vector's components are its terms. Candidates stay where they are: a task packs its
own into blocks, and turns each block into posting lists: for every component, the
rows that have it and their weights. Query rows, held sparsely, come to all tasks, a
bounded number at a time. Each scatters its weighted posting lists into a dense array
of scores, one for each candidate of the block. A partition selection keeps the k best
of a task's candidates, and a merge keeps the k best of all tasks. Every query meets
every candidate, so the result is exact, and only k rows a query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

# Components of the queries that are broadcast at a time.
QUERY_NUMBERS = 4_000_000
RESULT = "query_id long, rank int, vec_id long, score long"
SCORED = "q_row long, query_id long, id long, score long"


class Queries:
    """Query rows, sparse: the terms and weights of all of them end to end."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: list[np.ndarray]):
        self.rows, self.ids = rows, ids
        terms = [np.flatnonzero(v) for v in vectors]
        self.ends = np.concatenate([[0], np.cumsum([len(t) for t in terms], dtype=np.int64)])
        self.terms = np.concatenate([np.zeros(0, np.int64), *terms])
        self.weights = np.concatenate([np.zeros(0, np.int64), *[v[t] for v, t in zip(vectors, terms)]])


class Postings:
    """A block of candidates as posting lists: for each term its rows and their weights."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: list[np.ndarray]):
        self.rows, self.ids = rows, ids
        terms = [np.flatnonzero(v) for v in vectors]
        owner = np.repeat(np.arange(len(vectors)), [len(t) for t in terms])
        weights = np.concatenate([np.zeros(0, np.int64), *[v[t] for v, t in zip(vectors, terms)]])
        terms = np.concatenate([np.zeros(0, np.int64), *terms])
        order = np.argsort(terms, kind="stable")
        self.owner, self.weights = owner[order], weights[order]
        last = int(terms.max(initial=-1)) + 1
        self.starts = np.searchsorted(terms[order], np.arange(last + 1))

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The inner products of every candidate with one query."""
        scores = np.zeros(len(self.ids), np.int64)
        for term, weight in zip(terms, weights):
            if term + 1 < len(self.starts):
                a, b = self.starts[term], self.starts[term + 1]
                # a row has a term once, so no place is hit twice
                scores[self.owner[a:b]] += weight * self.weights[a:b]
        return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores, equal ones by smaller id."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    level = level[np.argsort(ids[level], kind="stable")[: k - len(above)]]
    return np.concatenate([above, level])


def _blocks(batches: Iterator[pd.DataFrame], block_rows: int) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for batch in batches:
        for at in range(0, len(batch), block_rows):
            part = batch.iloc[at : at + block_rows]
            if size + len(part) > block_rows:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
            held.append(part)
            size += len(part)
    if size:
        yield pd.concat(held, ignore_index=True)


def _vectors(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    vectors = [np.asarray(v, dtype=np.int64) for v in rows["vector"]]
    return rows["row"].to_numpy(np.int64), rows["id"].to_numpy(np.int64), vectors


def _score(shared, k: int, block_rows: int):
    """A task's candidates to the k best of them for each query."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries: Queries = shared.value
        held_ids = [np.zeros(0, np.int64) for _ in queries.ids]
        held_scores = [np.zeros(0, np.int64) for _ in queries.ids]
        for rows in _blocks(batches, block_rows):
            block = Postings(*_vectors(rows))
            for q, q_row in enumerate(queries.rows):
                a, b = queries.ends[q], queries.ends[q + 1]
                scores = block.scores(queries.terms[a:b], queries.weights[a:b])
                others = np.flatnonzero(block.rows != q_row)
                ids = np.concatenate([held_ids[q], block.ids[others]])
                scores = np.concatenate([held_scores[q], scores[others]])
                kept = best(scores, ids, k)
                held_ids[q], held_scores[q] = ids[kept], scores[kept]
        counts = [len(x) for x in held_ids]
        if sum(counts):
            yield pd.DataFrame(
                {
                    "q_row": np.repeat(queries.rows, counts),
                    "query_id": np.repeat(queries.ids, counts),
                    "id": np.concatenate(held_ids),
                    "score": np.concatenate(held_scores),
                }
            )

    return score


def top_k(
    vectors: DataFrame,
    queries: Column,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    block_rows: int = 4096,
    query_rows: int = 65_536,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest inner products of each query row.

    ``queries`` says which rows of ``vectors`` are queries. Components become
    ``floor(scale * x)``, and scores are exact while they fit in a long. Every other
    row is a candidate; equal scores go to the smaller vec_id. Vectors that are null
    or hold a null or non-finite component take no part, nor do null ids. An empty
    vector scores zero with all, and vectors of different lengths are compared where
    both have components. Rows that repeat an id are candidates of their own, and
    each gets its own result as a query. No vectors or no queries give no rows.

    Bounds: about ``query_rows`` queries are broadcast at a time, fewer if their
    components would number more than :data:`QUERY_NUMBERS`, and the candidates are read
    once for each such part. A task holds that part, one block of candidates, and k rows
    a query; the merge reads k rows a query and task.
    """
    x = F.col(f"`{embedding}`")
    whole = ~F.exists(
        x,
        lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")),
    )
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"),
        queries.alias("asks"),
        F.when(
            whole, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
        ).alias("vector"),
    ).filter("id is not null and vector is not null")
    spark = rows.sparkSession
    # Row numbers are read more than once below, so they are written once.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    candidates = rows.select("row", "id", "vector")
    found = None
    for asked, last in _query_parts(rows.filter("asks").select("row", "id", "vector"), query_rows):
        shared = spark.sparkContext.broadcast(Queries(*_vectors(asked)))
        scored = candidates.mapInPandas(_score(shared, k, block_rows), SCORED)
        order = W.partitionBy("q_row").orderBy(F.desc("score"), F.asc("id"))
        ranked = (
            scored.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
        )
        if not last:
            ranked = stored(ranked, "ranked")
            shared.unpersist()
        found = ranked if found is None else found.unionByName(ranked)
    return spark.createDataFrame([], RESULT) if found is None else found


def _query_parts(asked: DataFrame, query_rows: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """The query rows in parts dealt by their row number, and whether a part is the last."""
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    at_once = max(1, min(query_rows, QUERY_NUMBERS // max(1, size["width"] or 1)))
    parts = -(-size["n"] // at_once)
    if parts > 1:
        asked = stored(
            asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))), "queries"
        )
    for part in range(parts):
        own = asked.filter(F.col("part") == part).drop("part") if parts > 1 else asked
        yield own.toPandas(), part == parts - 1
