"""Exact top-k search by distributed histogram selection.

Vectors become whole numbers (floor of scale * x), so scores are integer inner products. Queries come in
blocks of bounded size; each block is broadcast, and every candidate is scored where it lies:

1. A query's scores lie within its norm times the largest candidate norm (Cauchy-Schwarz). That range is
   cut into bins; tasks count scores by bin, the counts are added up, and the bin of the k-th value
   becomes the next range, until it is one value wide.
2. Candidates above the k-th value, and of those at it as many of smallest id as are missing, are kept.

A task reports only bins that can hold the global k-th value: those from its own k-th value upwards, at
most k bins for each query. No candidate rows are shuffled before the last step, so hot vectors do no harm.

Cases: vectors null or with null or non-finite components take no part, nor do null ids. Vectors are
compared with those of the same dimension only. Ties go to the smaller id; rows that repeat an id each
count, but none is a candidate of its own id's query. An empty table gives an empty result. Sums must
stay below 2**53, where doubles are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import ID, QUERY_BLOCK, VECTOR, matrices, picked, query_blocks

BINS = 128
#: Scores held at once in a task.
CELLS = 2_000_000


def _scored(batches, sent, scale: float, work: Callable) -> None:
    """Calls work(ids, scores[queries, candidates], own) over blocks of candidates; own marks a query's own id."""
    queries = sent.value["vectors"]
    for batch in batches:
        for ids, matrix in matrices(batch):
            if matrix.shape[1] != queries.shape[1]:
                continue
            step = max(1, CELLS // max(1, len(queries)))
            for at in range(0, len(ids), step):
                part = ids[at : at + step]
                scores = queries @ np.floor(scale * matrix[at : at + step]).T
                work(part, scores.astype(np.int64), sent.value["ids"][:, None] == part[None, :])


def _histograms(candidates: DataFrame, sent, scale: float, k: int) -> DataFrame:
    """(query index, bin, count) of scores at or above each query's lower end, by task."""

    def run(batches):
        low, width = sent.value["low"], sent.value["width"]
        n, bins = len(low), BINS + 1  # the last bin holds what lies above the range
        counts = np.zeros(n * bins, dtype=np.int64)
        rows = (np.arange(n) * bins)[:, None]

        def add(ids, scores, own):
            at = np.minimum((scores - low[:, None]) // width[:, None], BINS)
            fine = (at >= 0) & ~own
            counts[:] += np.bincount((rows + at)[fine], minlength=n * bins)

        _scored(batches, sent, scale, add)
        table = counts.reshape(n, bins)
        above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table  # in higher bins
        query, bin_ = np.nonzero((table > 0) & (above < k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(bin_), pa.array(table[query, bin_])], names=["q", "bin", "n"]
        )

    return candidates.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth_values(candidates: DataFrame, ids, vectors, largest: float, scale: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k-th highest score (the lowest possible where it has fewer candidates) and the number above it."""
    spark = candidates.sparkSession
    reach = np.ceil(np.sqrt((vectors**2).sum(axis=1)) * largest).astype(np.int64) + 1
    low, high = -reach, reach + 1  # the value lies in [low, high)
    width = np.maximum(1, -(-(high - low) // BINS))
    beyond = np.zeros(len(ids), dtype=np.int64)
    while True:
        sent = spark.sparkContext.broadcast({"ids": ids, "vectors": vectors, "low": low, "width": width})
        found = _histograms(candidates, sent, scale, k).toArrow()  # at most k + 1 rows for each query and task
        counts = np.zeros((len(ids), BINS + 1), dtype=np.int64)
        counts[found["q"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
        sent.unpersist()
        from_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        at = np.where(from_top[:, 0] >= k, BINS - np.argmax((from_top >= k)[:, ::-1], axis=1), 0)
        beyond = from_top[np.arange(len(ids)), at] - counts[np.arange(len(ids)), at]
        low = low + at * width
        if (width == 1).all():
            return low, beyond
        width = np.maximum(1, -(-width // BINS))


def top_k(
    df: DataFrame, query_filter: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 64.0, block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score) of each query's k highest scores; query_filter is over df."""
    vectors = picked(df, id_col, vector_col)
    queries = picked(df.filter(query_filter), id_col, vector_col)
    norm = F.sqrt(F.aggregate(VECTOR, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale).cast("double"), 2)))
    largest = vectors.agg(F.max(norm)).first()[0] or 0.0
    found = None
    for ids, matrix in query_blocks(queries, block):
        own = np.floor(scale * matrix)
        kth, above = _kth_values(vectors, ids, own, largest, scale, k)
        sent = df.sparkSession.sparkContext.broadcast({"ids": ids, "vectors": own, "kth": kth, "missing": k - above})
        part = vectors.mapInArrow(_keeper(sent, scale), "query_id long, vec_id long, score long, q long")
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.select(
            F.col(ID).alias("query_id"), F.lit(1).alias("rank"), F.col(ID).alias(id_col), F.col(ID).alias("score")
        ).limit(0)
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _keeper(sent, scale: float):
    """Candidates above the k-th value, and those at it of smallest id, as many as are missing, in each task."""

    def run(batches):
        kth, missing = sent.value["kth"], sent.value["missing"]
        kept: list[tuple[np.ndarray, ...]] = []

        def add(ids, scores, own):
            q, c = np.nonzero((scores >= kth[:, None]) & ~own)
            kept.append((q, ids[c], scores[q, c]))
            if sum(len(x[0]) for x in kept) > CELLS:
                kept[:] = [trim()]

        def trim():
            q, ids, scores = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.lexsort((ids, -scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            tied = scores == kth[q]
            nth = np.cumsum(tied) - 1
            first = np.searchsorted(q, q)  # place of the query's first row
            nth -= np.concatenate([[0], np.cumsum(tied)])[first]
            fine = ~tied | (nth < missing[q])
            return q[fine], ids[fine], scores[fine]

        _scored(batches, sent, scale, add)
        if kept:
            q, ids, scores = trim()
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent.value["ids"][q]), pa.array(ids), pa.array(scores), pa.array(q)],
                names=["query_id", "vec_id", "score", "q"],
            )

    return run


def oracle(k: int = 20, every: int = 20) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
