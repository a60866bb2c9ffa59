"""Approximate nearest neighbours: inverted lists with product-quantised residuals.

Fitting takes at most `sample` vectors (those of smallest hash of the id; a bound of the index): coarse
centroids by k-means, then for each part of the vector a codebook of residuals. Every row is indexed:
its list (the nearest centroid) and the codes of its residual, kept in the shared checkpoint folder.

Searching takes queries in blocks of bounded size. A query probes its nearest lists; asymmetric distance
tables (query against codebooks) rank the probed rows where they lie, the best `refine` of each task
are measured exactly on the original vectors, and the nearest k of all tasks are kept. Rows aren't
dealt out by list, so a list that holds a third of all rows is searched by as many tasks as any other.

Cases: vectors null, zero, or with null or non-finite components take no part, nor do null ids. Vectors
of another dimension than the fitted one (the sample's most frequent) are compared exactly with queries
of their dimension. Ties go to the smaller id. An empty table gives an empty result. A query with fewer
than k candidates in its lists probes all lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import ID, QUERY_BLOCK, VECTOR, matrices, picked, query_blocks

SAMPLE, LISTS, PROBES, PARTS, CODES, REFINE = 16_384, 64, 48, 16, 64, 200


#: Distances held at once in a task.
CELLS = 2_000_000


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimension
    codebooks: np.ndarray  # parts x codes x width
    rows: DataFrame  # (id, vector, list, codes)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :])


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from distinct random points; empty clusters restart at the farthest points."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centers = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        away = squared(points, centers)
        near = away.argmin(axis=1)
        sizes = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        full = sizes > 0
        centers[full] = sums[full] / sizes[full, None]
        if not full.all():
            centers[~full] = points[np.argsort(-away.min(axis=1), kind="stable")[: (~full).sum()]]
    return centers


def split(matrix: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.array_split(matrix, parts, axis=1)


def encode(matrix: np.ndarray, centroids: np.ndarray, codebooks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    near = squared(matrix, centroids).argmin(axis=1)
    parts = split(matrix - centroids[near], len(codebooks))
    codes = np.stack([squared(p, b).argmin(axis=1) for p, b in zip(parts, codebooks, strict=True)], axis=1)
    return near.astype(np.int32), codes.astype(np.uint8)


def build(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, lists: int = LISTS,
    parts: int = PARTS, codes: int = CODES,
) -> Index | None:
    """None if there is nothing to index."""
    vectors = picked(df, id_col, vector_col, nonzero=True)
    table = vectors.orderBy(F.xxhash64(ID), ID).limit(sample).select(ID, VECTOR).toArrow()
    by_size = [m for b in table.combine_chunks().to_batches() for _, m in matrices(b)]
    if not by_size:
        return None
    points = max(by_size, key=len)
    parts = min(parts, points.shape[1])
    centroids = kmeans(points, lists)
    residual = points - centroids[squared(points, centroids).argmin(axis=1)]
    codebooks = [kmeans(p, codes) for p in split(residual, parts)]
    sent = df.sparkSession.sparkContext.broadcast((centroids, codebooks))

    def run(batches):
        centers, books = sent.value
        for batch in batches:
            for ids, matrix in matrices(batch):
                if matrix.shape[1] == centers.shape[1]:
                    near, code = encode(matrix, centers, books)
                    codes_column = [c.tobytes() for c in code]
                else:
                    near, codes_column = np.full(len(ids), -1, dtype=np.int32), [b""] * len(ids)
                rows = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(ids) + 1) * matrix.shape[1], type=pa.int32()), pa.array(matrix.reshape(-1))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), rows, pa.array(near), pa.array(codes_column, type=pa.binary())],
                    names=[ID, VECTOR, "list", "codes"],
                )

    rows = cut(vectors.mapInArrow(run, f"{ID} long, {VECTOR} array<double>, list int, codes binary"))
    return Index(centroids, codebooks, rows)


def search(index: Index, queries: DataFrame, k: int, probes: int = PROBES, refine: int = REFINE, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found; queries are (id, vector) rows as of picked()."""
    spark = queries.sparkSession
    found = None
    for ids, matrix in query_blocks(queries, block):
        part = index.rows.mapInArrow(_searcher(spark, index, ids, matrix, k, probes, refine), _FOUND)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


_FOUND = "query_id long, q long, vec_id long, score double"


def _searcher(spark, index: Index, ids: np.ndarray, matrix: np.ndarray, k: int, probes: int, refine: int):
    fits = matrix.shape[1] == index.centroids.shape[1]
    lists = len(index.centroids)
    probed = np.zeros((len(ids), lists), dtype=bool)
    if fits:
        sizes = {r[0]: r[1] for r in index.rows.groupBy("list").count().collect()}  # one row for each list
        order = squared(matrix, index.centroids).argsort(axis=1, kind="stable")
        np.put_along_axis(probed, order[:, : min(probes, lists)], True, axis=1)
        short = probed @ np.array([sizes.get(i, 0) for i in range(lists)]) <= k
        probed[short] = True
    sent = spark.sparkContext.broadcast((ids, matrix, probed, index.centroids, index.codebooks))

    def run(batches):
        ids, queries, probed, centers, books = sent.value
        kept = _Best(k)
        for batch in batches:
            near = batch.column(2).to_numpy(zero_copy_only=False)
            if fits:
                rows = np.flatnonzero(near >= 0)
                if len(rows):
                    indexed = batch.take(pa.array(rows))
                    own_ids, vectors = next(matrices(indexed))
                    code = np.frombuffer(b"".join(indexed.column(3).to_pylist()), dtype=np.uint8).reshape(len(rows), -1)
                    _search_lists(
                        ids, queries, probed, centers, books, own_ids, vectors, near[rows], code, refine, kept
                    )
            else:
                for own_ids, vectors in matrices(batch):
                    if vectors.shape[1] == queries.shape[1]:
                        for q in range(len(ids)):
                            kept.add(q, own_ids, exact(queries[q], vectors), ids[q])
        q, found, score = kept.columns()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[q]), pa.array(q), pa.array(found), pa.array(score)], names=["query_id", "q", "vec_id", "score"]
        )

    return run


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances, the squares added in order of the components."""
    return np.sqrt(np.cumsum((vectors - query) ** 2, axis=1)[:, -1]) if vectors.shape[1] else np.zeros(len(vectors))


def _search_lists(ids, queries, probed, centers, books, own_ids, vectors, near, code, refine, kept) -> None:
    """Adds the nearest of one batch to kept. A query's table of a list holds |q - c - r|^2 by part and code."""
    order = np.argsort(near, kind="stable")  # by list
    own_ids, vectors, code = own_ids[order], vectors[order], code[order]
    starts = np.searchsorted(near[order], np.arange(len(centers) + 1))
    step = max(1, CELLS // len(own_ids))
    for first in range(0, len(ids), step):
        block = slice(first, first + step)
        away = np.full((len(ids[block]), len(own_ids)), np.inf, dtype=np.float32)
        for c in range(len(centers)):
            members = slice(starts[c], starts[c + 1])
            asking = np.flatnonzero(probed[block, c])
            if members.start == members.stop or not len(asking):
                continue
            residual = split(queries[block][asking] - centers[c], len(books))
            away[asking, members] = sum(
                squared(r, book).astype(np.float32)[:, code[members, j]] for j, (r, book) in enumerate(zip(residual, books, strict=True))
            )
        away[ids[block][:, None] == own_ids[None, :]] = np.inf
        for i, row in enumerate(away):
            at = np.flatnonzero(row < np.inf)
            if len(at) > refine:
                cutoff = np.partition(row[at], refine - 1)[refine - 1]
                tied = at[row[at] == cutoff]
                at = at[row[at] < cutoff]
                at = np.concatenate([at, tied[np.argsort(own_ids[tied], kind="stable")][: refine - len(at)]])
            kept.add(first + i, own_ids[at], exact(queries[first + i], vectors[at]), ids[first + i])


class _Best:
    """The k nearest of each query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray, own: int) -> None:
        other = ids != own
        ids, scores = ids[other], scores[other]
        if q in self.held:
            ids, scores = np.concatenate([self.held[q][0], ids]), np.concatenate([self.held[q][1], scores])
        order = np.lexsort((ids, scores))[: self.k]
        self.held[q] = ids[order], scores[order]

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q = np.concatenate([np.full(len(v[0]), k, dtype=np.int64) for k, v in self.held.items()])
        return q, np.concatenate([v[0] for v in self.held.values()]), np.concatenate([v[1] for v in self.held.values()])
