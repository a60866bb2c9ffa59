import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, rank int, score double, q long"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in rows], SCHEMA).repartition(partitions)


def odd_rows(seed=1, n=300, d=8):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(1000, None), (1001, [1.0, None] * 4), (1002, [float("nan")] * d), (1003, [float("inf")] * d), (1004, [0.0] * d), (1020, [0.5] * 5), (1021, [0.25] * 5)]
    return [*rows, (None, [0.5] * d)]


def usable(rows, nonzero=False):
    fine = [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and v and None not in v]
    return [(i, v) for i, v in fine if np.isfinite(v).all() and (v.any() or not nonzero)]


def brute(rows, every, k, score, nonzero=False):
    out, fine = set(), usable(rows, nonzero)
    for q, x in fine:
        if q % every == 0:
            found = sorted((score(x, y), i) for i, y in fine if i != q and len(x) == len(y))[:k]
            out |= {(q, r, i, s) for r, (s, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("k", "block"), [(20, 8192), (7, 3), (500, 8192)])
def test_topk(spark, k, block):
    rows = odd_rows()
    expected = brute(rows, 20, k, lambda x, y: -int(np.floor(64 * x) @ np.floor(64 * y)))
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, k, block=block)
    assert {(r.query_id, r.rank, r.vec_id, -r.score) for r in found.collect()} == expected


def test_topk_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)]
    found = topk.top_k(frame(spark, rows, 7), F.col("vec_id") == 40, 5)
    assert [(r.rank, r.vec_id) for r in found.orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_empty(spark):
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 20 == 0, 5).count() == 0
    assert ann.build(frame(spark, [(1, None)])) is None
    index = ann.build(frame(spark, [(1, [1.0, 2.0])]))
    none = vectors.picked(frame(spark, []), "vec_id", "embedding")
    assert ann.search(index, none, 3).count() == 0


def ann_rows(spark, rows, every, k, **settings):
    df = frame(spark, rows)
    queries = vectors.picked(df.filter(F.col("vec_id") % every == 0), "vec_id", "embedding", nonzero=True)
    return ann.search(ann.build(df), queries, k, **settings).collect()


def test_ann_is_exact_when_all_is_probed(spark):
    rows = odd_rows()
    expected = brute(rows, 20, 10, lambda x, y: np.sqrt(((x - y) ** 2).sum()), nonzero=True)
    found = {(r.query_id, r.rank, r.vec_id): r.score for r in ann_rows(spark, rows, 20, 10, probes=64, refine=10_000)}
    assert set(found) == {x[:3] for x in expected}
    assert all(abs(found[x[:3]] - x[3]) < 1e-12 for x in expected)


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_ann_recall(spark, spread):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 32))
    rows = [(i, [float(x) for x in centers[i % 40] + spread * rng.normal(size=32)]) for i in range(4000)]
    expected = {x[:1] + x[2:3] for x in brute(rows, 100, 10, lambda x, y: ((x - y) ** 2).sum())}
    found = {(r.query_id, r.vec_id) for r in ann_rows(spark, rows, 100, 10)}
    assert len(found & expected) / len(expected) >= 0.9


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = vectors.picked(df.filter("vec_id % 100 = 0"), "vec_id", "embedding", nonzero=True)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found = {(r.query_id, r.vec_id) for r in ann.search(ann.build(df), queries, 10).collect()}
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        away = ((m - m[ids == q]) ** 2).sum(axis=1)
        away[ids == q] = np.inf
        near = ids[np.argsort(away)[:10]]
        hits += sum((q, x) in found for x in near)
        total += 10
    assert hits / total >= 0.9
