"""Row numbers, global order, samples and range buckets without a single-task window."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut

_PLACE = "__place"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with the rows' numbers from 0 in their present order, by the sizes of the partitions before."""
    placed = cut(df.withColumn(_PLACE, F.monotonically_increasing_id()))
    part, within = F.shiftright(_PLACE, 33), F.col(_PLACE).bitwiseAND((1 << 33) - 1)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())  # one row for each partition
    before, total = {}, 0
    for p, n in sizes:
        before[p] = total
        total += n
    if not before:
        return placed.withColumn(name, F.lit(0).cast("long")).drop(_PLACE)
    rows = placed.sparkSession.createDataFrame(list(before.items()), "__part long, __before long")
    joined = placed.withColumn("__part", part).join(F.broadcast(rows), "__part")  # one row for each partition
    return joined.withColumn(name, F.col("__before") + within).drop(_PLACE, "__part", "__before")


def ranked(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with each row's place in a global order: a range-partitioned sort, then numbers by partition."""
    return numbered(df.orderBy(*order), name)


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with its key's place among the distinct keys in order, from 0."""
    return df.join(ranked(df.select(key).distinct(), [key], name), key)


def sampled(df: DataFrame, size: int, by: Column) -> DataFrame:
    """`size` rows without replacement, the same ones every time: those of smallest hash of `by`."""
    return df.orderBy(F.md5(by.cast("string").cast("binary")), by).limit(size)


def splitters(df: DataFrame, value: str, key: Column, buckets: int, per_bucket: int = 10) -> list[str]:
    """Bounds of `buckets` ranges: every per_bucket-th value of a sorted sample."""
    rows = sampled(df.select(value, key.alias("__key")), buckets * per_bucket, F.col("__key")).collect()
    values = sorted(r[0] for r in rows)
    return values[per_bucket - 1 :: per_bucket][: buckets - 1]


def bucket_of(value: Column, bounds: list[str]) -> Column:
    """The range a value falls into: as many bounds are below it. A bound itself belongs to the range it ends."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < value))


def assign_buckets(sizes: dict[int, int], bins: int) -> dict[int, int]:
    """Each bucket in order goes to the bin of least load; ties to the higher bin. One entry per bucket."""
    loads = [(0, -b) for b in range(bins)]
    heapq.heapify(loads)
    out = {}
    for bucket in sorted(sizes):
        load, b = heapq.heappop(loads)
        out[bucket] = -b
        heapq.heappush(loads, (load + sizes[bucket], b))
    return out
