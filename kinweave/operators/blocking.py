"""Blocks: (block, u) tables, their sizes, and the work they cause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import normal_block_keys, super_block_keys
from ..functions.text import headless, unpadded


def normal_blocks(df: DataFrame, value: str, k: int = 3, node: str = "u") -> DataFrame:
    return df.select(F.explode(normal_block_keys(F.col(value), k)).alias("block"), node)


def super_blocks(df: DataFrame, value: str, k: int = 3, node: str = "u") -> DataFrame:
    return df.select(F.explode(super_block_keys(F.col(value), k)).alias("block"), node)


def headless_keys(df: DataFrame, value: str, node: str = "u") -> DataFrame:
    """(block, node, shifted): a record's whole key, and its key without the first character."""
    v = F.col(value)
    both = F.array(
        F.struct(unpadded(v).alias("block"), F.lit(False).alias("shifted")),
        F.struct(headless(v).alias("block"), F.lit(True).alias("shifted")),
    )
    others = [c for c in df.columns if c not in (value, node)]
    return df.select(F.explode(both).alias("b"), node, *others).select("b.block", node, "b.shifted", *others)


def block_stats(blocks: DataFrame) -> DataFrame:
    """(block, n, n_pairs)."""
    counts = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("n_pairs", F.expr("n * (n - 1) div 2"))


def chunk_costs(stats: DataFrame, chunks: int) -> DataFrame:
    """(chunk, n_blocks, n_pairs): blocks in order, cut where their pairs pass the next share of all pairs.

    Sums run by first character and then over the few characters' totals, so that no task sees all blocks.
    """
    head = F.substring("block", 1, 1)
    heads = stats.groupBy(head.alias("head")).agg(F.sum("n_pairs").alias("own"))
    running = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    total = stats.agg(F.sum("n_pairs")).first()[0] or 0
    offsets = heads.withColumn("before", F.coalesce(F.sum("own").over(running), F.lit(0)))
    inside = Window.partitionBy("head").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = stats.withColumn("head", head).join(F.broadcast(offsets.select("head", "before")), "head")  # one row for each character
    start = F.col("before") + F.coalesce(F.sum("n_pairs").over(inside), F.lit(0))
    share = max(1, -(-total // chunks))
    chunk = F.least(F.floor(start / share), F.lit(chunks - 1)).cast("long")
    return placed.withColumn("chunk", chunk).groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("n_pairs").alias("n_pairs")
    )
