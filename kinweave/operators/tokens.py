"""Attribute dictionaries and their clusters, which gate the record pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LinkageConfig
from ..functions.distance import value_linked
from ..functions.kmers import normal_block_keys
from ..functions.text import unpadded
from .graph import connected_components


def attribute_values(uniq: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """(attr, u, value): one row for each record and attribute."""
    pairs = F.array(*[F.struct(F.lit(i).alias("attr"), F.col(a).alias("value")) for i, a in enumerate(cfg.attrs, 1)])
    return uniq.select("u", "ord_key", F.explode(pairs).alias("p")).select("p.attr", "u", "ord_key", "p.value")


def attribute_dictionary(uniq: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """(attr, value_key, v, value, n): distinct values, v the first record of each and value its own value."""
    rows = attribute_values(uniq, cfg).withColumn("value_key", unpadded(F.col("value")))
    first = F.struct("ord_key", "u")
    return rows.groupBy("attr", "value_key").agg(
        F.min_by("u", first).alias("v"), F.min_by("value", first).alias("value"), F.count(F.lit(1)).alias("n")
    )


def attribute_links(dictionary: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """(attr, v1, v2, key1, key2): values of an attribute in a common normal block, within the total distance."""
    keys = dictionary.select("attr", F.explode(normal_block_keys(F.col("value"), cfg.k)).alias("block"), "v", "value", "value_key")
    # values that link differ in length by the total at most, which spreads the blocks further
    near = F.transform(F.sequence(F.lit(0), F.lit(cfg.total)), lambda d: F.length("value") + d)
    left = keys.select(
        "attr", "block", F.explode(near).alias("len"), F.col("v").alias("v1"), F.col("value").alias("a"), F.col("value_key").alias("key1")
    )
    right = keys.select("attr", "block", F.length("value").alias("len"), F.col("v").alias("v2"), F.col("value").alias("b"), F.col("value_key").alias("key2"))
    pairs = left.join(right, ["attr", "block", "len"]).filter(F.col("key1") != F.col("key2"))
    found = pairs.filter(value_linked(F.col("a"), F.col("b"), cfg.total))
    low = F.col("key1") < F.col("key2")
    ordered = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return found.select(
        "attr", ordered("v1", "v2").alias("v1"), ordered("v2", "v1").alias("v2"), ordered("key1", "key2").alias("key1"),
        ordered("key2", "key1").alias("key2"),
    ).distinct()


def attribute_clusters(uniq: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """(attr, u, cluster): cluster is the smallest value key of the value's component."""
    dictionary = attribute_dictionary(uniq, cfg)
    found = attribute_links(dictionary, cfg)
    ends = found.select(F.struct("attr", "key1").alias("a"), F.struct("attr", F.col("key2").alias("key1")).alias("b"))
    labels = connected_components(ends).select("node.attr", F.col("node.key1").alias("value_key"), F.col("comp.key1").alias("cluster"))
    rows = attribute_values(uniq, cfg).withColumn("value_key", unpadded(F.col("value")))
    joined = rows.join(labels, ["attr", "value_key"], "left")
    return joined.select("attr", "u", F.coalesce("cluster", "value_key").alias("cluster"))


def gate(uniq: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """(u, ac_1, ac_2, ...): a record's clusters in columns."""
    clusters = attribute_clusters(uniq, cfg)
    pick = lambda i: F.max(F.when(F.col("attr") == i, F.col("cluster"))).alias(f"ac_{i}")
    return clusters.groupBy("u").agg(*[pick(i) for i in range(1, len(cfg.attrs) + 1)])
