"""The library's queries over the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import apart, cut
from ..config import LinkageConfig
from ..functions.distance import bounded_distance
from ..functions.kmers import cyclic_kmers, kmer_code, super_block_code
from ..functions.text import concat_key, headless, padded, row_string, row_values, unpadded
from ..operators import blocking, candidates, dedupe, graph, order, tokens
from .linkage import LinkageResult, link_records

ATTRS = ("attr_1", "attr_2", "attr_3", "attr_4")
CONFIG = LinkageConfig(ATTRS, (1, 1, 1, 1), total=1)
#: The word table: one attribute.
WORDS = LinkageConfig(("attr_1",), (1,), total=1)


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return dedupe.records(part, "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return dedupe.records(customer, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey", F.lit("")])


def parts(spark: SparkSession, sf_dir: str, **changes) -> LinkageResult:
    return link_records(part_records(spark, sf_dir), replace(CONFIG, **changes))


def customers(spark: SparkSession, sf_dir: str, **changes) -> LinkageResult:
    return link_records(customer_records(spark, sf_dir), replace(CONFIG, block_attr=1, **changes))


def normalize_part(spark, sf_dir):
    return part_records(spark, sf_dir)


def row_strings(spark, sf_dir):
    """Rows as one string, and what their fields are when it is cut again."""
    rows = part_records(spark, sf_dir).select("row_id", row_string("rec_id", *ATTRS).alias("line"))
    cells = row_values(F.col("line"))
    return rows.select("row_id", "line", F.size(cells).cast("long").alias("n_values"), cells[1].alias("attr_1"))


def dedupe_keys(spark, sf_dir):
    return dedupe.keyed(part_records(spark, sf_dir), CONFIG).select("row_id", "dup_key")


def padded_keys(spark, sf_dir):
    """Keys, blocking values and their headless forms, padded to the longest."""
    rows = part_records(spark, sf_dir)
    longest = dedupe.key_length(rows, CONFIG)
    width = rows.agg(F.max(F.length("attr_1"))).first()[0] or 1
    value = F.col("attr_1")
    return rows.select(
        "row_id", padded(concat_key(*ATTRS), max(1, longest)).alias("key"), padded(value, width).alias("value"),
        padded(headless(value), width).alias("shifted"), F.length(concat_key(*ATTRS)).cast("long").alias("n_chars"),
    )


def exact_groups(spark, sf_dir):
    return dedupe.exact_groups(part_records(spark, sf_dir), CONFIG)


def strict_groups(spark, sf_dir):
    cfg = replace(CONFIG, key_mode="strict")
    return dedupe.exact_groups(part_records(spark, sf_dir), cfg).select("u", "n_dups")


def unique_records(spark, sf_dir):
    return dedupe.unique_records(part_records(spark, sf_dir), CONFIG)


def exact_members(spark, sf_dir):
    return dedupe.members(part_records(spark, sf_dir), CONFIG)


def sorted_rank(spark, sf_dir):
    """Dense ids of the unique records in the order of their padded keys."""
    uniq = dedupe.unique_records(part_records(spark, sf_dir), CONFIG)
    return order.ranked(uniq.select("u", "ord_key"), ["ord_key"], "dense_id")


def sorted_by_length(spark, sf_dir):
    rows = dedupe.keyed(part_records(spark, sf_dir), CONFIG).select("row_id", "dup_key")
    return order.ranked(rows, [F.length("dup_key"), "dup_key", "row_id"], "place")


def sorted_plain(spark, sf_dir):
    rows = dedupe.keyed(part_records(spark, sf_dir), CONFIG).select("row_id", "dup_key")
    return order.ranked(rows, ["dup_key", "row_id"], "place")


def random_sample(spark, sf_dir):
    """100 records without replacement, in order."""
    rows = dedupe.keyed(part_records(spark, sf_dir), CONFIG).select("row_id", "dup_key")
    return order.sampled(rows, 100, F.col("row_id"))


def range_buckets(spark, sf_dir):
    """Eight ranges of keys: their sizes and ends."""
    rows = dedupe.keyed(part_records(spark, sf_dir), CONFIG).select("row_id", "dup_key")
    bounds = order.splitters(rows, "dup_key", F.col("row_id"), 8)
    placed = rows.select("dup_key", order.bucket_of(F.col("dup_key"), bounds).cast("long").alias("bucket"))
    return placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("dup_key").alias("low"), F.max("dup_key").alias("high"))


def bucket_assignment(spark, sf_dir):
    """The ranges dealt to three bins, the least loaded first."""
    buckets = range_buckets(spark, sf_dir).select("bucket", "n")
    sizes = {r[0]: r[1] for r in buckets.collect()}  # eight rows
    bins = order.assign_buckets(sizes, 3)
    rows = [(b, n, bins[b]) for b, n in sizes.items()]
    return spark.createDataFrame(rows, "bucket long, n long, bin long")


def kmer_blocks(spark, sf_dir):
    return blocking.normal_blocks(parts(spark, sf_dir).unique, "attr_1")


def super_blocks(spark, sf_dir):
    return blocking.super_blocks(parts(spark, sf_dir).unique, "attr_1")


def kmer_codes(spark, sf_dir):
    rows = part_records(spark, sf_dir).select("row_id", "attr_1", F.posexplode(cyclic_kmers(F.col("attr_1"))).alias("pos", "kmer"))
    return rows.select(
        "row_id", F.col("pos").cast("long").alias("pos"), "kmer", kmer_code(F.col("kmer")).alias("code"),
        super_block_code(F.col("attr_1"), F.col("kmer")).alias("super_code"),
    )


def block_stats(spark, sf_dir):
    return blocking.block_stats(super_blocks(spark, sf_dir))


def block_totals(spark, sf_dir):
    return block_stats(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.max("n").alias("largest"), F.sum("n_pairs").alias("n_pairs")
    )


def chunk_cost(spark, sf_dir):
    return blocking.chunk_costs(block_stats(spark, sf_dir), 20)


def chunk_balance(spark, sf_dir):
    return chunk_cost(spark, sf_dir).agg(
        F.min("n_pairs").alias("least"), F.max("n_pairs").alias("most"), F.sum("n_pairs").alias("total")
    )


def headless_keys(spark, sf_dir):
    return blocking.headless_keys(parts(spark, sf_dir).unique.select("u", "attr_1"), "attr_1").select("block", "u", "shifted")


def bounded_edit_distance(spark, sf_dir):
    """Distances of at most 2 between names of suppliers of a nation."""
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_name")
    a, b = (names.select("s_nationkey", F.col("s_suppkey").alias(f"k{i}"), F.col("s_name").alias(f"n{i}")) for i in (1, 2))
    pairs = a.join(b, "s_nationkey").filter("k1 < k2")
    return pairs.select("k1", "k2", bounded_distance(F.col("n1"), F.col("n2"), 2).cast("long").alias("distance"))


def block_pairs(spark, sf_dir):
    return candidates.block_pairs(parts(spark, sf_dir).unique, CONFIG)


def headless_pairs(spark, sf_dir):
    return candidates.headless_pairs(parts(spark, sf_dir).unique, CONFIG)


def headless_adjacent(spark, sf_dir):
    return candidates.headless_neighbours(parts(spark, sf_dir).unique, CONFIG)


def headless_links(spark, sf_dir):
    """Links of neighbours among equal headless keys alone."""
    uniq = parts(spark, sf_dir).unique
    return candidates.verified(candidates.headless_neighbours(uniq, CONFIG), uniq, CONFIG)


def links(spark, sf_dir):
    return parts(spark, sf_dir).links


def links_adjacent(spark, sf_dir):
    return parts(spark, sf_dir, headless="adjacent").links


def links_exact(spark, sf_dir):
    return parts(spark, sf_dir, candidates="exact").links


def links_brand_blocks(spark, sf_dir):
    return parts(spark, sf_dir, block_attr=1).links


def links_customer(spark, sf_dir):
    return customers(spark, sf_dir).links


def unconnected_pairs(spark, sf_dir):
    """Block pairs that the headless pass has not connected yet."""
    uniq = parts(spark, sf_dir).unique
    return candidates.block_pairs(uniq, CONFIG, graph.components(uniq, candidates.headless_links(uniq, CONFIG)))


def components(spark, sf_dir):
    return parts(spark, sf_dir).components


def components_customer(spark, sf_dir):
    return customers(spark, sf_dir).components


def merged_components(spark, sf_dir):
    """Components of the headless pass and of the block pass apart, then merged."""
    result = parts(spark, sf_dir)
    uniq = result.unique
    found = cut(candidates.with_attributes(result.links, uniq, ("attr_1",)))  # links share a block or a headless key
    first, second = (found.filter(same).select("u1", "u2") for same in (candidates.shares_headless(CONFIG), candidates.shares_block(CONFIG, False)))
    return graph.merged_components(graph.components(uniq, first), graph.components(uniq, second))


def component_sizes(spark, sf_dir):
    return components(spark, sf_dir).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))


def component_links(spark, sf_dir):
    return parts(spark, sf_dir).component_links


def leader_clusters(spark, sf_dir):
    return parts(spark, sf_dir).clusters


def leader_clusters_customer(spark, sf_dir):
    return customers(spark, sf_dir).clusters


def cluster_members(spark, sf_dir):
    return parts(spark, sf_dir).cluster_members


def cluster_lines(spark, sf_dir):
    return parts(spark, sf_dir).cluster_lines


def run_summary(spark, sf_dir):
    return parts(spark, sf_dir).summary


def attr_dictionary(spark, sf_dir):
    found = tokens.attribute_dictionary(parts(spark, sf_dir).unique, CONFIG)
    return found.withColumn("attr", F.col("attr").cast("long"))


def attr_blocks(spark, sf_dir):
    """Normal blocks of the dictionary's values: their sizes by attribute."""
    values = attr_dictionary(spark, sf_dir)
    found = values.select("attr", "v", F.explode(F.array_distinct(cyclic_kmers(F.col("value")))).alias("block"))
    return found.groupBy("attr", "block").agg(F.count(F.lit(1)).alias("n"))


def attr_links(spark, sf_dir):
    found = tokens.attribute_links(tokens.attribute_dictionary(parts(spark, sf_dir).unique, CONFIG), CONFIG)
    return found.select(F.col("attr").cast("long").alias("attr"), "key1", "key2")


def attr_clusters(spark, sf_dir):
    found = tokens.attribute_clusters(parts(spark, sf_dir).unique, CONFIG)
    return found.withColumn("attr", F.col("attr").cast("long"))


def token_gated_links(spark, sf_dir):
    return parts(spark, sf_dir, token_gate=True).links


def token_gated_components(spark, sf_dir):
    return parts(spark, sf_dir, token_gate=True).components


def token_gated_clusters(spark, sf_dir):
    return parts(spark, sf_dir, token_gate=True).clusters


def word_records(spark: SparkSession, sf_dir: str, least: int = 10) -> DataFrame:
    """Distinct words a-z of all documents, of `least` letters or more."""
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    words = text.select(F.explode(F.split("t", "[^a-z]+")).alias("attr_1")).filter(F.length("attr_1") >= least).distinct()
    return order.ranked(words, ["attr_1"], "row_id").select("row_id", F.col("attr_1").alias("rec_id"), "attr_1")


def word_components(spark, sf_dir):
    """Components of words one edit apart: (word, first word of its component)."""
    words = cut(word_records(spark, sf_dir).select(F.col("row_id").alias("u"), F.col("attr_1").alias("word")))
    value = F.col("word")
    shorter = F.transform(
        F.sequence(F.lit(1), F.length(value)),
        lambda j: F.concat(F.substring(value, F.lit(1), j - 1), F.substring(value, j + 1, F.length(value))),
    )
    keys = words.select("u", "word", F.explode(F.array_distinct(F.concat(F.array(value), shorter))).alias("near"))
    a, b = (keys.select("near", F.col("u").alias(f"u{i}"), F.col("word").alias(f"w{i}")) for i in (1, 2))
    # a key for each character: a table that looks small by its words' size must not be broadcast
    close = a.join(b.hint("merge"), "near").filter(F.col("u1") < F.col("u2")).filter(bounded_distance(F.col("w1"), F.col("w2"), 1) >= 0)
    found = graph.components(words, close.select("u1", "u2").distinct())
    n = words.count()
    first = words.select(F.col("u").alias("comp"), F.col("word").alias("first_word"))
    named = found.join(apart(words, n), "u").join(apart(first, n), "comp")
    return named.select("word", "first_word")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        normalize_part, row_strings, dedupe_keys, padded_keys, exact_groups, strict_groups, unique_records, exact_members,
        sorted_rank, sorted_by_length, sorted_plain, random_sample, range_buckets, bucket_assignment,
        kmer_blocks, super_blocks, kmer_codes, block_stats, block_totals, chunk_cost, chunk_balance,
        headless_keys, bounded_edit_distance, block_pairs, headless_pairs, headless_adjacent, headless_links,
        links, links_adjacent, links_exact, links_brand_blocks, links_customer, unconnected_pairs,
        components, components_customer, merged_components, component_sizes, component_links,
        leader_clusters, leader_clusters_customer, cluster_members, cluster_lines, run_summary,
        attr_dictionary, attr_blocks, attr_links, attr_clusters, token_gated_links, token_gated_components, token_gated_clusters,
        word_components,
    ]
    return {f.__name__: f for f in found}
