"""Exact duplicates: one record of each group is compared, the others follow it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LinkageConfig
from ..functions.text import concat_key, normalise, padded, unpadded


def records(df: DataFrame, id_col: str, attrs: Sequence[str | Column], row_id: str | None = None) -> DataFrame:
    """(row_id, rec_id, attr_1, ...) with normalised attributes; row_id orders the records (the id, if not given)."""
    columns = [normalise(F.col(a) if isinstance(a, str) else a).alias(f"attr_{i}") for i, a in enumerate(attrs, 1)]
    return df.select(F.col(row_id or id_col).cast("long").alias("row_id"), F.col(id_col).cast("string").alias("rec_id"), *columns)


def keyed(rows: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """rows with dup_key, by which duplicates are equal."""
    columns = [F.col(a) for a in cfg.keys]
    if cfg.key_mode == "strict":
        return rows.withColumn("dup_key", F.concat_ws("\x1f", *columns))
    return rows.withColumn("dup_key", unpadded(concat_key(*columns)))


def exact_groups(rows: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """(dup_key, u, n_dups): u is the smallest row id of the group."""
    return keyed(rows, cfg).groupBy("dup_key").agg(F.min("row_id").alias("u"), F.count(F.lit(1)).alias("n_dups"))


def key_length(rows: DataFrame, cfg: LinkageConfig) -> int:
    """The longest key."""
    return rows.agg(F.max(F.length(concat_key(*[F.col(a) for a in cfg.keys])))).first()[0] or 0


def unique_records(rows: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """(u, rec_id, attributes, ord_key, n_dups): the first record of each group.

    ord_key orders the records: the key padded with zeros to the longest one.
    """
    values = F.struct("rec_id", *dict.fromkeys((*cfg.attrs, *cfg.keys)))
    groups = keyed(rows, cfg).groupBy("dup_key").agg(
        F.min("row_id").alias("u"), F.min_by(values, "row_id").alias("v"), F.count(F.lit(1)).alias("n_dups")
    )
    order = padded(concat_key(*[F.col(a) for a in cfg.keys]), max(1, key_length(rows, cfg)))
    return groups.select("u", "v.*", "n_dups").withColumn("ord_key", order)


def members(rows: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """(u, row_id, rec_id) for every record."""
    return keyed(rows, cfg).join(exact_groups(rows, cfg).select("dup_key", "u"), "dup_key").select("u", "row_id", "rec_id")
