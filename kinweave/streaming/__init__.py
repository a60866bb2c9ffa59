"""An extra: running duplicate groups over a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LinkageConfig
from ..operators.dedupe import keyed


def running_groups(stream: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """(dup_key, u, n_dups) of the records so far, for output modes "update" and "complete"."""
    return keyed(stream, cfg).groupBy("dup_key").agg(F.min("row_id").alias("u"), F.count(F.lit(1)).alias("n_dups"))
