"""Counting in Arrow batches, and cutting tables of counts to a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows in one Arrow batch, so that neither side holds a whole task's counts twice.
BATCH = 100_000


def batches_of(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), BATCH):
        yield pa.RecordBatch.from_arrays([c.slice(at, BATCH) for c in columns], names=names)


def most_frequent(counts: DataFrame, n_col: str, most: int, least: int) -> DataFrame:
    """The rows counted `least` times or more; of more than `most` such rows, those above the smallest count that keeps to it.

    Equal counts stay or go together, so no order among them matters. counts should be materialised.
    """
    sizes = counts.filter(F.col(n_col) >= least).groupBy(n_col).agg(F.count(F.lit(1)).alias("rows"))
    kept, cutoff = 0, None
    for n, rows in sizes.orderBy(F.desc(n_col)).limit(most).collect():
        if kept + rows > most:
            break
        kept, cutoff = kept + rows, n
    return counts.filter(F.col(n_col) >= (cutoff if cutoff is not None else 2**62))
