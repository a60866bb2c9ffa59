"""Vector columns: which rows take part, Arrow batches as matrices, and blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, VECTOR = "__id", "__vector"
#: Queries that are broadcast at once: the bound of what a task holds of them.
QUERY_BLOCK = 8_192


def usable(vector: Column, nonzero: bool = False) -> Column:
    """Not null, without null or non-finite components; if asked for, not all zero (an empty vector is)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = vector.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0) if nonzero else fine, F.lit(False))


def picked(df: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """(id, vector) of the rows that take part. Ids are whole numbers; a null id takes no part."""
    return (
        df.select(F.col(id_col).cast("long").alias(ID), F.col(vector_col).cast("array<double>").alias(VECTOR))
        .filter(F.col(ID).isNotNull() & usable(F.col(VECTOR), nonzero))
    )


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each dimension found in a batch of (id, vector)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    column = batch.column(1)
    ends = column.offsets.to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield ids[rows], values[(ends[rows][:, None] + np.arange(d)[None, :])].reshape(len(rows), d)


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of all queries in blocks of bounded size and one dimension, in order of id.

    Each block is one small job over a range of ids, so that the driver never holds more than one.
    """
    lower = None
    while True:
        rest = queries if lower is None else queries.filter(F.col(ID) > lower)
        table = rest.orderBy(ID).limit(block).toArrow()
        if not table.num_rows:
            return
        last = table.column(0)[-1].as_py()
        if table.num_rows == block:  # rows that repeat the last id stay together
            same = queries.filter(F.col(ID) == last).toArrow()
            table = pa.concat_tables([table.filter(pc.less(table.column(0), last)), same])
        for batch in table.combine_chunks().to_batches():
            yield from matrices(batch)
        lower = last
