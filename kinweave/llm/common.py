"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..checkpoints import cut, ensure_checkpoint_dir

__all__ = ["cut", "ensure_checkpoint_dir", "lower_ascii", "map_texts", "table"]

ID, TEXT = "__id", "__text"
#: Rows of a batch that are Python values at once.
ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    start: Callable[[], Callable[[list, list], dict[str, list]]],
    fields: list[T.StructField],
    batch_chars: int = 8_000_000,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Runs Python over Arrow batches of (id, text).

    start() is called once in each task and returns a function of (ids, texts, *extra) that returns
    the columns of the result. Only id, text and the extra columns are read, under names of their
    own, so other columns of df can't clash. Batches are split so that one call sees about
    batch_chars characters, or one document if that is longer.
    """
    id_type = df.schema[id_col].dataType
    extra = extra or {}
    picked = df.select(
        F.col(id_col).alias(ID), F.col(text_col).alias(TEXT), *[c.alias(f"__x{i}") for i, c in enumerate(extra.values())]
    )
    schema = T.StructType([T.StructField(id_col, id_type), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()

        def call(cols: list[list]) -> pa.RecordBatch:
            out = work(*cols)
            return pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow)

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            cols = [c.to_pylist() for c in batch.columns]
            at, size = 0, 0
            for i, text in enumerate(cols[1]):
                size += len(text) if text is not None else 0
                if size >= batch_chars:
                    yield call([c[at : i + 1] for c in cols])
                    at, size = i + 1, 0
            if at < len(cols[1]):
                yield call([c[at:] for c in cols])

    return picked.mapInArrow(run, schema)
