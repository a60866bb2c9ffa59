"""Reading delimited text as records, and writing clusters as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..operators.order import numbered


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(row_id, rec_id, attr_1, ...): every line is a record, its width that of the first line.

    Fields are cut at every separator, without quoting; all are normalised, the id column too. Row ids
    count lines from 0 over all files. Lines of another width, and an empty input, are refused.
    """
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    cells = F.split("value", f"\\Q{separator}\\E", -1)
    width = len(first[0][0].split(separator))
    rows = numbered(lines, "row_id").withColumn("cells", cells)
    complaint = F.raise_error(F.concat(F.lit("ragged line "), F.col("row_id").cast("string")))
    checked = F.when(F.size("cells") == width, F.col("cells")).otherwise(complaint.cast("array<string>"))
    rows = rows.select("row_id", checked.alias("cells"))
    names = ["rec_id", *[f"attr_{i}" for i in range(1, width)]]
    return rows.select("row_id", *[normalise(F.col("cells")[i]).alias(n) for i, n in enumerate(names)])


def output_name(dataset: str, world: int = 0, token_mode: bool = False) -> str:
    return f"Out_{world}_{dataset}{'_tokenBased' if token_mode else ''}.csv"


def write_cluster_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """A folder of text files, one line for each cluster."""
    lines.select(column).write.text(path)
