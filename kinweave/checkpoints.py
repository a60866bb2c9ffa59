"""Tables written to the shared checkpoint folder and read back: cut lineage, true sizes, nothing lost with an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that a table may have to be broadcast through the driver.
FEW = 200_000
#: Rows of a file, where a bound on a table's rows is known. On local folders Hadoop without its native library starts a
#: process for every file and one for its checksum (chmod), each for a moment with all of the JVM's memory.
FILE_ROWS = 20_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set on the context. A local master without one gets a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinweave-checkpoints-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """One folder for the application's tables, which goes with it."""
    sc = spark.sparkContext
    folder = f"{ensure_checkpoint_dir(spark)}/kinweave-{sc.applicationId}"
    if getattr(sc, "_kinweave_folder", None) != folder:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._kinweave_folder = folder
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, computed once. What reads it sees a Parquet scan of its true size, however long its own plan was."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    # numbered names: those of df may be equal but for their case; a column of void type isn't written
    kinds = {f"c{i}": f.dataType for i, f in enumerate(df.schema.fields)}
    written = [n for n, kind in kinds.items() if not isinstance(kind, T.NullType)]
    no_marker = {"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
    df.toDF(*kinds).select(written).write.options(**no_marker).parquet(path)
    read = spark.read.schema(T.StructType([T.StructField(n, kinds[n]) for n in written])).parquet(path)
    columns = [F.col(n) if n in written else F.lit(None) for n in kinds]
    out = read.select(*[c.alias(n) for c, n in zip(columns, df.columns, strict=True)])
    out._kinweave_path = path
    return out


def few_files(df: DataFrame, rows: int | None) -> DataFrame:
    """df for cut(), to be written to as few files as hold `rows`, if that is known: a bound on its rows and on what its
    last stage reads, narrow rows both."""
    return df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))


def apart(df: DataFrame, rows: int) -> DataFrame:
    """df, and if it has many rows, not to be broadcast in its next join: its files are compressed, and by their size
    Spark would send millions of rows through the driver."""
    return df if rows <= FEW else df.hint("merge")


def release(*tables: DataFrame) -> None:
    """Deletes tables made by cut() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_kinweave_path", None):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            del df._kinweave_path
