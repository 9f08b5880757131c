"""Reading the engine's tables, and tables that a job writes between its steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; a temporary one only where none is set (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pageguard-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pageguard/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, however often it is read, and safe from lost executors.

    Its files can be a hundredth of its rows (nodes of pages that are alike), and Spark takes the size of files for that of
    rows. Joins with it shuffle, as a broadcast of it might not fit into the driver.
    """
    path = run_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


#: Rows that make one partition where a short row becomes much work.
ROWS_A_TASK = 2000


def spread(df: DataFrame, key: str | None = None, rows: int = ROWS_A_TASK) -> DataFrame:
    """df dealt to tasks by its number of rows, evenly or by a key: a small file of short rows is otherwise read by one task."""
    n = max(1, min(-(-df.count() // rows), 20_000))
    return df.repartition(n, key) if key else df.repartition(n)
