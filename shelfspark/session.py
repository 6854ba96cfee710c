"""What a session needs before it runs this package's Python functions."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def let_workers_import(spark: SparkSession) -> SparkSession:
    """Have Python workers look for this package where the driver found it.

    On clusters where executors don't have that folder, ship the package with
    --py-files or in the image; an entry that isn't there does no harm.
    """
    where = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if where not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{known}:{where}".strip(":")
    return spark


#: Rows and bytes of one Arrow batch of files, and bytes of text after which a reader sends on what it has.
FILES, FILE_BYTES = 512, 4 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bound the rows and bytes that one Arrow batch carries to a Python worker, as files are wide."""
    let_workers_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", FILES)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", FILE_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; one of our own only on one machine where it is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
    return where.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a table written in the shared folder."""
    where = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
