"""Tables written to the shared folder in the middle of a job."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Settings of the writes of stored(): shuffle files go with the write; Arrow batches of long texts stay small, as several tasks of an executor hold one in the JVM and in Python.
WRITES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master, where all tasks share one disk, may go without: it gets a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = str(Path(tempfile.gettempdir()) / "checkpoints" / "pixelloom")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors.

    Shuffle files of the write are not needed once the table is there; Spark is told to drop them. Settings of the session change for the time of the
    write only, and change no result.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITES}
    for k, v in WRITES.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows. Count a stored table, as this reads it once more."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def released(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote, once nothing that is still to run reads them."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
