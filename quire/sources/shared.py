"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, as in tests, a temporary folder, if all runs on this
    machine; on a cluster executors would scatter the parts over their own disks, so that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _temporary:
        _temporary[app] = "file://" + tempfile.mkdtemp(prefix="quire-")
    return _temporary[app]


def materialized(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read again: later plans start from a table."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that materialized() wrote and no plan reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
