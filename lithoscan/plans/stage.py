"""Tables that a plan writes for itself, in the folder that all executors share.

What is read more than once, or by a loop, is written as Parquet, so lineage
stays flat and a lost executor costs a re-read. The tables are named by a tag
and a random number and stay until :func:`discard` or :func:`sweep` deletes
them: a lazy result may still read them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written and not yet deleted, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``, or the checkpoint folder that was set.

    Only where neither is set and all runs in one process, as in tests, a
    temporary folder becomes the checkpoint folder; on a cluster that raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lithoscan-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet and read back: flat lineage that outlives executors. Eager."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`staged` that nothing reads any more; other tables stay."""
    spark = df.sparkSession
    own = _WRITTEN.get(spark.sparkContext.applicationId, [])
    read = {_name(f.rsplit("/", 1)[0]) for f in df.inputFiles()}
    for path in [p for p in own if _name(p) in read]:
        _delete(spark, path)
        own.remove(path)


def sweep(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete all tables that :func:`staged` has written for this application but those that ``keep`` reads."""
    kept = {_name(f.rsplit("/", 1)[0]) for df in keep for f in df.inputFiles()}
    own = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in [p for p in own if _name(p) not in kept]:
        _delete(spark, path)
        own.remove(path)
