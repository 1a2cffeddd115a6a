"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
PARTS = 4


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; below a temporary one where that is unset and Spark runs in one process."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not top:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="lumenry-")
        top = _own[context.applicationId]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and is computed once."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(scan: DataFrame) -> int | None:
    """Over how many parts rows of a scan should be dealt where tasks sort them: some for each split, so that a task's share doesn't
    grow with the table. None, for as many as the session says, where there are fewer splits than cores."""
    splits = scan.rdd.getNumPartitions()
    return PARTS * splits if splits >= scan.sparkSession.sparkContext.defaultParallelism else None


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt by their keys over so many parts; as they are, if None."""
    return rows if parts is None else rows.repartition(parts, *keys)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt anew, as costly expressions follow; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
