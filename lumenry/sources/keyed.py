"""A keyed table that costs what a batch costs: deltas by key bucket, a commit log, merge on read, compaction.

    <path>/deltas/<number>/bucket=<b>/   the rows of a batch
    <path>/bases/<number>/bucket=<b>/    one row a key, of all batches up to that number
    <path>/commits/d<number>, b<number>  empty files: what a reader may see

A batch writes its own rows and then its commit; a batch that comes again finds its commit, or
overwrites files that nobody saw. A reader lists the commits once and reads the latest base and
the deltas after it, so it sees one version whatever is written meanwhile; of the rows of a
key it takes the last in order. Compaction writes a new base beside the old one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class KeyedTable:
    """``schema``: of the rows; ``key``: a column; ``order``: the columns by which the last row of a key is told."""

    path: str
    schema: str
    key: str
    order: tuple[str, ...]
    buckets: int = 16
    compact_every: int = 20  # deltas that a reader merges at most, about

    def _files(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _commits(self, spark: SparkSession) -> tuple[int, list[int]]:
        """(number of the latest base, or -1; numbers of the deltas after it)."""
        files, path = self._files(spark)
        top = path(f"{self.path}/commits")
        names = [f.getPath().getName() for f in files.listStatus(top)] if files.exists(top) else []
        base = max((int(n[1:]) for n in names if n[0] == "b"), default=-1)
        return base, sorted(int(n[1:]) for n in names if n[0] == "d" and int(n[1:]) > base)

    def _commit(self, spark: SparkSession, name: str) -> None:
        files, path = self._files(spark)
        files.create(path(f"{self.path}/commits/{name}"), True).close()

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, where: str) -> None:
        rows.withColumn("bucket", self._bucket(F.col(self.key))).write.mode("overwrite").partitionBy("bucket").parquet(where)

    def _last(self, rows: DataFrame) -> DataFrame:
        names = StructType.fromDDL(self.schema).names
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*names), F.struct(*self.order)).alias("r")).select("r.*")

    def append(self, batch: DataFrame, number: int) -> bool:
        """Writes a batch as the delta of that number; False where it is there already."""
        spark = batch.sparkSession
        base, deltas = self._commits(spark)
        if number <= base or number in deltas:
            return False
        self._write(self._last(batch.select(*StructType.fromDDL(self.schema).names)), f"{self.path}/deltas/{number}")
        self._commit(spark, f"d{number}")
        if len(deltas) + 1 >= self.compact_every:
            self.compact(spark)
        return True

    def _rows(self, spark: SparkSession, base: int, deltas: list[int], bucket: int | None) -> DataFrame:
        folders = ([f"{self.path}/bases/{base}"] if base >= 0 else []) + [f"{self.path}/deltas/{n}" for n in deltas]
        rows = spark.createDataFrame([], self.schema)
        for where in folders:
            found = spark.read.schema(f"{self.schema}, bucket int").option("basePath", where).parquet(where)
            rows = rows.unionByName((found if bucket is None else found.filter(F.col("bucket") == bucket)).drop("bucket"))
        return self._last(rows)

    def read(self, spark: SparkSession) -> DataFrame:
        """One row a key, as of the commits that are there now. A null key is a key."""
        return self._rows(spark, *self._commits(spark), None)

    def lookup(self, spark: SparkSession, key) -> DataFrame:
        """The row of a key: only its bucket's files are read."""
        kind = StructType.fromDDL(self.schema)[self.key].dataType
        bucket = spark.range(1).select(self._bucket(F.lit(key).cast(kind))).first()[0]
        return self._rows(spark, *self._commits(spark), bucket).filter(F.col(self.key).eqNullSafe(F.lit(key).cast(kind)))

    def compact(self, spark: SparkSession) -> None:
        """Merges all deltas into a new base; older files stay for those who read them."""
        base, deltas = self._commits(spark)
        if deltas:
            self._write(self._rows(spark, base, deltas, None), f"{self.path}/bases/{deltas[-1]}")
            self._commit(spark, f"b{deltas[-1]}")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return lambda batch, number: (self.append(batch, number), None)[1]
