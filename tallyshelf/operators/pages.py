"""Pages of a sorted listing: written once in order, with a directory, and read page by page.

A file of the listing holds rows that follow one another. The directory says per file how many rows come before
it and which key it starts with, so a page, by number or after a key, opens the one or two files it lies in;
page 10,000 reads as little as page 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyshelf.session import settle

#: Rows of a file; several pages.
FILE_ROWS = 100_000


def _in_parts(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows in order, with the task that holds them (``_part``) and their place there (``_at``)."""
    schema = StructType([*df.schema.fields, StructField("_part", LongType()), StructField("_at", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            places = pa.array(range(at, at + n), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int64()), places], [*batch.schema.names, "_part", "_at"])
            at += n

    return df.orderBy(*order).mapInArrow(run, schema)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add a row's place in a total order, from 1, without one task seeing all rows.

    The sort deals the rows by range; each task counts its own, and what comes before it is one number a task.
    """
    rows = settle(_in_parts(df, order))
    return _placed(rows, name).drop("_part", "_at")


def _placed(rows: DataFrame, name: str) -> DataFrame:
    sizes = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    return rows.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_before")


def write_pages(df: DataFrame, order: Sequence[Column], path: str, file_rows: int = FILE_ROWS) -> None:
    """Write a listing for ``read_page``. ``order`` must be total; equal rows may change places otherwise."""
    rows = _placed(settle(_in_parts(df, order)), "_nth").drop("_part", "_at")
    filed = rows.withColumn("_file", F.floor((F.col("_nth") - 1) / file_rows))
    filed.repartition("_file").sortWithinPartitions("_file", "_nth").write.mode("overwrite").partitionBy("_file").parquet(f"{path}/rows")
    listed = df.sparkSession.read.schema(filed.schema).parquet(f"{path}/rows")
    directory = listed.groupBy(F.col("_file").cast("bigint").alias("file")).agg(
        F.min("_nth").alias("first"), F.max("_nth").alias("last"), F.min_by(F.struct(*[c for c in listed.columns if not c.startswith("_")]), "_nth").alias("head"))
    directory.coalesce(1).sortWithinPartitions("file").write.mode("overwrite").parquet(f"{path}/directory")


class Pages:
    """A written listing. The directory, one row a file, is read once."""

    def __init__(self, spark: SparkSession, path: str, size: int):
        self.spark, self.path, self.size = spark, path, size
        self.directory = spark.read.parquet(f"{path}/directory")
        self.total = self.directory.agg(F.max("last")).first()[0] or 0

    def last(self) -> int:
        """Number of the last page; pages count from 0."""
        return max(0, -(-self.total // self.size) - 1)

    def _files(self, files: list[int]) -> DataFrame:
        """The rows of some files; no other file is listed or opened."""
        if not files:
            return self.spark.createDataFrame([], self.directory.schema["head"].dataType).withColumn("_nth", F.lit(None).cast("bigint"))
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/_file={k}" for k in files]).drop("_file")

    def _rows(self, low: int, high: int) -> DataFrame:
        """Rows low < place <= high, out of the files they lie in."""
        files = [r["file"] for r in self.directory.filter((F.col("first") <= high) & (F.col("last") > low)).select("file").collect()]
        return self._files(files).filter((F.col("_nth") > low) & (F.col("_nth") <= high)).orderBy("_nth").drop("_nth")

    def read(self, number: int) -> DataFrame:
        """A page by number; one past the end is the last page, one below zero the first."""
        number = min(max(number, 0), self.last())
        return self._rows(number * self.size, (number + 1) * self.size)

    def read_after(self, key: str, after: object, descending: bool = False) -> DataFrame:
        """The page of rows behind a value of ``key``, the column the listing is sorted by first.

        ``key`` has no nulls. The directory tells the files to open: those from the last one that starts
        before the value on, until a page is full.
        """
        value, head = F.lit(after), F.col(f"head.{key}")
        passed = head >= value if descending else head <= value
        file = self.directory.filter(passed).agg(F.max("file")).first()[0]
        beyond = F.col(key) < value if descending else F.col(key) > value
        # The first row behind the value lies in the last file that starts before it, or begins the next one.
        first = None if file is None else self._files([file]).filter(beyond).agg(F.min("_nth")).first()[0]
        if first is None:
            first = self.directory.filter(F.col("file") > (-1 if file is None else file)).agg(F.min("first")).first()[0]
        return self._files([]).drop("_nth") if first is None else self._rows(first - 1, first - 1 + self.size)
