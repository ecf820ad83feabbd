"""Token counts as additive rollups that signed deltas maintain.

Totals per (source, lang, tokenizer) are the sum of all committed batches. A batch is a folder named by its
id that holds the batch's own sums; its success mark is the commit. Committing an id again does nothing,
and a batch whose writer died is written anew, so retries never count twice. Texts are not kept: an insert
counts a document once, a delete takes its stored counts away, a revision adds new less old.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm.common import column
from tallyshelf.llm.tokens import encoder, portions

KEYS = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def count(docs: DataFrame, tokenizer: str, path: str, into: str = "tokens", text: str = "text") -> DataFrame:
    """Add the number of token ids of each whole text (null: 0). ``path`` names the tokenizer's file."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = encoder(path)
        for batch in batches:
            yield pa.array([len(ids) // known.type.itemsize for part in portions(batch.to_pylist()) for ids in known.encode(part)], pa.int64())

    return docs.withColumn(into, F.arrow_udf(run, "bigint")(column(text)))


def inserted(counts: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """Deltas of new documents from their counts (columns source, lang and ``tokens``)."""
    return _delta(counts, tokenizer, F.lit(1), F.coalesce(column(tokens), F.lit(0)))


def deleted(counts: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """Deltas of documents that go, from the counts they came in with."""
    return _delta(counts, tokenizer, F.lit(-1), -F.coalesce(column(tokens), F.lit(0)))


def revised(counts: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    """Deltas of documents counted anew by the same tokenizer version."""
    return _delta(counts, tokenizer, F.lit(0), F.coalesce(column(new), F.lit(0)) - F.coalesce(column(old), F.lit(0)))


def _delta(counts: DataFrame, tokenizer: str, docs, tokens) -> DataFrame:
    return counts.select(column("source").cast("string").alias("source"), column("lang").cast("string").alias("lang"),
                         F.lit(tokenizer).alias("tokenizer"), docs.cast("bigint").alias("docs"), tokens.cast("bigint").alias("tokens"))


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals in a folder that all executors share.

    Null keys are a group of their own, empty batches commit and add nothing, a group whose documents and
    tokens are all taken away is not listed. A source of any share of the rows is summed in each task first.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self) -> list[str]:
        fs, path = self._path("")
        if not fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and self._whole(s.getPath().getName()))

    def _whole(self, name: str) -> bool:
        fs, path = self._path(f"{name}/_SUCCESS")
        return fs.exists(path)

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest compaction and the batches that are in it."""
        bases = [n for n in self._names() if n.startswith("base-")]
        if not bases:
            return None, set()
        held = self.spark.read.schema("batch string").parquet(f"{self.folder}/{bases[-1]}/batches")
        return bases[-1], {r["batch"] for r in held.toLocalIterator()}

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch once; False if this id was committed before."""
        name = "batch-" + urllib.parse.quote(batch_id, safe="")
        if self._whole(name) or name in self._base()[1]:
            return False
        _summed(deltas).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return True

    def totals(self) -> DataFrame:
        base, held = self._base()
        paths = [f"{self.folder}/{base}/totals"] * bool(base) + [
            f"{self.folder}/{n}" for n in self._names() if n.startswith("batch-") and n not in held]
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return _summed(rows).filter("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into one table that remembers their ids."""
        base, held = self._base()
        batches = held | {n for n in self._names() if n.startswith("batch-")}
        name = f"base-{int(base.split('-')[1]) + 1 if base else 0:08d}"
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/{name}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch string").write.mode("overwrite").parquet(
            f"{self.folder}/{name}/batches")
        fs, mark = self._path(f"{name}/_SUCCESS")
        fs.create(mark, True).close()
