"""Shared plumbing of the training-data operators: reading tables, scratch tables in the cluster's
shared folder, bounded Arrow batches and word splitting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from auditlake.session import importable, only_local

#: Rows and bytes of text that an operator takes from an Arrow batch at a time. Texts have no length limit; Spark's
#: own `spark.sql.execution.arrow.maxBytesPerBatch` (64 MB) bounds the batch, and no session option is changed.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short(batches: Iterator[pa.RecordBatch], column: int, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and `size` bytes of a text column (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in runs(sizes, size):
            for i in range(a, b, rows):
                yield batch.slice(i, min(rows, b - i))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where none is configured (tests, local runs) a local one."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("auditlake.scratch.dir", None)
    if not where:
        only_local(spark)
        where = tempfile.mkdtemp(prefix="auditlake-")
        spark.conf.set("auditlake.scratch.dir", where)
    return where


class Scratch:
    """Tables written once to the shared folder: they cut lineage, survive lost executors and are
    read many times. `drop` removes the ones a later step no longer reads."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/auditlake-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(sc.hadoopConfiguration()).delete(path, True)
        free_shuffles(self.spark)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go once the driver has dropped the objects that hold them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, null as None."""
    return column.cast(pa.binary()).to_pylist()


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of `df` with more columns."""
    added = [f for name, kind in columns.items() for f in T.StructType.fromDDL(f"`{name}` {kind}").fields]
    return T.StructType([*df.schema.fields, *added])


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices of rows of at most `limit` bytes together (a longer row stands alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Interned(dict):
    """Numbers for words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def intern_words(words: list, numbers: Interned) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
