"""Places that every executor sees, and small helpers the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strataquery-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/strataquery-{uuid.uuid4().hex}-{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for top in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(top)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def id_crc(column: str) -> Column:
    """crc32 of an id written as text; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


#: Sampled rows for each range that ranges looks for, and the most ranges: a range of more bytes is written in pieces by
#: its one task, so that neither the driver nor the blocks of the shuffle grow with the table beyond that.
SAMPLE_PER_PART, MOST_RANGES = 50, 8192
LOWEST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Ranges:
    """Rows cut into ranges by (id, tie), ascending; a null id comes first. ids and ties are the least row of each range
    but the first; at most MOST_RANGES."""

    ids: np.ndarray
    ties: np.ndarray

    def __len__(self) -> int:
        return len(self.ids) + 1

    def of(self, ids: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and whether the row is the least one of its range's bound."""
        low, high = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
        out, first = high.copy(), np.zeros(len(ids), bool)
        for i in np.flatnonzero(low < high):  # rows whose id is some bound's
            own = self.ties[low[i] : high[i]]
            out[i] = low[i] + np.searchsorted(own, ties[i], side="right")
            first[i] = out[i] > low[i] and own[out[i] - low[i] - 1] == ties[i]
        return out, first


def ranges(keyed: DataFrame, size: int, bytes_each: int) -> Ranges:
    """Even ranges of keyed(id, tie) of about bytes_each of size bytes, from a sample chosen by the rows' hash.

    Rows of one id are told apart by tie, so that an id that many rows bear, or null, is cut too; only rows equal in both
    stay together. The driver gets about SAMPLE_PER_PART rows a range.
    """
    spark = keyed.sparkSession
    parts = min(max(parallelism(spark), -(-size // bytes_each)), MOST_RANGES)
    n = keyed.count()
    none = np.zeros(0, np.int64)
    if n == 0 or parts < 2:
        return Ranges(none, none)
    every = max(1, n // (SAMPLE_PER_PART * parts))
    sample = keyed.where(F.pmod(F.xxhash64(F.lit("bounds"), "id", "tie"), F.lit(every)) == 0)
    found = sample.select(F.coalesce("id", F.lit(int(LOWEST))).alias("id"), "tie").groupBy("id", "tie").agg(F.count(F.lit(1)).alias("n")).toArrow()
    ids, ties, times = (found[c].to_numpy() for c in ("id", "tie", "n"))
    order = np.lexsort((ties, ids))
    upto = np.cumsum(times[order])
    if not len(order):
        return Ranges(none, none)
    cuts = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts, side="right"))
    cuts = order[cuts[(cuts > 0) & (cuts < len(order))]]
    return Ranges(ids[cuts], ties[cuts])


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool, and the heap where the C library can be asked to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, giving its memory back at the end: Python workers are used again, and what one task freed would
    otherwise stay beside the memory of all that follow."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
