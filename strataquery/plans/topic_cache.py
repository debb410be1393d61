"""A cache of topic reports that its caller owns: reports as JSON in Parquet, found by topic, policy and bounds.

A report made at another revision is told as invalidated, with the fields that differ; it is never handed out.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The fields that one entry is kept for, and the one that may differ.
IDENTITY = ("topic_sha", "matching_policy", "since_unix_time", "limit")
FIELDS = {"repository_revision": "string", "topic_sha": "string", "matching_policy": "string", "since_unix_time": "long", "limit": "long"}


def canonical(columns: Iterable[str]) -> Column:
    """SHA-256 of the columns as JSON without spaces, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


class TopicCache:
    """Entries lie in a folder that all executors see, one partition to an identity; a lookup reads that one alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def asked(self, key: dict[str, Any]) -> DataFrame:
        """One row: a key's fields, its digest, and the digest of its identity."""
        if set(key) != set(FIELDS):
            raise ValueError(f"a key has the fields {', '.join(FIELDS)}")
        row = self.spark.range(1).select(*(F.lit(key[k]).cast(t).alias(k) for k, t in FIELDS.items()))
        return row.select("*", canonical(FIELDS).alias("digest"), canonical(IDENTITY).alias("identity"))

    def store(self, key: dict[str, Any], report: str) -> None:
        """Keep a report (JSON, as session.to_json gives it) in place of its identity's last one."""
        rows = self.asked(key).withColumn("report", F.lit(report)).coalesce(1)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("identity").parquet(self.folder)

    def entries(self) -> DataFrame:
        """All entries; none where nothing was ever stored."""
        schema = ", ".join([*(f"{k} {t}" for k, t in FIELDS.items()), "digest string", "report string", "identity string"])
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder)

    def lookup(self, key: dict[str, Any]) -> DataFrame:
        """One row: cache_status hit with the report, miss, or invalidated with the fields that differ as name, cached and
        requested."""
        asked = self.asked(key)
        own = asked.first().identity  # names the one partition that is read
        kept = self.entries().where(F.col("identity") == own).select("identity", "report", F.struct(*FIELDS).alias("kept"))
        both = asked.join(kept, "identity", "left")
        unlike = [F.when(~F.col(k).eqNullSafe(F.col(f"kept.{k}")), F.struct(F.lit(k).alias("name"), F.col(f"kept.{k}").cast("string").alias("cached"), F.col(k).cast("string").alias("requested"))) for k in FIELDS]
        found = both.withColumn("differences", F.when(F.col("kept").isNull(), F.array().cast("array<struct<name:string,cached:string,requested:string>>")).otherwise(F.array_compact(F.array(*unlike))))
        status = F.when(F.col("kept").isNull(), "miss").when(F.size("differences") == 0, "hit").otherwise("invalidated")
        told = found.withColumn("cache_status", status)
        return told.select("cache_status", *FIELDS, "digest", F.when(F.col("cache_status") == "hit", F.col("report")).alias("report"), "differences")
