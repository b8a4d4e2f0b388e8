"""Intermediate tables of iterative plans, in a folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir. Only a local session without that setting, as in tests, gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lemmaflow")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


class Stages:
    """Tables of one iterative run. Each is written as Parquet and read back, so lineage ends there and lost executors cost no round.

    Two kinds: one that every round writes anew (put; the version before the last is removed, so the last one may still be
    read while the next is made), and one that grows by a part a round (add, deal; read as a whole, with the column round).
    Tables that deal() makes are external ones of the session's catalog, of names that no other run has.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.versions = spark, shared_folder(spark, name), {}

    def put(self, key: str, df: DataFrame) -> DataFrame:
        n = self.versions[key] = self.versions.get(key, -1) + 1
        path = f"{self.root}/{key}-{n}"
        df.write.option("compression", "zstd").parquet(path)
        if n > 1:
            self._remove(f"{self.root}/{key}-{n - 2}")
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, key: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The part that df is, and the whole with all parts before it."""
        n = self.versions[key] = self.versions.get(key, -1) + 1
        df.write.option("compression", "zstd").parquet(f"{self.root}/{key}/round={n}")
        part = self.spark.read.schema(df.schema).parquet(f"{self.root}/{key}/round={n}")
        return part, self.spark.read.schema(StructType([*df.schema.fields, StructField("round", IntegerType())])).parquet(f"{self.root}/{key}")

    def deal(self, key: str, df: DataFrame, *on: str) -> tuple[DataFrame, DataFrame]:
        """As add(), but dealt to buckets by the columns on: joins and groups by these leave part and whole where they are."""
        n = self.versions[key] = self.versions.get(key, -1) + 1
        name, buckets = f"lemmaflow_{self.root[-32:]}_{key}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        out = df.withColumn("round", F.lit(n)).write.partitionBy("round").bucketBy(buckets, *on)
        out.option("path", f"{self.root}/{key}").option("compression", "zstd").mode("append").saveAsTable(name)
        whole = self.spark.table(name)
        return whole.filter(F.col("round") == n).drop("round"), whole

    def drop(self, key: str) -> None:
        """Remove what put() has kept of key."""
        for n in range(max(0, self.versions[key] - 1), self.versions[key] + 1):
            self._remove(f"{self.root}/{key}-{n}")

    def _remove(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
