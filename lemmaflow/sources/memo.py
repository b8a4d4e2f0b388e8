"""Results kept by content, so that what was computed in an earlier run is not computed again.

A store is a folder with a part for each run: key (digest of the content), result columns. A run adds its part as
a whole, under its own name; a run that is repeated, or that was cut off, replaces its part, so results stand in the store once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Memo:
    """store: a folder in any Hadoop store; schema: DDL of the result's columns, kept beside key."""

    def __init__(self, spark: SparkSession, store: str, schema: str):
        self.spark, self.store, self.schema = spark, store.rstrip("/"), StructType.fromDDL(f"key string, {schema}")

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        """Names of the runs whose parts are whole, in order."""
        root, fs = self._path(self.store)
        if not fs.exists(root):
            return []
        parts = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(p.getName() for p in parts if fs.exists(self._path(f"{p.toString()}/_SUCCESS")[0]))

    def known(self, but: str | None = None) -> DataFrame:
        """key and the results of all runs (but one)."""
        paths = [f"{self.store}/{r}" for r in self.runs() if r != but]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def run(self, rows: DataFrame, content: list[str], name: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows with the result columns and reused (was the result there before this run?).

        content: the columns that a result depends on (of any type to_json writes; nulls are a value of their own); none is named key.
        compute gets key and content, a row for each content that no earlier run has, and returns key and the result, a row each. Columns of
        rows named like a result's are replaced. An empty table adds an empty part.
        """
        if not name or name.startswith(("_", ".")) or "/" in name:
            raise ValueError(f"no name for a part: {name!r}")
        key = F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(content)]), {"ignoreNullFields": "false"}), 256)
        results = [f.name for f in self.schema.fields[1:]]
        own = rows.select(*[c for c in rows.columns if c not in (*results, "reused")], key.alias("_key"))
        before = self.known(but=name)
        todo = rows.select(key.alias("key"), *content).join(before.select("key"), "key", "left_anti").dropDuplicates(["key"])
        compute(todo).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).write.mode("overwrite").parquet(f"{self.store}/{name}")
        made = self.spark.read.schema(self.schema).parquet(f"{self.store}/{name}")
        every = before.withColumn("reused", F.lit(True)).unionByName(made.withColumn("reused", F.lit(False)))
        every = every.withColumnRenamed("key", "_found")
        return own.join(every, F.col("_key") == F.col("_found"), "left").drop("_key", "_found")
