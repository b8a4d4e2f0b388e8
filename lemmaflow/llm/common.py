"""Shared helpers: working folders, staged tables and word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: ASCII white space: bytes.split() cuts exactly at these, so words are [^\x20\x09-\x0D]+.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    All folders of a run are in one of the application's id, to remove when its results are no longer read.
    Only where that setting is absent in a local session, as in tests, a local temporary folder is used; a cluster
    without it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lemmaflow")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Writer's options for rows of several MB: sizes are looked at after every other row, and row groups, which readers hold whole, end at 16 MB.
WIDE = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 2, "parquet.page.size.row.check.max": 2}


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Remove the folders of staged() tables that nothing reads any more."""
    for t in tables:
        discard(t.sparkSession, t.staged_path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, a query's shuffle files go when it has ended, not when the driver happens to collect garbage. For queries that run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a working folder through Hadoop's file system API, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows(batches, *columns: str):
    """Tuples of the named columns of Arrow batches, one at a time."""
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))


def slices(batches, *columns: str, most: int = 4 << 20):
    """Lists of rows of at most about so many characters of text (the last column), so memory stays bounded."""
    out, held = [], 0
    for r in rows(batches, *columns):
        out.append(r)
        held += len(r[-1] or "")
        if held > most:
            yield out
            out, held = [], 0
    if out:
        yield out


def batched(records, schema, size: int = 2000, max_bytes: int = 8 << 20):
    """Arrow batches of the tuples in records; a batch ends after size rows or about max_bytes of binary or text."""
    import pyarrow as pa

    out, held = [], 0
    for r in records:
        out.append(r)
        held += sum(len(v) for v in r if isinstance(v, (bytes, str)))
        if len(out) >= size or held >= max_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def arrow_schema(ddl: str):
    """Arrow's schema for a flat DDL string; usable inside tasks, where no session is at hand."""
    import pyarrow as pa

    plain = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = []
    for item in ddl.split(","):
        name, kind = item.split()
        kind = pa.list_(plain[kind[6:-1]]) if kind.startswith("array<") else plain[kind]
        fields.append(pa.field(name.strip("`"), kind))
    return pa.schema(fields)
