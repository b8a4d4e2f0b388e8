"""Checks on a stream of proofs. A proof is checked on its own, so each micro-batch is a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def verify_stream(stream: DataFrame, check: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True):
    """Write check(batch) of each micro-batch below path, in a folder of the batch's number: a batch that is
    run again after a failure replaces its own rows. once: take what is there, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
