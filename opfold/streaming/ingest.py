"""The same folds over streams of operations.

No watermark: last-write-wins takes operations however late, and state grows
with the keys, as it must. Replayed batches overwrite what they wrote.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opfold.operators.fold import winners


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors share."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='opfold-')).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def counters(ops: DataFrame) -> DataFrame:
    return ops.groupBy("src_node").agg(F.count("*").alias("ops"), F.max("src_seq").alias("seq"))


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Process what is there in micro-batches, then stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


class StateTable:
    """Versioned state on plain files: a batch writes ``v=<batch>`` from the version before, so a replay overwrites its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def at(self, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={batch}")

    def advance(self, batch: int, step: Callable[[DataFrame], DataFrame]) -> None:
        step(self.at(batch - 1)).write.mode("overwrite").parquet(f"{self.path}/v={batch}")


def ingest(stream: DataFrame, state: StateTable, checkpoint: str) -> int:
    """Fold each micro-batch into the versions table; the last batch's number."""
    last = [-1]

    def each(batch: DataFrame, number: int) -> None:
        fresh = winners(batch)  # an operation delivered again meets its own stamp and changes nothing
        state.advance(number, lambda before: winners(before.unionByName(fresh)))
        last[0] = number

    run_available(stream, checkpoint, each, "append")
    return last[0]
