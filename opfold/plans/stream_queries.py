"""The folds as streams: the log is read some files at a time, and the last state must equal the batch result."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from opfold.operators import log
from opfold.plans.registry import LATEST, LOG, query
from opfold.sources import tables
from opfold.streaming import ingest

WIRE = ["src_node", "src_seq", "hlc", "op_type", "col_id", "record_id", "payload", "created", "event_id"]


#: Operations a file: what one task of a batch puts in order.
FILE_ROWS = 1 << 18


def replayed(spark, d, name: str, parts: int = 3):
    """The log written as files of about ``FILE_ROWS`` operations, read back as a stream of so many batches."""
    path = f"{ingest.work_dir(spark, name)}"
    ops = tables.oplog(spark, d).select(*WIRE)
    each = max(1, math.ceil(tables.table(spark, d, "events").count() / FILE_ROWS / parts))  # files a batch
    ops.repartition(parts * each, "event_id").write.parquet(f"{path}/log")
    return spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", each).parquet(f"{path}/log"), path


@query("stream_lww_state", f"WITH {LOG} SELECT col_id, record_id, op_type, payload, hlc, src_node FROM (SELECT *, {LATEST} AS k FROM oplog) WHERE k = 1")
def stream_lww_state(spark, d):
    """foreachBatch into versioned state: an append-mode stream, idempotent on replay."""
    stream, path = replayed(spark, d, "lww")
    state = ingest.StateTable(spark, f"{path}/state", "col_id string, record_id string, op_type string, payload string, hlc string, src_node string")
    return state.at(ingest.ingest(stream, state, f"{path}/checkpoint"))


@query("stream_counters", f"WITH {LOG} SELECT src_node, count(*) AS ops, max(src_seq) AS seq FROM oplog GROUP BY 1")
def stream_counters(spark, d):
    """A stateful aggregate in complete mode; the last batch is the answer."""
    stream, path = replayed(spark, d, "counters")
    ingest.run_available(ingest.counters(stream), f"{path}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out"), "complete")
    return spark.read.schema("src_node string, ops long, seq long").parquet(f"{path}/out")


@query("stream_vector", f"WITH {LOG} SELECT src_node, max(src_seq) AS seq FROM oplog GROUP BY 1")
def stream_vector(spark, d):
    """Vectors adopted batch by batch: maxima of each batch over the state before."""
    stream, path = replayed(spark, d, "vector")
    state, last = ingest.StateTable(spark, f"{path}/state", "src_node string, seq long"), [-1]

    def each(batch, number):
        own = batch.groupBy("src_node").agg(F.max("src_seq").alias("seq"))
        state.advance(number, lambda before: log.adopt(before, own, ""))
        last[0] = number

    ingest.run_available(stream, f"{path}/checkpoint", each, "append")
    return state.at(last[0])
