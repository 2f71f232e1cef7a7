"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, other bytes as they are.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and tab, line feed, vertical tab, form feed, return to a space.
LOWER_AND_SPACES = bytes(32 if 9 <= b <= 13 else ASCII_LOWER[b] for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the test data, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only a session with a local
    master may do without one (tests) and gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = java.get() if java.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="opfold-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/opfold/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    A lost executor then costs a re-read, never a recomputation upstream.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column, n: int):
    """crc32 of a number's decimal text, mod ``n`` (null stays null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample to learn ``label`` from, and how many rows each value has.

    The sample has (doc_id, label, text) of at most ``rows`` labelled documents
    of ``docs`` for each value, outside the held-out fold and of any length,
    taken by the hash of their id, so that it is spread over the whole table and
    the same in every run. Null and contradicting labels are left out; a label
    given twice counts once, and so does a document (its least text; null is
    empty).
    """
    own = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .filter(crc_mod(F.col("doc_id"), folds) != held)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("__z"))
        .filter(F.col("label") == F.col("__z"))
        .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
        .select("doc_id", "label")
    )
    own = written(own, "labelled")
    counts = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bounded = [own.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(bounded[0].union(bounded[1])), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic model (the last is the constant), by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * np.append(w[:-1], 0)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.diag(np.append(np.ones(len(w) - 1), 1e-9))
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, score_of, name: str = "score") -> DataFrame:
    """doc_id and ``score_of(list of bytes or None)`` of every row, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary())
            scores = np.concatenate([np.zeros(0), *(score_of(texts.slice(at, 256).to_pylist()) for at in range(0, batch.num_rows, 256))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", name])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {name} double")


def kept_by_score(docs: DataFrame, score_of, keep) -> DataFrame:
    """The rows, with all their columns, whose text's score satisfies ``keep``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(at), pa.binary())
            scores = np.concatenate([np.zeros(0), *(score_of(texts.slice(k, 256).to_pylist()) for k in range(0, batch.num_rows, 256))])
            yield batch.filter(pa.array(keep(scores), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
