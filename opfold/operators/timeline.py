"""Events, rate limits, progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, limit: int) -> DataFrame:
    """The newest events first: what a ring of that size holds."""
    return events.orderBy(F.desc("seq")).limit(limit)


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.max("time").alias("last_time"))


nothing = object()


def same(a, b) -> bool:
    """Equal keys; null is a key like any other."""
    return a is b or (b is not nothing and (a == b or (pd.isna(a) and pd.isna(b))))


def throttle(events: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """Events at least a gap after the last accepted one of their key; refused ones move nothing.

    The choice depends on each choice before it, so keys stream through workers
    in time order and only a time for the current key is held: a key of any
    size needs one row of memory.
    """
    schema = events.schema
    gap = pd.Timedelta(seconds=gap_seconds)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, last = nothing, None
        for part in parts:
            keep = []
            for k, t in zip(part[key], part["time"], strict=True):
                if not same(k, here):
                    here, last = k, None
                ok = last is None or t - last >= gap
                if ok:
                    last = t
                keep.append(ok)
            yield part[keep]

    return events.repartition(key).sortWithinPartitions(key, "time", "seq").mapInPandas(run, schema)


def debounce(events: DataFrame, key: str, window_seconds: float) -> DataFrame:
    """Batches of wake-ups: the first opens a window of fixed length, those inside join it.

    A batch is the accepted event of a throttle with what follows it.
    """
    schema = f"{key} string, opened timestamp_ntz, wakes long"
    gap = pd.Timedelta(seconds=window_seconds)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, opened, n = nothing, None, 0
        for part in parts:
            out = []
            for k, t in zip(part[key], part["time"], strict=True):
                if not same(k, here) or t - opened >= gap:
                    if n:
                        out.append((here, opened, n))
                    here, opened, n = k, t, 0
                n += 1
            yield pd.DataFrame(out, columns=[key, "opened", "wakes"])
        if n:
            yield pd.DataFrame([(here, opened, n)], columns=[key, "opened", "wakes"])

    return events.select(key, "time", "seq").repartition(key).sortWithinPartitions(key, "time", "seq").mapInPandas(run, schema)


def percent(done: Column, total: Column) -> Column:
    return F.when(total <= 0, 0).when(done >= total, 100).otherwise(F.expr("0") + F.floor(done * 100 / total)).cast("long")


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """What remains at the rate so far; null before anything is done or known."""
    rate = done / elapsed
    return F.when((total > 0) & (done >= total), 0.0).when((total > 0) & (done > 0) & (elapsed > 0), (total - done) / rate)


def with_total(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sums by key and, under the key ``total``, of everything."""
    return rows.rollup(key).agg(F.sum(value).alias(value)).withColumn(key, F.coalesce(key, F.lit("total")))


def last_values(writes: DataFrame) -> DataFrame:
    """Key-value state after writes (key, value, write_no): the last one of each key."""
    return writes.groupBy("key").agg(F.max_by("value", "write_no").alias("value"))
