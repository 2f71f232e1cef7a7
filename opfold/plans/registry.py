"""Where queries and their oracles are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The derived log in DuckDB, as sources.tables derives it in Spark.
LOG = """
e AS (SELECT event_id, ts, event_type, props, user_id % 5 AS n, epoch_ms(ts) // 86400000 * 86400000 AS day FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY event_id) AS src_seq, row_number() OVER (PARTITION BY n, day ORDER BY event_id) - 1 AS lg FROM e),
oplog AS (SELECT 'node' || lpad(CAST(n AS VARCHAR), 2, '0') AS src_node, src_seq, printf('%016x', day) || '-' || printf('%04x', lg) AS hlc, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op_type,
  'col' || (lg % 3) AS col_id, 'rec' || lpad(CAST(lg % 40 AS VARCHAR), 5, '0') AS record_id, CASE WHEN event_type = 'error' THEN '' ELSE props END AS payload, ts + to_seconds((event_id * 7919) % 86400) AS created, event_id FROM numbered)"""
HOLES = LOG + ",\nholes AS (SELECT * FROM oplog WHERE NOT (src_seq > 20 AND event_id % 97 = 0))"
SCHEMA_LOG = (
    LOG
    + """,
slog AS (SELECT src_node, src_seq, hlc, CASE WHEN event_id % 211 = 3 THEN 'col_upsert' ELSE op_type END AS op_type, col_id, CASE WHEN event_id % 211 = 3 THEN col_id ELSE record_id END AS record_id,
  CASE WHEN event_id % 211 = 3 THEN '{"name":"' || col_id || '","version":' || (event_id % 4) || '}' ELSE payload END AS payload, created, event_id FROM oplog)"""
)
LATEST = "row_number() OVER (PARTITION BY col_id, record_id ORDER BY hlc DESC, src_node DESC)"


def query(name: str, oracle: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put
