"""Queries over deliveries of messages (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.exactly_once import Deliveries, event_key
from millrace.sources.tables import table


def _deliveries(spark: SparkSession, folder: str) -> Deliveries:
    rows = table(spark, folder, "task_enrich_events")
    key = event_key(*(F.col(c) for c in ("event_id", "owner_id", "task_record_id", "checksum")))
    return Deliveries(rows, key, F.col("received_at"), ["delivery_id"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivery of each message that was delivered more than once."""
    return _deliveries(spark, folder).repeated().select(F.col("_key").alias("event_id"), "delivery_id")


def p1_once(spark: SparkSession, folder: str) -> DataFrame:
    """One delivery of each message: the first received."""
    return _deliveries(spark, folder).once(["delivery_id"]).select(F.col("_key").alias("event_id"), "delivery_id")


_IDENTIFIED = r"""WITH given AS (
  SELECT delivery_id, received_at, lower(regexp_replace(event_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS g,
    sha256(lower(trim(owner_id)) || chr(0) || lower(regexp_replace(task_record_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) || chr(0) || checksum) AS made
  FROM task_enrich_events),
identified AS (SELECT delivery_id, received_at, CASE WHEN regexp_full_match(g, '[0-9a-f]{64}') THEN g ELSE made END AS event_id FROM given)
"""

QUERIES = {"p1_found": p1_found, "p1_once": p1_once}
SQL = {
    "p1_found": _IDENTIFIED + "SELECT event_id, delivery_id FROM identified WHERE event_id IN (SELECT event_id FROM identified GROUP BY event_id HAVING count(*) > 1)",
    "p1_once": _IDENTIFIED + "SELECT event_id, delivery_id FROM identified QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at, delivery_id) = 1",
}
