"""Queries that run a stream over the delivered messages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.exactly_once import event_key
from millrace.plans.messages import _IDENTIFIED
from millrace.sources.shared import remove_at_exit, shared_dir
from millrace.sources.tables import table
from millrace.streaming import messages


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return messages.file_stream(spark, path, table(spark, folder, name).schema, 100)


def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct messages, by a stream over the deliveries: all of them, however late they or their repeats come."""
    key = event_key(*(F.col(c) for c in ("event_id", "owner_id", "task_record_id", "checksum")))
    own = messages.once_ever(_stream(spark, folder, "task_enrich_events"), key).select(F.col("_key").alias("event_id"))
    name = f"once-{uuid.uuid4().hex}"
    remove_at_exit(spark, f"{shared_dir(spark)}/stream-{name}")
    return messages.run_to_table(own, name)


def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last job of each task, kept by a stream of jobs."""
    name = f"latest-{uuid.uuid4().hex}"
    for part in ("stream-", ""):
        remove_at_exit(spark, f"{shared_dir(spark)}/{part}{name}")
    rows = _stream(spark, folder, "publish_jobs").select("task", "version", "id", "status", "updated")
    return messages.run_latest(rows, f"{shared_dir(spark)}/{name}", ["task"], [F.col("version"), F.col("updated"), F.col("id")], name)


QUERIES = {"stream_once": stream_once, "stream_latest": stream_latest}
SQL = {
    "stream_once": _IDENTIFIED + "SELECT DISTINCT event_id FROM identified",
    "stream_latest": "SELECT task, version, id, status, updated FROM publish_jobs QUALIFY row_number() OVER (PARTITION BY task ORDER BY version DESC NULLS LAST, updated DESC NULLS LAST, id DESC NULLS LAST) = 1",
}
