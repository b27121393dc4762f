"""Streams of messages: one copy of each, the latest row of each key, and versions by arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.relational import latest
from millrace.sources.shared import shared_dir
from millrace.sources.sinks import commit, current, exists


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream, a few at a time; ``path`` is a folder or one file (a file source takes a single file only as a pattern)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def once(stream: DataFrame, key: Column, event_time: str, delay: str) -> DataFrame:
    """The first delivery of each message to arrive. Repeats are known for ``delay`` behind the newest event time, so state is bounded by the
    messages of that span; a repeat later than that is the batch operator's to find. A row that comes when its event time is more than ``delay``
    behind is dropped, be it new or not."""
    return stream.withColumn("_key", key).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"])


def once_ever(stream: DataFrame, key: Column) -> DataFrame:
    """The first delivery of each message to arrive, with no bound on lateness: no row is dropped and every repeat is known. State is one key a
    message, so it is for runs over what is there, not for streams without end."""
    return stream.withColumn("_key", key).dropDuplicates(["_key"])


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote: a file sink with a checkpoint, so exactly once also when it is
    started again."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_latest(stream: DataFrame, folder: str, key: list[str], order: list[Column], name: str) -> DataFrame:
    """The last row of each key of a stream, run over all that is there. Each micro-batch adds its own last rows as a part of its number below
    ``folder``, so its cost is that of the batch, and a repeated one overwrites its part; the last of all parts is taken when read.
    ``compact`` makes one table of many parts."""
    spark = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{shared_dir(spark)}/stream-{name}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_latest(spark, folder, stream.schema, key, order)


def read_latest(spark: SparkSession, folder: str, schema, key: list[str], order: list[Column]) -> DataFrame:
    """The last rows below ``folder``: of the compacted table, if there is one, and the parts."""
    rows = spark.createDataFrame([], schema)
    if base := current(spark, f"{folder}/base"):
        rows = rows.unionByName(spark.read.schema(schema).parquet(base))
    if exists(spark, f"{folder}/parts"):
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{folder}/parts").select(*rows.columns))
    return latest(rows, key, order)


def compact(spark: SparkSession, folder: str, schema, key: list[str], order: list[Column]) -> None:
    """Commits the last rows of all parts as the base table; parts stay valid beside it, so they may be deleted at any time after."""
    commit(read_latest(spark, folder, schema, key, order), f"{folder}/base")


def versions(stream: DataFrame, key: str, checksum: str, order: str) -> DataFrame:
    """``key``, ``checksum`` and ``version`` (from 1) of each content that is new for its key: a row with the checksum of the version before is skipped.
    Rows of a micro-batch are taken by ``order``, which bounds what is sorted at once; state is one number and one checksum a key."""
    schema = f"{key} string, {checksum} string, version int"

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, last = state.get if state.exists else (0, "")
        rows = []
        for value in pd.concat(list(batches)).sort_values([order, checksum], kind="stable")[checksum]:
            if value is not None and value != last:
                number, last = number + 1, value
                rows.append((own[0], value, number))
        state.update((number, last))
        yield pd.DataFrame(rows, columns=[key, checksum, "version"])

    return stream.select(key, checksum, order).groupBy(key).applyInPandasWithState(step, schema, "version int, checksum string", "append", GroupStateTimeout.NoTimeout)
