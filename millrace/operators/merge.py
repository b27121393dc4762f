"""Merging ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def round_robin(lists: DataFrame, query: list[str], list_no: str, position: str, key: str, most: int) -> DataFrame:
    """The lists of each query interleaved: all first entries in the order of the lists, then all second ones and so on; of entries
    with one key the first stays, and only then the first ``most`` are taken. Adds ``merged_rank`` from 1."""
    where = F.row_number().over(Window.partitionBy(*query, list_no).orderBy(position))
    turn = lists.withColumn("_turn", where)
    first = turn.groupBy(*query, key).agg(F.min_by(F.struct(*[F.col(c) for c in turn.columns if c not in (*query, key)]), F.struct("_turn", list_no)).alias("_row"))
    kept = first.select(*query, key, "_row.*")
    rank = F.row_number().over(Window.partitionBy(*query).orderBy("_turn", list_no))
    return kept.withColumn("merged_rank", rank).where(F.col("merged_rank") <= most).drop("_turn")
