"""Keyed tables: latest rows, upsert plans, batches, positional pairing, set operations with order, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import write_shared


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``. An aggregation that combines before the shuffle, so a hot key moves one row a task."""
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(*key).agg(F.max_by(own, F.struct(*order)).alias("_row")).select("_row.*")


def next_version(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """``next_version`` of each key: one above its highest, at least 1."""
    return rows.groupBy(*key).agg((F.greatest(F.coalesce(F.max(version), F.lit(0)), F.lit(0)) + 1).alias("next_version"))


def upsert_plan(planned: DataFrame, existing: DataFrame, key: list[str], existing_id: str) -> DataFrame:
    """``planned`` with ``action`` (update where the key exists, else insert) and the ``target_id`` of what is updated; of several existing
    rows of a key the smallest id."""
    known = existing.groupBy(*key).agg(F.min(existing_id).alias("target_id"))
    return planned.join(known, key, "left").withColumn("action", F.when(F.col("target_id").isNotNull(), "update").otherwise("insert"))


def merged(existing: DataFrame, changes: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``existing`` after an upsert of ``changes``: of each key the last change if there is one, else what was there."""
    last = latest(changes, key, order)
    return existing.join(last.select(*key), key, "left_anti").select(*existing.columns).unionByName(last.select(*existing.columns))


def swapped(rows: DataFrame, state: str, expected: str, new: str) -> DataFrame:
    """Compare and set: the new state where the expected one stands, with ``swapped`` telling where."""
    holds = F.coalesce(F.col(state) == expected, F.lit(False))
    return rows.withColumn("swapped", holds).withColumn(state, F.when(holds, F.lit(new)).otherwise(F.col(state)))


def numbered(rows: DataFrame, order: list[str], name: str = "no") -> DataFrame:
    """``rows`` with consecutive numbers from 0 in a global order, without bringing all rows to one task: rows are range-partitioned by
    the order, counted by partition, and numbered from each partition's offset. The order must be total for a stable result."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = write_shared(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row a partition
    offset = 0
    table = []
    for part, n in counts:
        table.append((part, offset))
        offset += n
    starts = spark.createDataFrame(table or [(0, 0)], "_part int, _start bigint")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + within - 1).drop("_part", "_start")


def batched(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``batch`` from 0: consecutive rows of the order, ``size`` a batch."""
    return numbered(rows, order, "_no").withColumn("batch", F.expr(f"_no div {size}")).drop("_no")


def zipped(left: Column, right: Column) -> Column:
    """Arrays paired by position; an error where their lengths differ, as a lost answer must not shift the others."""
    checked = F.when(F.size(left) == F.size(right), F.arrays_zip(left.alias("left"), right.alias("right")))
    return F.coalesce(checked, F.when(left.isNull() | right.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("arrays of different length can't be paired"))))


def range_join(points: DataFrame, position: str, ranges: DataFrame, start: str, end: str, cell: int = 1024) -> DataFrame:
    """Points with the ranges they lie in (start inclusive, end exclusive): an equi-join on cells of positions, the ends checked after.
    Long ranges cover more cells; no side is broadcast and no pair outside a cell is made."""
    cells = ranges.withColumn("_cell", F.explode(F.expr(f"CASE WHEN {end} > {start} THEN sequence(CAST(floor({start} / {cell}) AS BIGINT), CAST(floor(({end} - 1) / {cell}) AS BIGINT)) END")))
    keyed = points.withColumn("_cell", F.floor(F.col(position) / cell).cast("bigint"))
    return keyed.join(cells, "_cell").where(f"{position} >= {start} AND {position} < {end}").drop("_cell")


def orphans(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows that are no member of anything."""
    return rows.join(members.select(key).distinct(), key, "left_anti")


def memberships(rows: DataFrame, members: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows without exactly one owner, with ``owners`` (how many) and ``owner_names`` (sorted, joined)."""
    own = members.select(key, owner).distinct().groupBy(key).agg(F.count("*").alias("owners"), F.array_join(F.array_sort(F.collect_list(owner)), ", ").alias("owner_names"))
    return rows.join(own, key, "left").withColumn("owners", F.coalesce("owners", F.lit(0))).where("owners != 1").withColumn("owner_names", F.coalesce("owner_names", F.lit("(none)")))


def required(left: DataFrame, right: DataFrame, key: list[str], what: str) -> DataFrame:
    """An inner join in which every left row must have a partner: one without is an error."""
    found = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    return found.where(F.coalesce("_found", F.raise_error(F.lit(f"{what} is missing")).cast("boolean"))).drop("_found")


def unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: ``n`` rows, ``n_keys`` distinct keys and whether they are as many (``is_unique``)."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    return counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count("*").alias("n_keys")).withColumn("is_unique", F.col("n") == F.col("n_keys"))


def only_candidate(rows: DataFrame, recent: Column, id_column: str) -> DataFrame:
    """The id of the one recent row, if there is exactly one; no row if there is none or several."""
    return rows.where(recent).agg(F.count("*").alias("n"), F.min(id_column).alias(id_column)).where("n = 1").select(id_column)


def looked_up(rows: DataFrame, values: DataFrame, key: list[str], value: str) -> DataFrame:
    """``rows`` with the value of their key; those without one are left out."""
    return rows.join(values.select(*key, value), key, "left").where(F.col(value).isNotNull())


def with_default(rows: DataFrame, values: DataFrame, key: list[str], value: str, default: Column) -> DataFrame:
    """All ``rows`` with the value of their key, the default where there is none."""
    return rows.join(values.select(*key, value), key, "left").withColumn(value, F.coalesce(F.col(value), default))
