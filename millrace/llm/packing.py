"""Filling containers of fixed capacity with items of varying length.

Items are spread over partitions of bounded size, and each partition packs its own by best fit decreasing. Dual feasible
functions give a lower bound of the containers a partition can do with. A partition that meets its bound is certified and keeps
all containers but its emptiest one; one with a gap gives the items of its emptiest containers away, several for each
container of the gap. What partitions give away is exchanged over fewer partitions and packed again, until one partition holds
the rest, or a round gives away hardly less than the one before: then its partitions keep all they have. The bound of all
items, from the counts of their lengths, certifies the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import write_shared

#: Code points of a container; items of one partition; the part of the items that a round may give away for another to follow; containers
#: given away for each of the gap.
CAPACITY, ITEMS, SHRINK, GIVEN = 6_000, 50_000, 0.75, 4
#: Partitions of items that one task packs at most, where there are more than shuffle partitions (40 bytes an item in memory).
GROUPS = 20
#: Copies of one row that are numbered at a time.
COPIES = 10_000
_SCHEMA = "item_id bigint, copy bigint, part_no int, size int, container_id bigint"


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Containers that items of these sizes need at least: the best of the bounds of three families of dual feasible functions
    (the sizes as they are; small ones dropped and large ones rounded up; sizes rounded down to parts of the capacity)."""
    if not len(sizes):
        return 0
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    order = np.argsort(sizes)
    sizes, counts = sizes[order], counts[order]
    many, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sizes * counts)])
    for least in np.unique(sizes[sizes * 2 <= capacity]):
        low, high = np.searchsorted(sizes, least), np.searchsorted(sizes, capacity - least, side="right")
        best = max(best, int(many[-1] - many[high]) - (-int(total[high] - total[low]) // capacity))
    for k in range(1, 21):
        share = (k + 1) * sizes
        exact = share % capacity == 0
        # values in parts of 1 / (k * capacity), so that all is whole numbers
        value = np.where(exact, sizes * k, share // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item, and what each container has left. Of the containers an item fits in, it goes to one with the
    least room; equal items keep their order."""
    where = np.zeros(len(sizes), np.int64)
    left: list[int] = []
    rooms: dict[int, list[int]] = {}
    held = 0  # bit r: some container has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = held >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            box = rooms[room].pop()
            if not rooms[room]:
                held &= ~(1 << room)
        else:
            room, box = capacity, len(left)
            left.append(capacity)
        where[i] = box
        left[box] = rest = room - size
        if rest:
            if not rooms.setdefault(rest, []):
                held |= 1 << rest
            rooms[rest].append(box)
    return where, np.array(left, np.int64)


def _round(number: int, last: bool, capacity: int):
    """Packs the partitions of a task; rows (item, copy, part, size, partition) to rows with a container, or null if given away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        items, copies, parts, sizes, owner = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in rows]) for i in range(5))
        order = np.lexsort((parts, copies, items, -sizes, owner))
        items, copies, parts, sizes, owner = items[order], copies[order], parts[order], sizes[order], owner[order]
        edges = [0, *(np.flatnonzero(np.diff(owner)) + 1), len(owner)]
        for start, end in zip(edges, edges[1:], strict=False):
            own = sizes[start:end]
            where, left = best_fit_decreasing(own, capacity)
            given = np.zeros(len(left), bool)
            if not last:
                gap = len(left) - lower_bound(*np.unique(own, return_counts=True), capacity)
                given[np.argsort(-left, kind="stable")[: GIVEN * gap + 1]] = True
                given &= left > 0
            ids = (number << 56) | (int(owner[start]) << 24) | where
            yield pa.RecordBatch.from_arrays(
                [pa.array(items[start:end]), pa.array(copies[start:end]), pa.array(parts[start:end], pa.int32()), pa.array(own, pa.int32()), pa.array(ids, mask=given[where])],
                names=["item_id", "copy", "part_no", "size", "container_id"],
            )

    return run


def pack(df: DataFrame, key: Column, length: Column, capacity: int = CAPACITY, items: int = ITEMS) -> DataFrame:
    """``item_id``, ``part_no``, ``size`` and ``container_id`` of each item, or part of one.

    Only an item longer than the capacity is divided: into full containers and a rest. Items of null or no length need no room:
    they come out once, with size 0 and no container. Equal items and repeated rows are items of their own; an empty table gives no rows.
    The same table gives the same containers, whatever the partitions it is read in."""
    if not 1 <= capacity < 1 << 24:
        raise ValueError("the capacity must be at least 1 and less than 2^24")
    sized = df.select(key.cast("bigint").alias("item_id"), F.greatest(F.coalesce(length.cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    # copies of a row are counted before the shuffle and numbered after it, so that they too spread over all partitions
    copies = sized.groupBy("item_id", "n").agg(F.count("*").alias("m")).select("item_id", "n", "m", F.explode(F.expr(f"sequence(0, (m - 1) div {COPIES})")).alias("block"))
    copies = copies.select("item_id", "n", F.explode(F.expr(f"sequence(block * {COPIES}, least((block + 1) * {COPIES}, m) - 1)")).alias("copy"))
    parts = copies.select("item_id", "n", "copy", F.explode(F.expr(f"sequence(0, greatest(n - 1, 0) div {capacity})")).alias("no"))
    todo = write_shared(parts.select("item_id", "copy", F.col("no").cast("int").alias("part_no"), F.least(F.lit(capacity), F.expr(f"n - no * {capacity}")).cast("int").alias("size")), "items")
    done = todo.where("size = 0").select("item_id", "part_no", "size", F.lit(None).cast("bigint").alias("container_id"))
    todo = todo.where("size > 0")
    number, before = 0, None
    while left := todo.count():
        number += 1
        groups = -(-left // items)
        last = groups == 1 or (before is not None and left > SHRINK * before)
        before = left
        owned = todo.withColumn("owner", F.pmod(F.xxhash64("item_id", "copy", "part_no", F.lit(number)), F.lit(groups)))
        tasks = min(groups, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS)))
        packed = owned.repartition(tasks, "owner").mapInArrow(_round(number, last, capacity), _SCHEMA)
        packed = write_shared(packed, f"packed{number}")
        done = done.unionAll(packed.where("container_id IS NOT NULL").drop("copy"))
        if last:
            break
        todo = packed.where("container_id IS NULL").drop("container_id")
    return done


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``containers`` used, the ``bound`` that no packing of these items can go below, ``filled`` (share of the room used)
    and ``n_items``. The bound needs only how often each length occurs, at most ``capacity`` numbers."""
    counts = {r["size"]: r["n"] for r in packed.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    bound = lower_bound(np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64), capacity)
    return packed.where("size > 0").agg(
        F.count_distinct("container_id").alias("containers"), F.lit(bound).cast("bigint").alias("bound"), F.round(F.sum("size") / (F.count_distinct("container_id") * capacity), 6).alias("filled"), F.count("*").alias("n_items")
    )


def _blocks(spark, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/doc_pages.parquet")
    return pages.select(F.explode("structured_data.contents").alias("b")).select(F.col("b.content_id").alias("content_id"), F.length("b.content").alias("n"))


def p4_containers(spark, folder: str) -> DataFrame:
    """The container of each block of the pages."""
    return pack(_blocks(spark, folder), F.col("content_id"), F.col("n")).withColumnRenamed("item_id", "content_id")


def p4_certificate(spark, folder: str) -> DataFrame:
    """How many containers the blocks of the pages got, beside the lower bound."""
    return certificate(pack(_blocks(spark, folder), F.col("content_id"), F.col("n")))


def p4_packed(spark, folder: str) -> DataFrame:
    """Of each block of the pages the ``parts``, their ``size`` in all, and whether each is in a container that isn't over full."""
    packed = p4_containers(spark, folder)
    full = packed.where("container_id IS NOT NULL").groupBy("container_id").agg((F.sum("size") <= CAPACITY).alias("fits"))
    own = packed.join(full, "container_id", "left").groupBy("content_id")
    return own.agg(F.count("*").alias("parts"), F.sum("size").cast("bigint").alias("size"), F.bool_and(F.coalesce("fits", F.col("size") == 0)).alias("kept"))


QUERIES = {"p4_containers": p4_containers, "p4_certificate": p4_certificate, "p4_packed": p4_packed}
SQL = {
    "p4_packed": f"""WITH b AS (SELECT c.content_id AS content_id, coalesce(length(c.content), 0) AS n FROM (SELECT unnest(structured_data.contents) AS c FROM doc_pages))
SELECT content_id, greatest(1, (n + {CAPACITY - 1}) // {CAPACITY})::BIGINT AS parts, n::BIGINT AS size, true AS kept FROM b"""
}
