"""One copy of each message that was delivered at least once.

Deliveries are written once, as storage partitioned by time bucket. Each task that reads them puts the identifiers of a bucket
together as a part of that bucket's filter: 4-byte prints, sorted, so that a print costs less than its 4 bytes to move. Shard by
shard of the prints the parts are joined, bucket after bucket in order of time, into one Bloom filter a bucket, which says which
identifiers are certainly new. The prints of the others come back, and only deliveries with one of them leave the storage of
their bucket, for the exact comparison. A definitely new delivery is never moved.

A hot identifier (one message delivered again and again) is one print of a part however often a task reads it; its deliveries
are joined, not gathered, and the join may split them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.bloom import GrowingBloom
from millrace.sources.shared import write_shared

#: Blanks around an id, also those that Java's \s leaves out.
_EDGES = r"^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$"
BUCKET_DAYS = 32
#: Identifiers of a shard where there are few, and at most (2 bytes each in memory); those a task holds before it gives a part; and the
#: possible repeats that are broadcast at most, beyond which they are joined by a shuffle.
FEW_IDS, SHARD_IDS, PART_IDS, BROADCAST_IDS = 250_000, 20_000_000, 1_000_000, 200_000


def proper(text: Column) -> Column:
    """An id without blanks around it, in lower case."""
    return F.lower(F.regexp_replace(text, _EDGES, ""))


def event_key(event_id: Column, owner: Column, task: Column, checksum: Column) -> Column:
    """The 64-digit id of a message: the delivered one in its proper form where it has 64 hex digits, else the SHA-256 of owner,
    task and checksum with zero characters between. Null where neither can be had."""
    given = proper(event_id)
    zero = F.lit("\u0000")
    made = F.sha2(F.encode(F.concat(proper(owner), zero, proper(task), zero, proper(checksum)), "UTF-8"), 256)
    return F.when(given.rlike("^[0-9a-f]{64}$"), given).otherwise(made)


def _parts(shards: int):
    """Rows (bucket, hash) of a task -> (shard, bucket, prints, again): the different prints of a part, and those it has more than once, both
    sorted and as differences."""

    def flush(buckets: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        bucket, value = np.concatenate(buckets), np.concatenate(hashes)
        shard, own = np.mod(value, shards).astype(np.int32), (value.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((own, bucket, shard))
        shard, bucket, own = shard[order], bucket[order], own[order]
        new = (np.diff(shard, prepend=-1) != 0) | (np.diff(bucket.astype(np.int64), prepend=1 << 40) != 0)
        edges = [*np.flatnonzero(new), len(own)]
        prints, again = [], []
        for start, end in zip(edges, edges[1:], strict=False):
            ids, n = np.unique(own[start:end], return_counts=True)
            prints.append(np.diff(ids, prepend=np.uint32(0)).tobytes())
            again.append(np.diff(ids[n > 1], prepend=np.uint32(0)).tobytes())
        first = edges[:-1]
        return pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array(bucket[first]), pa.array(prints, pa.binary()), pa.array(again, pa.binary())], names=["_shard", "_bucket", "prints", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            buckets.append(batch.column(0).to_numpy(zero_copy_only=False))
            hashes.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= PART_IDS:
                yield flush(buckets, hashes)
                buckets, hashes, held = [], [], 0
        if held:
            yield flush(buckets, hashes)

    return run


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order of shard and bucket -> (bucket, shard, print) of the possible repeats, in each bucket that may have them."""
    blooms: dict[int, GrowingBloom] = {}
    at = None
    for batch in batches:
        for shard, now, prints, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != at:
                at, blooms = shard, {}
            ids, twice = (np.cumsum(np.frombuffer(p, np.uint32), dtype=np.uint32).astype(np.uint64) for p in (prints, again))
            spread = ids * np.uint64(0x9E3779B97F4A7C15)  # the filter wants hashes of 64 bits
            found = {now: [twice]}
            for bucket, bloom in blooms.items():
                hit = ids[bloom.may_contain(spread)]
                if len(hit):
                    found.setdefault(bucket, []).append(hit)
                    found[now].append(hit)
            blooms.setdefault(now, GrowingBloom()).add(spread)
            for bucket, parts in found.items():
                own = np.unique(np.concatenate(parts)).view(np.int64)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), bucket, np.int32)), pa.array(np.full(len(own), shard, np.int32)), pa.array(own)], names=["_bucket", "_shard", "_print"])


class Deliveries:
    """Deliveries in bucketed storage, screened for repeats.

    ``key`` is the message's identity (any string; null: the row is a message of its own), ``received`` the timestamp that
    orders deliveries and gives the time bucket (null: a bucket of its own, ordered first), ``payload`` the columns to keep.
    Payload columns may have any name that does not begin with an underscore. An empty table gives empty results. Repeated
    rows are deliveries like any other.
    """

    def __init__(self, df: DataFrame, key: Column, received: Column, payload: list[str], bucket_days: int = BUCKET_DAYS, shards: int | None = None):
        bucket = F.coalesce(F.floor(F.unix_seconds(received.cast("timestamp")) / (86400 * bucket_days)).cast("int"), F.lit(-(1 << 30)))
        rows = df.select(key.alias("_key"), received.alias("_received"), bucket.alias("_bucket"), *[F.col(f"`{c}`") for c in payload])
        rows = rows.withColumn("_hash", F.xxhash64("_key"))
        #: Written without a shuffle: a task writes the buckets its input split holds.
        self.storage = write_shared(rows, "deliveries", ("_bucket",))
        self.payload = payload
        known = self.storage.where("_key IS NOT NULL")
        n = self.storage.count()
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = shards or max(1, min(tasks, -(-n // FEW_IDS)), -(-n // SHARD_IDS))
        parts = known.select("_bucket", "_hash").mapInArrow(_parts(shards), "_shard int, _bucket int, prints binary, again binary")
        sorted_parts = parts.repartition(shards, "_shard").sortWithinPartitions("_shard", "_bucket")
        found = write_shared(sorted_parts.mapInArrow(_screen, "_bucket int, _shard int, _print bigint"), "candidates").distinct()
        few = found.count() <= BROADCAST_IDS
        self.candidates = F.broadcast(found) if few else found
        self._place = {"_shard": F.pmod("_hash", F.lit(shards)).cast("int"), "_print": F.shiftrightunsigned("_hash", 32)}
        buckets = [r[0] for r in found.select("_bucket").distinct().collect()]  # as many as there are time buckets
        #: The deliveries of the matching buckets that may be repeats; every repeated message is here with all deliveries.
        self.possible = write_shared(known.where(F.col("_bucket").isin(buckets)).withColumns(self._place).join(self.candidates, ["_bucket", "_shard", "_print"], "left_semi"), "possible")

    def repeated(self) -> DataFrame:
        """``_key`` and the payload of every delivery, the first included, of each message delivered more than once."""
        keys = self.possible.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key")
        return self.possible.join(keys, "_key", "left_semi").select("_key", *[F.col(f"`{c}`") for c in self.payload])

    def once(self, tie: list[str]) -> DataFrame:
        """``_key`` and the payload of exactly one delivery of each message: the first received, at equal times the smallest by
        ``tie``. Rows without identity all stay."""
        own = [F.col(f"`{c}`") for c in self.payload]
        single = self.storage.where("_key IS NOT NULL").withColumns(self._place).join(self.candidates, ["_bucket", "_shard", "_print"], "left_anti").select("_key", *own)
        first = self.possible.groupBy("_key").agg(F.min_by(F.struct(*own), F.struct("_received", *[F.col(f"`{c}`") for c in tie])).alias("_row"))
        none = self.storage.where("_key IS NULL").select("_key", *own)
        return single.unionAll(first.select("_key", *[F.col("_row").getField(c).alias(c) for c in self.payload])).unionAll(none)
