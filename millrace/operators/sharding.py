"""Stable shards of bounded size.

Units of an owner are parted by digits of their key's hash, level by level, until a part is within the target or has one unit.
All twelve digits of a unit are one expression; the sizes of all parts of all levels come from one aggregation, and each unit
takes the first level that fits. A unit stays where it is when others come and go, unless its own part over- or underflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import fnv32, fnv_quarters
from millrace.operators.records import part_starts
from millrace.operators.relational import numbered
from millrace.sources.shared import write_shared

#: Code points of a shard of core and of body records; levels of hashing.
CORE_CHARS, BODY_CHARS, LEVELS = 300_000, 650_000, 12
#: Bytes of a written shard: split beyond, warn from, refuse from.
SOFT, WARN, HARD = 10_000_000, 15_000_000, 25_000_000


def stable_shards(units: DataFrame, target: int) -> DataFrame:
    """``owner``, ``key``, ``chars`` and ``shard_key`` of each unit. Keys must be unique in an owner. What the hash
    levels leave together is ``halved``."""
    digits = F.concat(*[q.cast("string") for q in fnv_quarters(F.col("key"), [f"{d}:" for d in range(LEVELS)])])
    levels = units.select("owner", "key", "chars", digits.alias("digits")).select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")).withColumn("prefix", F.expr("substring(digits, 1, level)"))
    parts = levels.groupBy("owner", "prefix").agg(F.sum("chars").alias("total"), F.count("*").alias("n"))
    paths = levels.join(parts, ["owner", "prefix"]).groupBy("owner", "key", "chars", "digits").agg(F.array_sort(F.collect_list(F.struct("level", "total", "n"))).alias("path"))
    fits = F.array_position(F.transform("path", lambda p: (p["total"] <= target) | (p["n"] <= 1)), True).cast("int")
    # a level that parts nothing is written x, so that the key shows where parting happened
    steps = F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), lambda i: F.when(F.element_at("path", i)["n"] == F.element_at("path", i + 1)["n"], "x").otherwise(F.substring("digits", i, F.lit(1))))
    label = lambda depth: F.array_join(F.slice(steps, 1, depth), "")
    placed = paths.select("owner", "key", "chars", fits.alias("fits"), F.when(fits == 1, F.lit("0")).when(fits > 1, label(fits - 1)).otherwise(label(F.lit(LEVELS))).alias("shard_key"))
    placed = write_shared(placed, "placed")
    done = placed.where("fits > 0").drop("fits")
    rest = placed.where("fits = 0").drop("fits")
    return done if rest.isEmpty() else done.unionByName(halved(rest, target))


def halved(units: DataFrame, target: int) -> DataFrame:
    """Units of one ``shard_key`` parted in halves by the order of their keys, a before b, until a part is within the target or has one unit.

    The low bits of the hash part a group only so far (keys that lead all four states alike stay together at every level), so these groups
    can be large: they are numbered without a window over them, and the sizes of all halves of all levels come from one aggregation."""
    group = ["owner", "shard_key"]
    numbered_units = write_shared(numbered(units, [*group, "key"], "_pos"), "halves")
    sizes = numbered_units.groupBy(*group).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"), F.sum("chars").alias("_total"))
    rows = numbered_units.join(sizes, group).withColumn("_rank", F.col("_pos") - F.col("_first"))
    out, extra = None, 3
    while True:
        depth = F.least(F.ceil(F.log2(F.greatest(F.col("_total") / target, F.lit(1.0)))) + extra, F.ceil(F.log2(F.col("_n").cast("double")))).cast("int")
        start = F.struct(F.lit(0).cast("bigint").alias("a"), F.col("_n").alias("b"), F.lit("").alias("name"), F.array(F.lit("")).alias("names"))

        def step(s: Column, _: Column) -> Column:
            middle = s["a"] + F.floor((s["b"] - s["a"] + 1) / 2).cast("bigint")
            left, single = F.col("_rank") < middle, s["b"] - s["a"] <= 1
            name = F.when(single, s["name"]).otherwise(F.concat(s["name"], F.when(left, "a").otherwise("b")))
            a, b = F.when(single | left, s["a"]).otherwise(middle), F.when(single | ~left, s["b"]).otherwise(middle)
            return F.struct(a.alias("a"), b.alias("b"), name.alias("name"), F.array_append(s["names"], name).alias("names"))

        names = F.aggregate(F.filter(F.sequence(F.lit(0), depth), lambda i: i > 0), start, step, lambda s: s["names"])
        levels = rows.select("*", F.posexplode(F.array_distinct(names)).alias("level", "half"))
        parts = levels.groupBy(*group, "half").agg(F.sum("chars").alias("total"), F.count("*").alias("n")).where((F.col("total") <= target) | (F.col("n") <= 1))
        first = levels.join(parts.select(*group, "half"), [*group, "half"]).groupBy(*group, "key", "chars", "_pos").agg(F.min_by("half", "level").alias("half"))
        found = write_shared(first.select("owner", "key", "chars", F.concat("shard_key", "half").alias("shard_key"), "_pos"), "halved")
        out = found.drop("_pos") if out is None else out.unionByName(found.drop("_pos"))
        rows = write_shared(rows.join(found.select("_pos"), "_pos", "left_anti"), "halves")
        if rows.isEmpty():
            return out
        extra *= 2  # parts of very unequal units: more levels for what is left


def record_parts(records: DataFrame, page: str, order: list[str], chars: str, target: int = BODY_CHARS) -> DataFrame:
    """Records of large pages in parts of at most ``target``, filled in order: adds ``part`` from 0. The sizes of a page's records come
    into one row (12 bytes each), not the records."""
    rows = records.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(chars).cast("bigint").alias("_n")))).alias("_rows"))
    starts = part_starts(F.transform("_rows", lambda r: r["_n"]), target, 0)
    parts = F.transform("_rows", lambda r, i: F.size(F.filter("_starts", lambda s: s <= i)) - 1)  # as many parts as the page is large
    numbered = rows.withColumn("_starts", starts).withColumn("_parts", parts).select(page, F.explode(F.arrays_zip("_rows", "_parts")).alias("z"))
    return records.join(numbered.select(page, *[F.col(f"z._rows.{c}").alias(c) for c in order], F.col("z._parts").alias("part")), [page, *order])


def split_oversized(records: DataFrame, shard: str, size: str, identity: Column, order: list[str], soft: int = SOFT) -> DataFrame:
    """Records with the shards that are over ``soft`` bytes parted in two by a bit of a hash of ``identity``, again and again; a shard of one
    record stays. ``shard`` gets a or b for each parting. Where the bit parts nothing, as with equal identities, the first half by ``order``,
    which must be total in a shard, is parted from the second, so each round makes smaller shards and none is left over."""
    out, depth = records, 0
    while True:
        totals = out.groupBy(shard).agg(F.sum(size).alias("_bytes"), F.count("*").alias("_n")).where((F.col("_bytes") > soft) & (F.col("_n") > 1)).select(shard, F.lit(True).alias("_over"))
        if totals.isEmpty():
            return out
        bit = F.shiftrightunsigned(fnv32(F.concat(F.lit(f"{depth}:"), identity)), depth % 32).bitwiseAND(F.lit(1))
        large = write_shared(out.join(totals, shard, "left_semi").withColumn("_bit", bit), "large")
        sides = large.groupBy(shard).agg((F.min("_bit") == F.max("_bit")).alias("_same"), F.count("*").alias("_n"))
        own = large.join(sides, shard)
        by_bit = own.where("NOT _same").withColumn("_second", F.col("_bit") == 1)
        by_half = own.where("_same").withColumn("_second", F.row_number().over(Window.partitionBy(shard).orderBy(*order)) > F.ceil(F.col("_n") / 2))
        parted = by_bit.unionByName(by_half).withColumn(shard, F.concat(F.col(shard), F.when(F.col("_second"), "b").otherwise("a"))).select(*out.columns)
        out = write_shared(out.join(totals, shard, "left_anti").select(*parted.columns).unionByName(parted), "split")
        depth += 1


def guarded(shards: DataFrame, size: str = "bytes") -> DataFrame:
    """Shards with a ``warn`` flag; one of HARD bytes or more is an error."""
    ok = F.when(F.col(size) >= HARD, F.raise_error(F.concat(F.lit("a shard has too many bytes: "), F.col(size).cast("string"))).cast("boolean")).otherwise(F.col(size) >= WARN)
    return shards.withColumn("warn", ok)
