"""Sizes of files: buckets, largest files, exact duplicates, prunes and checks of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def buckets(files: DataFrame, by: Column, size: str = "size") -> DataFrame:
    """``bucket``, ``files`` and ``bytes``."""
    return files.groupBy(by.alias("bucket")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def largest(files: DataFrame, n: int, size: str, *ties: str) -> DataFrame:
    """The ``n`` largest rows; a report, so the limit is the feature."""
    return files.orderBy(F.desc(size), *ties).limit(n)


def total(files: DataFrame, name: str, size: str = "size") -> DataFrame:
    """One row: ``files``, ``bytes``, and the name and size of the largest file (of equal ones the first name)."""
    best = F.min(F.when(F.col(size).isNotNull(), F.struct((-F.col(size)).alias("s"), F.col(name).alias("n"))))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), best["n"].alias("largest_name"), (-best["s"]).alias("largest_bytes"))


def duplicate_groups(files: DataFrame, content: Column, size: str, least: int = 32 * 1024) -> DataFrame:
    """Groups of rows of at least ``least`` bytes with equal content: ``digest``, ``copies``, ``size`` and the ``redundant`` bytes of all
    copies but one. Small rows are never hashed, and only digests are shuffled, counted on the map side first."""
    hashed = files.where(F.col(size) >= least).select(F.sha2(content, 256).alias("digest"), F.col(size).alias("size"))
    return hashed.groupBy("digest", "size").agg(F.count("*").alias("copies")).where("copies > 1").withColumn("redundant", F.col("size") * (F.col("copies") - 1))


def pruned(files: DataFrame, doomed: Column, size: str = "size") -> DataFrame:
    """One row: ``removed_files`` and ``removed_bytes`` of a prune, which itself is ``files.where(doomed)``."""
    return files.where(doomed).agg(F.count("*").alias("removed_files"), F.coalesce(F.sum(size), F.lit(0)).alias("removed_bytes"))


def shared_paths(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """Rows of ``left`` whose path is in ``right`` too."""
    return left.join(right.select(path).distinct(), path, "left_semi")


def copy_check(files: DataFrame, folder: str, name: str, digest: str, canonical: str, alias: str) -> DataFrame:
    """For each folder with a file ``alias``: whether the ``canonical`` file stands beside it and is the same. One aggregation, no self join."""
    pick = lambda n: F.max(F.when(F.col(name) == n, F.col(digest)))
    both = files.where(F.col(name).isin(canonical, alias)).groupBy(folder).agg(pick(canonical).alias("own"), pick(alias).alias("copy"))
    return both.where("copy IS NOT NULL").select(folder, F.coalesce(F.col("own") == F.col("copy"), F.lit(False)).alias("same"))
