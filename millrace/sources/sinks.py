"""Writing files and tables so that a repeated or broken attempt leaves nothing half done."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(files: DataFrame, folder: str, name: str = "file_name", content: str = "content") -> DataFrame:
    """Each row as a file below a folder that all executors mount: ``name``, ``size``, and ``written``, which is False where the same content
    was there already. A file appears whole or not at all, so tasks may be repeated. Names must stay within the folder.

    The result is lazy; collect or count it to write."""
    root = Path(folder.removeprefix("file://"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, new = batch.column(0).to_pylist(), [], []
            for own, value in zip(names, batch.column(1).to_pylist(), strict=True):
                raw = value if isinstance(value, bytes) else (value or "").encode()
                target = (root / own).resolve()
                if not target.is_relative_to(root.resolve()):
                    raise ValueError(f"{own} is outside of the folder")
                same = target.exists() and target.stat().st_size == len(raw) and hashlib.sha256(target.read_bytes()).digest() == hashlib.sha256(raw).digest()
                if not same:
                    target.parent.mkdir(parents=True, exist_ok=True)
                    handle, made = tempfile.mkstemp(dir=target.parent)
                    with os.fdopen(handle, "wb") as out:
                        out.write(raw)
                    os.replace(made, target)
                sizes.append(len(raw))
                new.append(not same)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(new)], names=["name", "size", "written"])

    return files.select(F.col(name), F.col(content)).mapInArrow(write, "name string, size bigint, written boolean")


def content_digest(table: DataFrame) -> str:
    """A digest of a table's rows as a multiset: the sums of two hashes of its rows, and their number. Independent of order and partitions."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(table.columns)])
    text = F.to_json(row, {"ignoreNullFields": "false"})
    a, b = (F.conv(F.substring(F.sha2(F.concat(F.lit(salt), text), 256), 1, 15), 16, 10).cast("decimal(38,0)") for salt in ("a", "b"))
    r = table.agg(F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b")).first()
    return hashlib.sha256(f"{sorted(table.dtypes)}|{r.n}|{r.a}|{r.b}".encode()).hexdigest()


def commit(table: DataFrame, folder: str) -> tuple[str, bool]:
    """Writes a table as a new version below ``folder`` and moves the pointer file CURRENT to it at the end: readers see the old version or the
    new one. If the rows equal the current version's nothing is written. Returns (path of the version, whether it is new)."""
    spark = table.sparkSession
    digest = content_digest(table)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    root = path(folder)
    fs = root.getFileSystem(conf)
    version, pointer = f"{folder}/v-{digest[:16]}", path(f"{folder}/CURRENT")
    if current(spark, folder) == version:
        return version, False
    if not fs.exists(path(f"{version}/_SUCCESS")):
        table.write.mode("overwrite").parquet(version)
    made = path(f"{folder}/.CURRENT-{digest[:16]}")
    out = fs.create(made, True)
    out.write(bytearray(version.encode()))
    out.close()
    fs.delete(pointer, False)
    fs.rename(made, pointer)
    return version, True


def exists(spark, path: str) -> bool:
    """Whether there is a file or folder of this path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def current(spark, folder: str) -> str | None:
    """The path of the committed version, None before the first commit."""
    if not exists(spark, f"{folder}/CURRENT"):
        return None
    return spark.read.format("text").option("wholetext", True).load(f"{folder}/CURRENT").first()[0].strip()


def rewrites(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """What an in-place rewrite would change, as a dry run: key, the old and the new text of rows that differ."""
    return before.select(key, F.col(text).alias("old")).join(after.select(key, F.col(text).alias("new")), key).where(~F.col("old").eqNullSafe(F.col("new")))


def deletions(files: DataFrame, path: str, keep: DataFrame) -> DataFrame:
    """Files to delete so that only those in ``keep`` stay: a plan, nothing is deleted."""
    return files.join(keep.select(path).distinct(), path, "left_anti").select(path)
