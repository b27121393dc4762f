"""Reading documents, JSON tables and file metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.checks import ensured
from millrace.functions.text import frontmatter_value, split_frontmatter

#: Bytes of a JSON body at most.
BODY_BYTES = 64 * 1024


def relative(path: Column, folder: str) -> Column:
    """A file's path below the folder, decoded."""
    root = folder.split("://")[-1].rstrip("/")
    return F.url_decode(F.regexp_replace(path, rf"^[a-z0-9]+:/*{root.lstrip('/')}/", ""))


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """``relative_path`` and ``content`` of each .md and .mdx file below the folder. A file is one row."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.where(F.lower("path").rlike(r"\.mdx?$")).select(relative(F.col("path"), folder).alias("relative_path"), "content")


def file_stats(spark: SparkSession, folder: str) -> DataFrame:
    """``relative_path``, ``size`` and ``modified`` of each file below the folder; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select(relative(F.col("path"), folder).alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_digests(spark: SparkSession, folder: str, least: int = 0) -> DataFrame:
    """``relative_path``, ``size`` and ``sha256`` of each file of at least ``least`` bytes; smaller files aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") >= least)
    return rows.select(relative(F.col("path"), folder).alias("relative_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def json_tables(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON array files in the given order, one under the other: their rows with ``file_no``."""
    parts = [spark.read.schema(schema).option("multiLine", True).json(p).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def manifest(spark: SparkSession, path: str, schema: str, version: int, mode: str) -> DataFrame:
    """A manifest file as one row; another version or mode, or no categories, is an error."""
    text = spark.read.format("text").option("wholetext", True).load(path)
    row = text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("m")).select("m.*")
    return ensured(row, (F.col("version") == version) & (F.col("mode") == mode) & F.col("categories").isNotNull(), "the manifest isn't of the expected kind")


def json_bodies(rows: DataFrame, body: str, schema: str, most: int = BODY_BYTES) -> DataFrame:
    """``rows`` with the parsed ``value`` of a BINARY body, null with a ``problem`` (too large, not UTF-8, not JSON) where it can't be read."""
    text = F.when(F.is_valid_utf8(F.col(body).cast("string")), F.col(body).cast("string"))
    value = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    small = F.octet_length(body) <= most
    parsed = rows.withColumn("value", F.when(small, value))
    problem = F.when(F.col(body).isNull(), "empty").when(~small, "too large").when(text.isNull(), "not UTF-8").when(F.try_parse_json(text).isNull(), "not JSON")
    return parsed.withColumn("problem", problem).withColumn("value", F.when(problem.isNull(), F.col("value")))


def encoded_json(content: Column, schema: str, default: str) -> Column:
    """JSON in base64, as file services answer; what is absent counts as ``default``."""
    return F.from_json(F.coalesce(F.unbase64(content).cast("string"), F.lit(default)), schema)


def lookup(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is wanted; however many are, in one join."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def listed(rows: DataFrame, condition: Column | None, order: list[Column], most: int, fields: list[str]) -> DataFrame:
    """A filtered, sorted and limited listing; filter and fields reach the source."""
    return (rows if condition is None else rows.where(condition)).orderBy(*order).limit(most).select(*fields)


def failures(events: DataFrame) -> DataFrame:
    """Failure events of two shapes as one: ``workflow``, ``node`` and ``message`` from the execution part or the trigger part."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])
    return events.select("*", pick("execution.workflow", "trigger.workflow").alias("workflow"), pick("execution.node", "trigger.node").alias("node"), pick("execution.message", "trigger.message").alias("message"))


def collection(files: DataFrame, extra: dict[str, str], rules: dict[str, Column]) -> DataFrame:
    """Documents with their front matter as columns: title, description and the ``extra`` keys cast to their types (null where they
    can't be), the body, and the names of broken ``rules`` as ``problems``."""
    head, body = split_frontmatter(F.col("content"))
    rows = files.select("relative_path", head.alias("_head"), body.alias("body"))
    rows = rows.select("relative_path", "body", *[frontmatter_value(F.col("_head"), k).alias(k) for k in ("title", "description")], *[frontmatter_value(F.col("_head"), k).try_cast(t).alias(k) for k, t in extra.items()])
    return rows.withColumn("problems", F.filter(F.array(*[F.when(~F.coalesce(check, F.lit(False)), name) for name, check in rules.items()]), lambda p: p.isNotNull()))
