"""The index of a corpus of pages: records, shards, filters, files with content addresses, routers and manifest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import digest12
from millrace.functions.paths import file_segment
from millrace.functions.text import routing_tokens
from millrace.operators import bloom_index as bloom
from millrace.operators.records import body_records, clean_pages, core_records, record_text
from millrace.operators.relational import latest
from millrace.operators.sharding import BODY_CHARS, CORE_CHARS, SOFT, guarded, record_parts, split_oversized, stable_shards
from millrace.sources.shared import write_shared

_FIELDS = ("title", "description", "breadcrumbs", "content", "keywords", "url")


def current_pages(pages: DataFrame) -> DataFrame:
    """Of pages exported again under the same url, the last."""
    return latest(pages, ["url"], [F.col("updated"), F.col("page_id")])


def sharded_records(pages: DataFrame, soft: int = SOFT) -> DataFrame:
    """All records of the pages with their ``shard``: kind, category, page_group, record_id, the record's fields, chars and shard. Shards are planned
    by code points; one that is written in more than ``soft`` bytes is parted again."""
    now = write_shared(clean_pages(current_pages(pages)), "pages")
    core = core_records(now).withColumns({"kind": F.lit("core"), "owner": F.col("category"), "key": F.col("url"), "section_no": F.lit(0), "chunk_no": F.lit(0)})
    body = body_records(now).withColumns({"kind": F.lit("body"), "owner": F.col("page_group"), "key": F.split_part("url", F.lit("#"), F.lit(1))})
    columns = ["kind", "owner", "key", "page_id", "category", "page_group", "section_no", "chunk_no", *_FIELDS]
    records = write_shared(core.select(*columns).unionByName(body.select(*columns)).withColumn("chars", F.length(record_text())), "records")
    large = records.where("kind = 'body'").groupBy("page_id").agg(F.sum("chars").alias("n")).where(F.col("n") > BODY_CHARS).select("page_id")
    parts = record_parts(records.where("kind = 'body'").join(large, "page_id", "left_semi"), "page_id", ["section_no", "chunk_no"], "chars").select(F.lit("body").alias("kind"), "page_id", "section_no", "chunk_no", "part")
    records = records.join(parts, ["kind", "page_id", "section_no", "chunk_no"], "left").withColumn("key", F.concat_ws("|", "key", "part")).drop("part")
    placed = None
    for kind, target in (("core", CORE_CHARS), ("body", BODY_CHARS)):
        units = records.where(F.col("kind") == kind).groupBy("owner", "key").agg(F.sum("chars").alias("chars"))
        own = stable_shards(units, target).select(F.lit(kind).alias("kind"), "owner", "key", "shard_key")
        placed = own if placed is None else placed.unionByName(own)
    shard = F.concat_ws("-", "kind", file_segment(F.col("owner")), file_segment(F.col("shard_key")))
    out = records.join(placed, ["kind", "owner", "key"]).withColumn("shard", shard).withColumn("record_id", F.concat_ws(":", "kind", "page_id", "section_no", "chunk_no"))
    out = write_shared(out.withColumn("_bytes", F.octet_length(F.to_json(F.struct(*_FIELDS))) + 1), "placed")
    zero = F.lit("\u0000")
    identity = F.concat("url", zero, "title", zero, F.substring("content", 1, 96))
    return split_oversized(out, "shard", "_bytes", identity, ["page_id", "section_no", "chunk_no"], soft).drop("_bytes")


def gzip_sizes(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``bytes`` and ``gzip_bytes`` of a text column."""
    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes], "bytes bigint", "gzip_bytes bigint"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in batch.column(text).to_pylist()]
            packed = [len(zlib.compress(r, 6)) + 12 for r in raw]  # a gzip frame is 12 bytes longer than a zlib one
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(r) for r in raw], pa.int64()), pa.array(packed, pa.int64())], names=[*batch.schema.names, "bytes", "gzip_bytes"])

    return rows.mapInArrow(measure, schema)


def shard_files(records: DataFrame) -> DataFrame:
    """One row a shard: kind, category, page_group, shard, records, ``json`` (its records in order), its sizes, ``file_name`` with the content's
    address, and a ``warn`` flag. A shard's records fit a row, as shards are bounded; one of too many bytes is an error."""
    record = F.struct("page_id", "section_no", "chunk_no", *_FIELDS)
    own = records.groupBy("kind", "category", "owner", "shard").agg(F.array_sort(F.collect_list(record)).alias("rows"), F.count("*").alias("records"))
    body = F.to_json(F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in _FIELDS])))
    files = gzip_sizes(own.select("kind", "category", F.col("owner").alias("page_group"), "shard", "records", body.alias("json")), "json")
    return guarded(files).withColumn("file_name", F.concat_ws("", "shard", F.lit("-"), digest12(F.col("json")), F.lit(".json")))


def routes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The packed filters of the shards and of the categories."""
    sets = write_shared(bloom.token_sets(records.withColumn("tokens", routing_tokens(record_text())), ["category", "shard"], F.col("tokens")), "sets")
    narrow = bloom.packed(bloom.filters(sets.select("shard", "token"), ["shard"]), ["shard"])
    wide = bloom.packed(bloom.filters(sets.select("category", "token").distinct(), ["category"], bloom.CATEGORY_BITS), ["category"])
    return narrow, wide


def routers(files: DataFrame, shard_routes: DataFrame) -> DataFrame:
    """One router a category: ``category``, ``json`` (its shards by kind, group and file), sizes and ``file_name``."""
    shard = F.struct("page_group", "file_name", "kind", "records", "bytes", "gzip_bytes", F.struct("bits", "hashes", "tokens", F.base64("data").alias("data")).alias("route"))
    own = files.join(shard_routes, "shard").groupBy("category").agg(F.array_sort(F.collect_list(shard)).alias("shards"))
    of = lambda kind: F.filter("shards", lambda s: s["kind"] == kind)
    out = gzip_sizes(own.select("category", F.to_json(F.struct(F.lit(2).alias("version"), "category", of("core").alias("core"), of("body").alias("body"))).alias("json")), "json")
    return guarded(out).withColumn("file_name", F.concat(F.lit("router-"), file_segment(F.col("category")), F.lit("-"), digest12(F.col("json")), F.lit(".json")))


def category_entries(files: DataFrame) -> DataFrame:
    """``category``, ``core_shards``, ``body_shards``, ``records`` (of body shards) and the sums of sizes."""
    core, body = F.col("kind") == "core", F.col("kind") == "body"
    return files.groupBy("category").agg(
        F.count_if(core).alias("core_shards"), F.count_if(body).alias("body_shards"), F.sum(F.when(body, F.col("records")).otherwise(0)).alias("records"), F.sum("bytes").alias("bytes"), F.sum("gzip_bytes").alias("gzip_bytes")
    )


def manifest(pages: int, files: DataFrame, router_files: DataFrame, category_routes: DataFrame) -> DataFrame:
    """One row, ``json``: the public manifest with totals and the entry of each category. As many entries as categories."""
    entries = category_entries(files).drop("bytes", "gzip_bytes").join(router_files.select("category", F.struct("file_name", "bytes", "gzip_bytes").alias("router")), "category").join(category_routes.select("category", F.struct("bits", "hashes", "tokens", F.base64("data").alias("data")).alias("route")), "category")
    listed = entries.groupBy().agg(F.array_sort(F.collect_list(F.struct("category", "core_shards", "body_shards", "records", "router", "route"))).alias("categories"), F.sum("records").alias("records"))
    size = files.groupBy().agg(*[F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0)).alias(f"{k}_{c}") for k in ("core", "body") for c in ("bytes", "gzip_bytes")])
    both = listed.withColumn("_one", F.lit(1)).join(size.withColumn("_one", F.lit(1)), "_one")
    body = F.struct(F.lit(4).alias("version"), F.lit("routed").alias("mode"), F.lit(pages).alias("pages"), "records", F.struct(F.lit("bloom-fnv").alias("algorithm"), F.lit(0.5).alias("min_score")).alias("routing"), F.struct("core_bytes", "core_gzip_bytes", "body_bytes", "body_gzip_bytes").alias("storage"), "categories")
    return both.select(F.to_json(body).alias("json"))
