"""Queries that build and use the index of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import routing_tokens
from millrace.operators import index_build
from millrace.operators.records import record_text
from millrace.operators.relational import latest
from millrace.operators.search import Index, build, find
from millrace.operators.sharding import LEVELS, stable_shards
from millrace.plans import sqltext
from millrace.plans.corpus import QUERY_STEP
from millrace.sources.shared import write_shared
from millrace.sources.tables import table


#: Code points of a shard of pages here: small, so that small tables have several.
_TARGET = 60_000


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "doc_pages")


def stable_page_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of each page by the size of its blocks, shards of at most 60,000 code points a group."""
    pages = latest(_pages(spark, folder), ["url"], [F.col("updated"), F.col("page_id")])
    size = F.aggregate("structured_data.contents", F.lit(0).cast("bigint"), lambda n, c: n + F.coalesce(F.length(c["content"]), F.lit(0)))
    return stable_shards(pages.select(F.col("page_group").alias("owner"), F.col("url").alias("key"), size.alias("chars")), _TARGET)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return write_shared(index_build.sharded_records(_pages(spark, folder)), "sharded")


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    return index_build.shard_files(_records(spark, folder)).drop("json")


def router_files(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    return index_build.routers(index_build.shard_files(records), index_build.routes(records)[0]).select("category", "file_name", "bytes", "gzip_bytes")


def category_entries(spark: SparkSession, folder: str) -> DataFrame:
    return index_build.category_entries(index_build.shard_files(_records(spark, folder)))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    files = write_shared(index_build.shard_files(records), "files")
    narrow, wide = index_build.routes(records)
    pages = records.where("kind = 'core'").count()
    return index_build.manifest(pages, files, index_build.routers(files, narrow), wide)


#: Categories that a module of the site searches, by the category of the page a query is asked from. Fixed values.
MODULES = {"politics": ("politics",), "english": ("english",), "math": ("math", "math-question-types"), "math-question-types": ("math", "math-question-types"), "408": ("408",)}
_indexes: dict[tuple[str, str], Index] = {}


def search_index(spark: SparkSession, folder: str) -> Index:
    """The index of the pages of a folder, built and written once in a session; what is searched is what is written."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _indexes:
        placed = _records(spark, folder)
        records = write_shared(placed.select("kind", "shard", "category", F.col("owner").alias("page_group"), "record_id", "url", routing_tokens(record_text()).alias("tokens")), "tokens")
        sizes = index_build.shard_files(placed).select("kind", "shard", "category", "page_group", F.col("gzip_bytes").alias("bytes"))
        _indexes[key] = build(records, sizes)
    return _indexes[key]


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder).where(F.col("page_id") % QUERY_STEP == 0)
    modules = F.create_map(*[x for c, own in MODULES.items() for x in (F.lit(c), F.array(*map(F.lit, own)))])
    return pages.select(F.col("page_id").alias("query_id"), F.col("title").alias("text"), F.col("category").alias("scope_category"), F.col("page_group").alias("scope_group"), F.try_element_at(modules, F.col("category")).alias("allowed"))


def search_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The results for the titles of every page whose id is divisible by 20, asked from that page, against all records of all pages."""
    return find(search_index(spark, folder), _asked(spark, folder))


def search_everywhere(spark: SparkSession, folder: str) -> DataFrame:
    """The same queries asked from no page: the categories are chosen by their filters alone."""
    none = F.lit(None).cast("string")
    return find(search_index(spark, folder), _asked(spark, folder).select("query_id", "text", none.alias("scope_category"), none.alias("scope_group")))


QUERIES = {f.__name__: f for f in (stable_page_shards, shard_files, router_files, category_entries, manifest, search_topk, search_everywhere)}
_DIGITS = " || ".join(f"({sqltext.fnv32(f"('{d}:' || url)")} & 3)::VARCHAR" for d in range(LEVELS))
SQL = {
    # the digits, every part of every level, the first level that fits, its path with x where a level parts nothing; then halves
    "stable_page_shards": f"""WITH RECURSIVE p AS (SELECT page_group AS owner, url, list_sum(list_transform(structured_data.contents, lambda c: coalesce(length(c.content), 0)))::BIGINT AS n FROM doc_pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY updated DESC NULLS LAST, page_id DESC) = 1),
d AS (SELECT owner, url, coalesce(n, 0) AS chars, {_DIGITS} AS digits FROM p),
l AS (SELECT *, unnest(range(0, {LEVELS + 1})) AS level FROM d),
s AS (SELECT owner, url, chars, digits, level, sum(chars) OVER w AS total, count(*) OVER w AS m FROM l WINDOW w AS (PARTITION BY owner, level, substr(digits, 1, level))),
f AS (SELECT *, min(CASE WHEN total <= {_TARGET} OR m <= 1 THEN level END) OVER (PARTITION BY owner, url) AS stop, lag(m) OVER (PARTITION BY owner, url ORDER BY level) AS above FROM s),
h AS (SELECT owner, url, any_value(chars) AS chars, any_value(stop) AS stop, coalesce(string_agg(CASE WHEN m = above THEN 'x' ELSE substr(digits, level::INT, 1) END, '' ORDER BY level) FILTER (WHERE level BETWEEN 1 AND coalesce(stop, {LEVELS})), '0') AS label FROM f GROUP BY owner, url),
r AS (SELECT owner, label, url, chars, row_number() OVER w AS rk, (sum(chars) OVER w)::BIGINT AS cum FROM h WHERE stop IS NULL WINDOW w AS (PARTITION BY owner, label ORDER BY url)),
halves AS (SELECT owner, label, 0::BIGINT AS a, count(*) AS b, sum(chars)::BIGINT AS total, '' AS name FROM r GROUP BY owner, label
  UNION ALL SELECT g.owner, g.label, g.na, g.nb, x.cum - coalesce(y.cum, 0), g.nn FROM (
    SELECT owner, label, CASE i WHEN 0 THEN a ELSE a + (b - a + 1) // 2 END AS na, CASE i WHEN 0 THEN a + (b - a + 1) // 2 ELSE b END AS nb, name || CASE i WHEN 0 THEN 'a' ELSE 'b' END AS nn FROM halves, (VALUES (0), (1)) v(i) WHERE total > {_TARGET} AND b - a > 1) g
  JOIN r x ON x.owner = g.owner AND x.label = g.label AND x.rk = g.nb LEFT JOIN r y ON y.owner = g.owner AND y.label = g.label AND y.rk = g.na)
SELECT owner, url AS key, chars, label AS shard_key FROM h WHERE stop IS NOT NULL
UNION ALL SELECT r.owner, r.url, r.chars, r.label || t.name FROM r JOIN halves t ON t.owner = r.owner AND t.label = r.label AND r.rk > t.a AND r.rk <= t.b WHERE t.total <= {_TARGET} OR t.b - t.a <= 1"""
}
