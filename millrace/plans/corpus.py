"""Queries on text, tokens, filters and records."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import hashing, markdown, paths, text
from millrace.operators import bloom_index, records
from millrace.operators.index_build import current_pages
from millrace.operators.search import scored
from millrace.plans import sqltext
from millrace.sources.shared import remove_shared, small_batches, write_shared
from millrace.sources.tables import table

#: Queries are the titles of every page whose id is divisible by this; ``record_group_search`` as registered asks with all titles.
QUERY_STEP = 20


def text_strip_markup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.strip_markup(F.col("text")).alias("clean"))


def text_search_form(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.search_text(F.col("text")).alias("clean"))


def natural_chars(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.regexp_count("text", F.lit(text.LETTER)).cast("bigint").alias("n"))


def routing_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select("item_id", F.explode(text.routing_tokens(F.col("text"))).alias("token"))


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The routing tokens of every document by its whole text; ``routing_tokens`` is bound to its SQL, over the evaluation items."""
    return table(spark, folder, "documents").select("doc_id", F.explode(text.routing_tokens(F.col("text"))).alias("token"))


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "doc_pages").select("page_id", "page_group", "category", text.routing_tokens(F.col("title")).alias("tokens"))


def token_df(spark: SparkSession, folder: str) -> DataFrame:
    return _titles(spark, folder).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def token_set_size(spark: SparkSession, folder: str) -> DataFrame:
    return bloom_index.token_sets(_titles(spark, folder), ["page_group"], F.col("tokens")).groupBy("page_group").agg(F.count("*").alias("n_tokens"))


def token_hashes(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _titles(spark, folder).select(F.explode("tokens").alias("token")).distinct()
    return tokens.select("token", hashing.fnv32(F.col("token")).alias("a"), hashing.mixed32(F.col("token")).alias("b"))


def _group_filters(spark: SparkSession, folder: str) -> DataFrame:
    sets = write_shared(bloom_index.token_sets(_titles(spark, folder), ["page_group"], F.col("tokens")), "sets")
    return bloom_index.filters(sets, ["page_group"])


def bloom_bits(spark: SparkSession, folder: str) -> DataFrame:
    return _group_filters(spark, folder).select("page_group", "bits", "bit")


def bloom_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The packed filter of each group, over all text of its records."""
    return bloom_index.packed(_record_filters(_record_tokens(spark, folder)), ["page_group"])


def bloom_scores(spark: SparkSession, folder: str) -> DataFrame:
    asked = _titles(spark, folder).where(F.col("page_id") % QUERY_STEP == 0).select(F.col("page_id").alias("query_id"), F.explode("tokens").alias("token"))
    return bloom_index.scores(_group_filters(spark, folder), ["page_group"], write_shared(asked, "asked")).select("query_id", "page_group", F.round("score", 9).alias("score"))


def group_rank(spark: SparkSession, folder: str) -> DataFrame:
    scored = bloom_scores(spark, folder)
    top = bloom_index.ranked(scored, ["query_id"], F.col("score"), F.col("score"), [F.col("page_group")], 9)
    return top.select("query_id", "page_group", "score", F.col("rank").cast("bigint").alias("rank"))


def group_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best ten titles in each of the nine best groups of each query."""
    titles = write_shared(table(spark, folder, "doc_pages").select(F.col("page_group").alias("shard"), F.col("page_id").alias("record_id"), "url", text.routing_tokens(F.col("title")).alias("tokens")), "titles")
    asked = titles.where(F.col("record_id") % QUERY_STEP == 0).select(F.col("record_id").alias("query_id"), F.explode("tokens").alias("token")).distinct()
    chosen = group_rank(spark, folder).select("query_id", F.lit("core").alias("kind"), F.col("page_group").alias("shard"), "rank")
    return scored(titles, chosen, asked).select("query_id", F.col("shard").alias("page_group"), F.col("record_id").alias("page_id"), "bm25", F.col("position").cast("bigint").alias("position"))


def _record_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the current pages with the routing tokens of all text that is searched: titles, descriptions, headings, blocks, keywords
    and breadcrumbs. The queries over titles are bound to their SQL; these are the sets of the index."""
    with small_batches(spark):
        now = write_shared(records.clean_pages(current_pages(table(spark, folder, "doc_pages"))), "pages")
    core = records.core_records(now).withColumn("record_id", F.concat_ws(":", F.lit("core"), "page_id", F.lit(0), F.lit(0)))
    body = records.body_records(now).withColumn("record_id", F.concat_ws(":", F.lit("body"), "page_id", "section_no", "chunk_no"))
    columns = ["record_id", "page_group", "url", text.routing_tokens(records.record_text()).alias("tokens")]
    with small_batches(spark):
        own = write_shared(core.select(*columns).unionByName(body.select(*columns)), "record-tokens")
    remove_shared(now)
    return own


def _record_filters(own: DataFrame) -> DataFrame:
    """The filters of the groups. A group is bounded no more than a category, so its filter has a category's bounds."""
    sets = write_shared(bloom_index.token_sets(own, ["page_group"], F.col("tokens")), "sets")
    return bloom_index.filters(sets, ["page_group"], bloom_index.CATEGORY_BITS)


def _record_scores(spark: SparkSession, folder: str, own: DataFrame, step: int = QUERY_STEP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries, which are the titles of every page whose id ``step`` divides, with the first query of the same tokens (query_id, first), and of
    these first ones, which alone are asked, the tokens and the score of each group."""
    titles = _titles(spark, folder).where(F.col("page_id") % step == 0).select(F.col("page_id").alias("query_id"), F.explode("tokens").alias("token"))
    sets = titles.groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    firsts = write_shared(sets.groupBy("tokens").agg(F.min("query_id").alias("first")), "asked")
    same = write_shared(sets.join(firsts, "tokens").select("query_id", "first"), "same")
    asked = firsts.select(F.col("first").alias("query_id"), F.explode("tokens").alias("token"))
    scores = bloom_index.token_scores(own, "page_group", F.col("tokens"), asked, bloom_index.CATEGORY_BITS)
    return same, asked, scores.select("query_id", "page_group", F.round("score", 9).alias("score"))


def _for_all(found: DataFrame, same: DataFrame) -> DataFrame:
    """What was found for the first query of the same tokens, for each of these queries."""
    return found.withColumnRenamed("query_id", "first").join(same, "first").select("query_id", *[c for c in found.columns if c != "query_id"])


def _record_rank(scores: DataFrame) -> DataFrame:
    top = bloom_index.ranked(scores, ["query_id"], F.col("score"), F.col("score"), [F.col("page_group")], 9)
    return top.select("query_id", "page_group", "score", F.col("rank").cast("bigint").alias("rank"))


def record_token_df(spark: SparkSession, folder: str) -> DataFrame:
    """In how many records each token stands."""
    return _record_tokens(spark, folder).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def record_token_set_size(spark: SparkSession, folder: str) -> DataFrame:
    return bloom_index.token_sets(_record_tokens(spark, folder), ["page_group"], F.col("tokens")).groupBy("page_group").agg(F.count("*").alias("n_tokens"))


def record_token_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return bloom_index.hashed(_record_tokens(spark, folder).select(F.explode("tokens").alias("token")).distinct()).select("token", "a", "b")


def record_bloom_bits(spark: SparkSession, folder: str) -> DataFrame:
    return _record_filters(_record_tokens(spark, folder)).select("page_group", "bits", "bit")


def record_bloom_scores(spark: SparkSession, folder: str) -> DataFrame:
    same, _, scores = _record_scores(spark, folder, _record_tokens(spark, folder))
    return _for_all(scores, same)


def record_group_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _record_rank(record_bloom_scores(spark, folder))


def record_group_search(spark: SparkSession, folder: str, step: int = QUERY_STEP) -> DataFrame:
    """The best ten records in each of the nine best groups of each query, which are the titles of every page whose id ``step`` divides. The
    registered query has step 1: the titles of all pages."""
    own = _record_tokens(spark, folder)
    same, asked, scores = _record_scores(spark, folder, own, step)
    chosen = _record_rank(scores).select("query_id", F.lit("record").alias("kind"), F.col("page_group").alias("shard"), "rank")
    found = scored(own.withColumnRenamed("page_group", "shard"), chosen, asked)
    remove_shared(own)  # what is scored is written by now
    return _for_all(found.select("query_id", F.col("shard").alias("page_group"), "record_id", "bm25", F.col("position").cast("bigint").alias("position")), same)


def core_records(spark: SparkSession, folder: str) -> DataFrame:
    own = records.core_records(table(spark, folder, "doc_pages"))
    return own.select("page_id", "title", "description", F.array_join("breadcrumbs", "/").alias("breadcrumbs"), "content", "keywords", "url")


def clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as the index takes them; headings and blocks joined."""
    own = records.clean_pages(table(spark, folder, "doc_pages"))
    text = lambda items: F.array_join(F.transform(items, lambda i: i["content"]), "\n")
    return own.select("page_id", "title", "description", text("structured_data.headings").alias("headings"), text("structured_data.contents").alias("contents"))


def page_sections(spark: SparkSession, folder: str) -> DataFrame:
    own = records.sections(table(spark, folder, "doc_pages"), clean=False)
    return own.select("page_id", "heading", "section_title", F.size("paragraphs").cast("bigint").alias("n_paragraphs"), F.array_join("paragraphs", "\n\n").alias("content"))


def section_records(spark: SparkSession, folder: str) -> DataFrame:
    return records.body_records(records.clean_pages(current_pages(table(spark, folder, "doc_pages"))))


def fixed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "documents").select("doc_id", F.posexplode(records.fixed_pieces(F.col("text"), 500)).alias("piece_no", "piece"))
    return own.select("doc_id", F.col("piece_no").cast("bigint").alias("piece_no"), "piece")


def greedy_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(records.greedy_chunks(F.split("text", r"\n\s*\n"), 1000)).alias("chunk_no", "content"))


def page_paths(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("relative_path")
    scope = paths.scope(path)
    return table(spark, folder, "doc_pages").select(
        "page_id", paths.page_url(path).alias("made_url"), paths.markdown_path(path).alias("output_path"), scope["category"].alias("category"), scope["group"].alias("page_group"),
        paths.path_title(path).alias("path_title"), paths.top_area(path).alias("area"), paths.extension(path).alias("extension"), paths.file_segment(F.col("page_group")).alias("segment"),
    )


def frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    head, body = text.split_frontmatter(F.col("text"))
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", text.frontmatter_value(head, "title").alias("title"), text.frontmatter_value(head, "description").alias("description"), F.length(body).cast("bigint").alias("body_chars"))


def first_headings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.first_heading(F.col("text")).alias("heading"))


def strip_mdx(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", markdown.strip_mdx(F.col("text")).alias("body"))


def heading_levels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", markdown.level_headings(F.col("text")).alias("r")).select("doc_id", "r.text", "r.changed")


def publishable(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", markdown.publishable(F.col("text"), F.col("source")).alias("markdown"))


_T = "WITH " + sqltext.tokens("doc_pages", "page_id", "title")
_G = "WITH " + sqltext.tokens("doc_pages", "page_group", "title")
_SIZES = f"sizes AS (SELECT page_group, {sqltext.power_of_two('least(greatest(count(*) * 10, 16384), 65536)')} AS bits FROM tokens GROUP BY page_group)"
_POSITIONS = "positions AS (SELECT DISTINCT page_group, bits, (a + b * i) & (bits - 1) AS bit FROM tokens JOIN sizes USING (page_group) JOIN hashed USING (token), (SELECT unnest([0, 1, 2, 3]) AS i))"
_SCORES = f"""{_G}, {sqltext.hashed()}, {_SIZES}, {_POSITIONS},
asked AS (SELECT DISTINCT p.page_id AS query_id, token FROM (SELECT page_id, title FROM doc_pages WHERE page_id % {QUERY_STEP} = 0) p JOIN (WITH {sqltext.tokens("doc_pages", "page_id", "title")} SELECT * FROM tokens) t USING (page_id)),
probes AS (SELECT DISTINCT query_id, token, bits, (a + b * i) & (bits - 1) AS bit FROM asked JOIN hashed USING (token), (SELECT DISTINCT bits FROM sizes), (SELECT unnest([0, 1, 2, 3]) AS i)),
need AS (SELECT query_id, token, bits, count(*) AS need FROM probes GROUP BY ALL),
have AS (SELECT query_id, token, bits, page_group, count(*) AS have FROM probes JOIN positions USING (bits, bit) GROUP BY ALL),
matched AS (SELECT query_id, page_group, count(*) AS m FROM have JOIN need USING (query_id, token, bits) WHERE have = need GROUP BY ALL),
scored AS (SELECT query_id, page_group, round(m / n, 9) AS score FROM matched JOIN (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id) USING (query_id))"""
_SECTIONS = """WITH heads AS (SELECT page_id, unnest(structured_data.headings) AS h, generate_subscripts(structured_data.headings, 1) AS i FROM doc_pages),
blocks AS (SELECT page_id, coalesce(c.heading, '') AS heading, c.content, i FROM (SELECT page_id, unnest(structured_data.contents) AS c, generate_subscripts(structured_data.contents, 1) AS i FROM doc_pages) WHERE coalesce(c.content, '') <> ''),
firsts AS (SELECT page_id, heading, content, min(i) AS i FROM blocks GROUP BY ALL),
joined AS (SELECT page_id, heading, count(*) AS n, string_agg(content, chr(10) || chr(10) ORDER BY i) AS content FROM firsts GROUP BY ALL),
ids AS (SELECT page_id, '' AS heading FROM doc_pages UNION SELECT page_id, coalesce(h.id, '') FROM heads UNION SELECT page_id, heading FROM blocks),
titles AS (SELECT page_id, h.id AS heading, arg_max(h.content, i) AS t FROM heads GROUP BY ALL)
SELECT page_id, heading, coalesce(nullif(t, ''), title) AS section_title, coalesce(n, 0)::BIGINT AS n_paragraphs, coalesce(content, '') AS content
FROM ids JOIN doc_pages USING (page_id) LEFT JOIN joined USING (page_id, heading) LEFT JOIN titles USING (page_id, heading)"""

QUERIES = {
    f.__name__: f
    for f in (
        text_strip_markup, text_search_form, natural_chars, routing_tokens, document_tokens, token_df, token_set_size, token_hashes, bloom_bits, bloom_packed, bloom_scores, group_rank, group_search, core_records, clean_pages, page_sections, section_records,
        record_token_df, record_token_set_size, record_token_hashes, record_bloom_bits, record_bloom_scores, record_group_rank, record_group_search,
        fixed_chunks, greedy_chunks, page_paths, frontmatter, first_headings, strip_mdx, heading_levels, publishable,
    )
} | {"record_group_search": partial(record_group_search, step=1)}
SQL = {
    "text_strip_markup": f"SELECT doc_id, CASE WHEN len(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}]')) >= 2 THEN c ELSE '' END AS clean FROM (SELECT doc_id, {sqltext.strip_markup('text')} AS c FROM documents)",
    "natural_chars": r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]'))::BIGINT AS n FROM documents",
    "routing_tokens": "WITH " + sqltext.tokens("benchmark", "item_id", "text") + " SELECT item_id, token FROM tokens",
    "token_df": _T + " SELECT token, count(*) AS df FROM tokens GROUP BY token",
    "token_set_size": _G + " SELECT page_group, count(*) AS n_tokens FROM tokens GROUP BY page_group",
    "token_hashes": _T + ", " + sqltext.hashed() + " SELECT token, a, b FROM hashed",
    "bloom_bits": f"{_G}, {sqltext.hashed()}, {_SIZES}, {_POSITIONS} SELECT page_group, bits, bit FROM positions",
    "bloom_scores": _SCORES + " SELECT query_id, page_group, score FROM scored",
    "group_rank": _SCORES + " SELECT query_id, page_group, score, row_number() OVER (PARTITION BY query_id ORDER BY (score >= 0.5) DESC, score DESC, page_group) AS rank FROM scored QUALIFY rank <= 9",
    "group_search": _SCORES + f""", ranked AS (SELECT query_id, page_group, row_number() OVER (PARTITION BY query_id ORDER BY (score >= 0.5) DESC, score DESC, page_group) AS rank FROM scored QUALIFY rank <= 9),
own AS (SELECT page_id, token FROM (WITH {sqltext.tokens("doc_pages", "page_id", "title")} SELECT * FROM tokens)),
sized AS (SELECT p.page_group, p.page_id, p.url, count(token) AS len FROM doc_pages p LEFT JOIN own USING (page_id) GROUP BY ALL),
stats AS (SELECT page_group, count(*) AS n, avg(len) AS avg_len FROM sized GROUP BY page_group),
postings AS (SELECT page_group, page_id, url, len, token FROM sized JOIN own USING (page_id)),
idf AS (SELECT page_group, token, avg_len, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings JOIN stats USING (page_group) GROUP BY page_group, token, n, avg_len),
hits AS (SELECT query_id, page_group, page_id, url, round(sum(idf * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS bm25 FROM ranked JOIN asked USING (query_id) JOIN postings USING (page_group, token) JOIN idf USING (page_group, token) GROUP BY ALL)
SELECT query_id, page_group, page_id, bm25, row_number() OVER (PARTITION BY query_id, page_group ORDER BY bm25 DESC, url, page_id) AS position FROM hits QUALIFY position <= 10""",
    "core_records": """SELECT page_id, title, CASE WHEN trim(description) <> '' THEN substr(description, 1, 300) END AS description, CASE WHEN category = 'root' THEN '' ELSE category END AS breadcrumbs,
substr(coalesce(array_to_string(list_transform(structured_data.headings, lambda h: h.content), ' · '), ''), 1, 600) AS content, concat_ws(' ', title, category, page_group) AS keywords, url FROM doc_pages""",
    "page_sections": _SECTIONS,
    "fixed_chunks": "SELECT doc_id, i AS piece_no, substr(text, i * 500 + 1, 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, ((length(text) - 1) // 500) + 1)) AS i FROM documents WHERE length(text) > 0)",
    "page_paths": r"""WITH p AS (SELECT page_id, page_group, relative_path, regexp_replace(relative_path, '(?i)\.(md|mdx)$', '') AS bare FROM doc_pages),
q AS (SELECT *, regexp_replace(bare, '(?i)(^|/)index$', '') AS slug, list_filter(string_split(regexp_replace(bare, '(?i)(^|/)index$', ''), '/'), lambda x: x <> '') AS parts FROM p)
SELECT page_id, '/docs' || CASE WHEN slug = '' THEN '' ELSE '/' || slug END AS made_url, 'docs' || CASE WHEN slug = '' THEN '' ELSE '/' || slug END || '.md' AS output_path,
coalesce(parts[1], 'root') AS category, CASE WHEN len(parts) >= 2 THEN parts[1] || '/' || parts[2] ELSE coalesce(parts[1], 'root') END AS page_group,
coalesce(nullif(string_split(bare, '/')[-1], ''), 'Untitled') AS path_title,
CASE WHEN relative_path LIKE 'search/%' THEN 'search' WHEN relative_path LIKE 'docs/%' THEN 'docs' WHEN contains(relative_path, '/') THEN string_split(relative_path, '/')[1] ELSE '(root)' END AS area,
coalesce(nullif(lower(regexp_extract(relative_path, '[^/.](\.[^./]*)$', 1)), ''), '(none)') AS extension,
coalesce(nullif(regexp_replace(regexp_replace(lower(page_group), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'root') AS segment FROM q""",
    "first_headings": r"SELECT doc_id, regexp_extract(text, '(?m)^#\s+(.+)$', 1) AS heading FROM documents",
    "frontmatter": r"""WITH f AS (SELECT doc_id, text, regexp_extract(text, '(?s)^---\r?\n(.*?)\r?\n---\r?\n?', 1) AS head, regexp_replace(text, '(?s)^---\r?\n(.*?)\r?\n---\r?\n?', '') AS body FROM documents WHERE text IS NOT NULL)
SELECT doc_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(head, '(?m)^title:[ \t]*(.+)$', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^["'']|["'']$', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS title,
nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(head, '(?m)^description:[ \t]*(.+)$', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^["'']|["'']$', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS description, length(body)::BIGINT AS body_chars FROM f""",
    "greedy_chunks": r"""WITH RECURSIVE p AS (SELECT doc_id, flatten(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda t: list_transform(range(0, (length(t) + 999) // 1000), lambda i: substr(t, i * 1000 + 1, 1000)))) AS q FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, q, 1 AS k, 0 AS chunk_no, q[1] AS content FROM p WHERE len(q) > 0
  UNION ALL SELECT doc_id, q, k + 1, CASE WHEN length(content) + length(q[k + 1]) + 2 <= 1000 THEN chunk_no ELSE chunk_no + 1 END, CASE WHEN length(content) + length(q[k + 1]) + 2 <= 1000 THEN content || chr(10) || chr(10) || q[k + 1] ELSE q[k + 1] END FROM s WHERE k < len(q))
SELECT doc_id, chunk_no, arg_max(content, k) AS content FROM s GROUP BY doc_id, chunk_no""",
    "strip_mdx": r"""WITH RECURSIVE p AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS q FROM documents),
s AS (SELECT doc_id, q, 0 AS k, false AS fence, 0 AS depth, []::VARCHAR[] AS kept FROM p
  UNION ALL SELECT doc_id, q, k + 1, CASE WHEN mark THEN NOT fence ELSE fence END, CASE WHEN mark OR fence THEN depth WHEN depth > 0 THEN greatest(depth + d, 0) WHEN opens THEN d ELSE 0 END,
    CASE WHEN mark OR fence OR (depth <= 0 AND NOT opens AND NOT component) THEN list_append(kept, line) ELSE kept END
  FROM (SELECT *, regexp_matches(bare, '^(```|~~~)') AS mark, regexp_matches(bare, '^(import|export)[\s{(]') AS opens, regexp_matches(bare, '^</?[A-Z][\w.-]*(\s|>|/>)') AS component,
      (len(regexp_extract_all(line, '[{(\[]')) - len(regexp_extract_all(line, '[})\]]')))::INT AS d
    FROM (SELECT *, q[k + 1] AS line, regexp_replace(q[k + 1], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS bare FROM s WHERE k < len(q))))
SELECT doc_id, array_to_string(kept, chr(10)) AS body FROM s WHERE k = len(q)""",
    "heading_levels": r"""WITH RECURSIVE p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS q FROM documents),
s AS (SELECT doc_id, q, 0 AS k, '' AS fence, NULL::VARCHAR AS line, false AS open FROM p
  UNION ALL SELECT doc_id, q, k + 1, CASE WHEN f = '' THEN fence WHEN fence = '' THEN f[1] WHEN fence = f[1] THEN '' ELSE fence END, l, fence = '' AND f = ''
  FROM (SELECT *, q[k + 1] AS l, regexp_extract(q[k + 1], '^\s*(`{3,}|~{3,})', 1) AS f FROM s WHERE k < len(q))),
h AS (SELECT doc_id, k, line, open AND regexp_matches(line, '^(#{1,6})(\s+)(.*)$') AS heading, length(regexp_extract(line, '^(#{1,6})(\s+)(.*)$', 1)) AS level,
  regexp_replace(regexp_extract(line, '^(#{1,6})(\s+)(.*)$', 3), '^\s+|\s+$', '', 'g') AS t, regexp_extract(line, '^(#{1,6})(\s+)(.*)$', 2) || regexp_extract(line, '^(#{1,6})(\s+)(.*)$', 3) AS rest FROM s WHERE k > 0),
m AS (SELECT *, regexp_matches(t, '^[一二三四五六七八九十百]+[、.．]\s*') AS major, regexp_matches(t, '^\d+\.\d+(?:\.\d+)*[、.．]?\s*|^[（(](?:[一二三四五六七八九十百]+|\d+)[）)]\s*') AS minor, regexp_matches(t, '^\d+[、.．]\s*') AS arabic FROM h),
c AS (SELECT *, bool_or(heading AND major AND t <> '') OVER (PARTITION BY doc_id) AS counted FROM m),
o AS (SELECT doc_id, k, line, CASE WHEN heading THEN repeat('#', CASE WHEN major THEN 2 WHEN minor OR (counted AND arabic) THEN 3 WHEN level = 1 THEN 2 WHEN level >= 4 THEN 3 ELSE level END::INT) || rest ELSE line END AS made FROM c)
SELECT doc_id, string_agg(made, chr(10) ORDER BY k) AS text, count_if(made <> line)::INT AS changed FROM o GROUP BY doc_id""",
    "publishable": r"""WITH RECURSIVE p AS (SELECT doc_id, source, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^\x{FEFF}', ''), '\r\n?', chr(10), 'g'), chr(10)) AS q FROM documents),
s AS (SELECT doc_id, source, q, 0 AS k, false AS fence, []::VARCHAR[] AS kept FROM p
  UNION ALL SELECT doc_id, source, q, k + 1, CASE WHEN mark THEN NOT fence ELSE fence END, list_append(kept, CASE WHEN mark OR fence THEN line WHEN regexp_matches(line, '^\s*(?:import|export)\s+') THEN ''
    ELSE regexp_replace(regexp_replace(regexp_replace(line, '(?i)</?(?:script|iframe|object|embed|style|link|meta)\b[^>]*>', '', 'g'), '(?i)<(/?[a-z][^>]*)>', '&lt;\1&gt;', 'g'), '(?i)\]\(\s*javascript:[^)]+\)', '](#)', 'g') END)
  FROM (SELECT *, q[k + 1] AS line, regexp_matches(q[k + 1], '^\s*(~~~|```)') AS mark FROM s WHERE k < len(q))),
b AS (SELECT doc_id, source, regexp_replace(regexp_replace(array_to_string(kept, chr(10)), '(?s)\A---\s*\n.*?\n---\s*\n', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS body FROM s WHERE k = len(q)),
t AS (SELECT doc_id, CASE WHEN regexp_matches(body, '(?m)^#\s+') THEN body ELSE '# ' || source || chr(10) || chr(10) || body END || chr(10) AS markdown FROM b)
SELECT doc_id, CASE WHEN strlen(markdown) <= 1048577 THEN markdown END AS markdown FROM t""",
}
