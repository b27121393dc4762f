"""Queries on keyed tables, sizes, trees and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import checks, lists, paths, text
from millrace.operators import cards, footprint, relational, trees
from millrace.operators.exactly_once import event_key
from millrace.operators.merge import round_robin
from millrace.sources.tables import table


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").withColumn("size", F.octet_length("text").cast("bigint"))


def size_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return footprint.buckets(_sized(spark, folder), F.col("source"))


def extension_buckets(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "doc_pages").withColumn("size", F.length("relative_path").cast("bigint"))
    return footprint.buckets(pages, paths.extension(F.col("relative_path")))


def largest_files(spark: SparkSession, folder: str) -> DataFrame:
    return footprint.largest(_sized(spark, folder), 25, "size", "doc_id").select("doc_id", "size")


def file_total(spark: SparkSession, folder: str) -> DataFrame:
    return footprint.total(_sized(spark, folder), "doc_id")


def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return footprint.duplicate_groups(_sized(spark, folder), F.col("text"), "size", 64)


def top_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return footprint.largest(duplicate_groups(spark, folder), 20, "redundant", "digest")


def redundant_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_groups(spark, folder).agg(F.count("*").alias("n_groups"), F.sum("redundant").alias("redundant"))


def prune_total(spark: SparkSession, folder: str) -> DataFrame:
    return footprint.pruned(_sized(spark, folder), paths.under(F.col("source"), ("math", "408/computer-networks")))


def copy_check(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose first and last export differ in nothing but the date, as a canonical file and its copy."""
    pages = table(spark, folder, "doc_pages").select("url", "page_id", F.sha2(F.to_json(F.struct("title", "description", "structured_data")), 256).alias("digest"))
    edge = pages.groupBy("url").agg(F.count("*").alias("n"), F.min("page_id").alias("a"), F.max("page_id").alias("b")).where("n > 1")
    files = pages.join(edge, "url").where("page_id = a OR page_id = b").select("url", F.when(F.col("page_id") == F.col("a"), "index").otherwise("copy").alias("name"), "digest")
    return footprint.copy_check(files, "url", "name", "digest", "index", "copy")


def tasks_with_jobs(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "publish_jobs").withColumnRenamed("task", "task_id")
    return trees.with_children(table(spark, folder, "aw_tasks").select("id", "owner"), jobs, "id", "task_id")


def tasks_without_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return relational.orphans(table(spark, folder, "aw_tasks").select("id", "owner"), table(spark, folder, "publish_jobs").select(F.col("task").alias("id")), "id")


def task_memberships(spark: SparkSession, folder: str) -> DataFrame:
    members = table(spark, folder, "publish_jobs").select(F.col("task").alias("id"), "status")
    own = relational.memberships(table(spark, folder, "aw_tasks").select("id"), members.where("status IS NOT NULL"), "id", "status")
    return own.select("id", F.col("owners").cast("bigint").alias("owners"), "owner_names")


def latest_job(spark: SparkSession, folder: str) -> DataFrame:
    return relational.latest(table(spark, folder, "publish_jobs").select("task", "version", "id", "status", "updated"), ["task"], [F.col("version"), F.col("updated"), F.col("id")])


def next_version(spark: SparkSession, folder: str) -> DataFrame:
    return relational.next_version(table(spark, folder, "publish_jobs"), ["task"], "version").withColumn("next_version", F.col("next_version").cast("bigint"))


def only_recent_job(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "publish_jobs").select("id", "updated").distinct()
    now = jobs.agg(F.max("updated")).first()[0]
    recent = F.col("updated") > (F.lit(now).cast("timestamp") - F.expr("INTERVAL 60 MINUTES"))
    return relational.only_candidate(jobs, recent, "id")


def event_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "task_enrich_events")
    return rows.select("delivery_id", event_key(F.lit(None).cast("string"), F.col("owner_id"), F.col("task_record_id"), F.col("checksum")).alias("event_id"))


def trigger_checks(spark: SparkSession, folder: str) -> DataFrame:
    ok = checks.trigger(*[F.col(c) for c in ("schema_version", "kind", "task_record_id", "checksum")])
    return table(spark, folder, "task_enrich_events").select("delivery_id", ok.alias("valid"), F.when(ok, checks.flag(F.col("build_md"))).alias("build_md"), F.when(ok, checks.flag(F.col("build_pdf"))).alias("build_pdf"))


def artifact_keys(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "publish_jobs").select("id", "task", "version").distinct()
    jobs = jobs.withColumn("kind", F.when(F.col("version") % 2 == 0, "pdf").otherwise("md"))
    ok = checks.artifact(F.col("task"), F.col("id"), F.col("version"), F.col("kind"))
    return jobs.select("id", "task", "version", ok.alias("valid"), F.when(ok, checks.blob_key(F.col("task"), F.col("version"), F.col("id"), F.col("kind"))).alias("blob_key"), checks.content_type(F.col("kind")).alias("content_type"))


def upsert_plan(spark: SparkSession, folder: str) -> DataFrame:
    planned = relational.latest(table(spark, folder, "doc_pages").select("url", "page_id", "updated"), ["url"], [F.col("updated"), F.col("page_id")]).select("url", "page_id")
    existing = table(spark, folder, "documents").where("url IS NOT NULL").select("url", "doc_id")
    return relational.upsert_plan(planned, existing, ["url"], "doc_id")


def merged_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """All jobs after an upsert of the published ones by task and version: every version takes part, those of hot tasks too."""
    jobs = table(spark, folder, "publish_jobs").select("task", "version", "id", "status", "updated")
    done = F.coalesce(F.col("status") == "published", F.lit(False))
    return relational.merged(jobs.where(~done).distinct(), jobs.where(done), ["task", "version"], [F.col("updated"), F.col("id")])


def status_swap(spark: SparkSession, folder: str) -> DataFrame:
    return relational.swapped(table(spark, folder, "publish_jobs").select("id", "task", "version", "status").distinct(), "status", "queued", "snapshotting")


def batch_plan(spark: SparkSession, folder: str) -> DataFrame:
    return relational.batched(table(spark, folder, "documents").where("text != ''").select("doc_id"), ["doc_id"], 50)


def recent_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("updated IS NOT NULL").orderBy(F.desc("updated"), "doc_id").limit(50).select("doc_id", F.date_format("updated", "yyyy-MM-dd").alias("day"))


def display_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "aw_tasks").select("id", text.display_title(F.col("manual_title"), F.col("title"), F.col("id")).alias("display"))


def publish_keys(spark: SparkSession, folder: str) -> DataFrame:
    slug = paths.file_segment(F.col("title"))
    return table(spark, folder, "aw_tasks").select("id", checks.publish_key(F.lit(""), slug, F.col("id")).alias("publish_key"))


def region_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Customers up to nations up to regions, each parent listing its children."""
    customer, nation, region = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    count = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"))
    kept = trees.with_children(nation, customer, "n_nationkey", "c_nationkey").join(count, "n_nationkey")
    lines = trees.summaries(kept, ["n_regionkey"], F.col("n_name"), F.concat(F.col("n_customers").cast("string"), F.lit(" customers")), ["n_nationkey"])
    return region.join(lines.withColumnRenamed("n_regionkey", "r_regionkey"), "r_regionkey").select("r_name", "lines", "n_children")


def nested_tree(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = (table(spark, folder, t) for t in ("nation", "region"))
    own = trees.nested(region, nation, "r_regionkey", "n_regionkey", ["n_nationkey"], ["n_name"], "nations")
    return own.select("r_regionkey", "r_name", F.array_join(F.transform("nations", lambda n: n["n_name"]), "|").alias("nations"))


def tree_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """All folders below each category, from parent and child folders of the page groups."""
    groups = table(spark, folder, "doc_pages").select("page_group").distinct()
    paths_ = groups.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("page_group", "/"))), lambda i: F.concat_ws("/", F.slice(F.split("page_group", "/"), 1, i)))).alias("node")).distinct()
    edges = paths_.where(F.instr("node", "/") > 0).select(F.regexp_replace("node", "/[^/]*$", "").alias("parent"), "node")
    return trees.reachable(edges, paths_.where(F.instr("node", "/") == 0).select(F.col("node").alias("root")))


def _ranges(spark: SparkSession, folder: str, size: int = 225) -> DataFrame:
    n = table(spark, folder, "word_cards").count()
    return spark.range(-(-n // size)).select(F.format_string("module-%02d", F.col("id") + 1).alias("slug"), (F.col("id") * size).alias("start"), F.least((F.col("id") + 1) * size, F.lit(n)).alias("end"))


def card_modules(spark: SparkSession, folder: str) -> DataFrame:
    numbered = relational.numbered(table(spark, folder, "word_cards").select("card_id", "word", "label"), ["card_id"], "pos")
    return cards.modules(numbered, _ranges(spark, folder))


def module_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Where a course without its second module has a hole."""
    return cards.gaps(_ranges(spark, folder, 50).where("slug != 'module-02'"))


def sense_shares(spark: SparkSession, folder: str) -> DataFrame:
    return cards.sense_shares(table(spark, folder, "word_cards")).withColumn("sense_no", F.col("sense_no").cast("bigint"))


def card_tones(spark: SparkSession, folder: str) -> DataFrame:
    own = relational.numbered(table(spark, folder, "word_cards").select("card_id"), ["card_id"], "pos")
    return own.select("card_id", cards.tone(F.col("pos")).alias("tone"))


def study_views(spark: SparkSession, folder: str) -> DataFrame:
    """What each way to study shows of each card: its texts, null where they are hidden, and its senses."""
    rows = table(spark, folder, "word_cards")
    out = None
    for mode in cards.MODES:
        view = cards.view(rows, mode)
        shown = lambda column, value: (value if column in view.columns else F.lit(None)).cast("string").alias(column)  # noqa: E731, B023
        listed = lambda items, field: F.array_join(F.transform(items, lambda m: F.coalesce(m[field], F.lit(""))), "|")
        own = view.select("card_id", F.lit(mode).alias("mode"), shown("word", F.col("word")), shown("phonetic", F.col("phonetic")), shown("meanings", listed("meanings", "text")), shown("senses", listed("senses", "gloss")))
        out = own if out is None else out.unionByName(own)
    return out


def first_meanings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "word_cards").select("card_id", F.exists("meanings", lambda m: F.coalesce(m["key"], F.lit(False))).alias("any_key"), F.forall("meanings", lambda m: F.coalesce(m["phrase"], F.lit(False))).alias("all_phrases"), F.try_element_at("meanings", F.lit(1))["pos"].alias("first_pos"))


def merged_lists(spark: SparkSession, folder: str) -> DataFrame:
    """For each category the newest pages and the pages by title, interleaved; a url only once, 36 at most. The lists
    come whole: however often one url is exported, those after it still count."""
    pages = table(spark, folder, "doc_pages").select("category", "url", "page_id", "updated", "title")
    from pyspark.sql import Window

    newest = pages.select("category", "url", F.lit(0).alias("list_no"), F.row_number().over(Window.partitionBy("category").orderBy(F.desc("updated"), "page_id")).alias("place"))
    titled = pages.select("category", "url", F.lit(1).alias("list_no"), F.row_number().over(Window.partitionBy("category").orderBy("title", "page_id")).alias("place"))
    out = round_robin(newest.unionByName(titled), ["category"], "list_no", "place", "url", 36)
    return out.select("category", "url", F.col("merged_rank").cast("bigint").alias("merged_rank"))


def page_urls_unique(spark: SparkSession, folder: str) -> DataFrame:
    return relational.unique(table(spark, folder, "doc_pages"), ["url"])


def job_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What came of the jobs of each owner, where versions stand for tries."""
    jobs = table(spark, folder, "publish_jobs").select("id", "owner", "status", "version").distinct()
    return lists.outcome(jobs, ["owner"], "status", "published", "failed", F.col("version"), 3)


def owner_titles(spark: SparkSession, folder: str) -> DataFrame:
    """For each task whether its two titles hold the same words, and the words of both in order."""
    words = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    own = table(spark, folder, "aw_tasks")
    a, b = words(F.col("title")), words(F.col("manual_title"))
    return own.select("id", lists.same_items(a, b).alias("same"), F.array_join(lists.merged_order(a, b), " ").alias("words"), F.array_join(lists.with_item(F.array("owner"), F.col("id")), " ").alias("ids"))


def user_countdown(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", text.countdown((F.unix_seconds(F.lit("2024-06-01 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")))).alias("c")).select("event_id", "c.days", "c.hours", "c.minutes", "c.seconds")


_SIZED = "(SELECT *, strlen(text)::BIGINT AS size FROM documents WHERE text IS NOT NULL)"
_DUP = f"(SELECT sha256(text) AS digest, size, count(*) AS copies, (size * (count(*) - 1))::BIGINT AS redundant FROM {_SIZED} WHERE size >= 64 GROUP BY sha256(text), size HAVING count(*) > 1)"
_JOBS = "(SELECT DISTINCT id, task, version, CASE WHEN version % 2 = 0 THEN 'pdf' ELSE 'md' END AS kind FROM publish_jobs)"

QUERIES = {
    f.__name__: f
    for f in (
        size_buckets, extension_buckets, largest_files, file_total, duplicate_groups, top_duplicates, redundant_bytes, prune_total, copy_check, tasks_with_jobs, tasks_without_jobs, task_memberships, latest_job, next_version,
        only_recent_job, event_ids, trigger_checks, artifact_keys, upsert_plan, merged_jobs, status_swap, batch_plan, recent_documents, display_titles, publish_keys, region_rollup, nested_tree, tree_nodes, card_modules, module_gaps,
        sense_shares, card_tones, study_views, first_meanings, merged_lists, user_countdown, page_urls_unique, job_outcomes, owner_titles,
    )
}
SQL = {
    "size_buckets": f"SELECT source AS bucket, count(*) AS files, sum(size)::BIGINT AS bytes FROM {_SIZED} GROUP BY source",
    "extension_buckets": r"SELECT coalesce(nullif(lower(regexp_extract(relative_path, '[^/.](\.[^./]*)$', 1)), ''), '(none)') AS bucket, count(*) AS files, sum(length(relative_path))::BIGINT AS bytes FROM doc_pages GROUP BY 1",
    "largest_files": f"SELECT doc_id, size FROM {_SIZED} ORDER BY size DESC, doc_id LIMIT 25",
    "file_total": f"SELECT count(*) AS files, sum(size)::BIGINT AS bytes, arg_min(doc_id, (-size, doc_id)) AS largest_name, max(size) AS largest_bytes FROM {_SIZED}",
    "duplicate_groups": f"SELECT * FROM {_DUP}",
    "top_duplicates": f"SELECT * FROM {_DUP} ORDER BY redundant DESC, digest LIMIT 20",
    "redundant_bytes": f"SELECT count(*) AS n_groups, sum(redundant)::BIGINT AS redundant FROM {_DUP}",
    "prune_total": f"SELECT count(*) AS removed_files, coalesce(sum(size), 0)::BIGINT AS removed_bytes FROM {_SIZED} WHERE source IN ('math', '408/computer-networks') OR source LIKE 'math/%' OR source LIKE '408/computer-networks/%'",
    "copy_check": """WITH e AS (SELECT url AS u, min(page_id) AS a, max(page_id) AS b FROM doc_pages GROUP BY url HAVING count(*) > 1)
SELECT u AS url, (x.title IS NOT DISTINCT FROM y.title AND x.description IS NOT DISTINCT FROM y.description AND x.structured_data IS NOT DISTINCT FROM y.structured_data) AS same FROM e JOIN doc_pages x ON x.page_id = a JOIN doc_pages y ON y.page_id = b""",
    "tasks_with_jobs": "SELECT id, owner FROM aw_tasks WHERE id IN (SELECT task FROM publish_jobs)",
    "tasks_without_jobs": "SELECT id, owner FROM aw_tasks WHERE id NOT IN (SELECT task FROM publish_jobs WHERE task IS NOT NULL)",
    "task_memberships": "WITH m AS (SELECT task, count(*) AS owners, string_agg(status, ', ' ORDER BY status) AS owner_names FROM (SELECT DISTINCT task, status FROM publish_jobs WHERE status IS NOT NULL) GROUP BY task) SELECT id, coalesce(owners, 0) AS owners, coalesce(owner_names, '(none)') AS owner_names FROM aw_tasks LEFT JOIN m ON task = id WHERE coalesce(owners, 0) <> 1",
    "latest_job": "SELECT task, version, id, status, updated FROM publish_jobs QUALIFY row_number() OVER (PARTITION BY task ORDER BY version DESC NULLS LAST, updated DESC NULLS LAST, id DESC NULLS LAST) = 1",
    "next_version": "SELECT task, (greatest(coalesce(max(version), 0), 0) + 1)::BIGINT AS next_version FROM publish_jobs GROUP BY task",
    "only_recent_job": "WITH j AS (SELECT DISTINCT id, updated FROM publish_jobs) SELECT min(id) AS id FROM j WHERE updated > (SELECT max(updated) FROM j) - INTERVAL 60 MINUTES HAVING count(*) = 1",
    "event_ids": r"SELECT delivery_id, sha256(lower(trim(owner_id)) || chr(0) || lower(regexp_replace(task_record_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) || chr(0) || lower(trim(checksum))) AS event_id FROM task_enrich_events",
    "trigger_checks": "WITH t AS (SELECT *, coalesce(schema_version = 2 AND kind = 'task' AND regexp_full_match(task_record_id, '[a-z0-9]{15}') AND regexp_full_match(checksum, '[a-f0-9]{64}'), false) AS valid FROM task_enrich_events) SELECT delivery_id, valid, CASE WHEN valid THEN coalesce(build_md, true) END AS build_md, CASE WHEN valid THEN coalesce(build_pdf, true) END AS build_pdf FROM t",
    "artifact_keys": f"WITH j AS (SELECT *, coalesce(regexp_full_match(trim(task), '[a-z0-9]{{15}}') AND regexp_full_match(trim(id), '[a-z0-9]{{15}}') AND version BETWEEN 1 AND 999999999, false) AS valid FROM {_JOBS}) SELECT id, task, version, valid, CASE WHEN valid THEN 'documents/tasks/' || trim(task) || '/v' || version || '/messages/' || trim(id) || '/document.' || kind END AS blob_key, CASE kind WHEN 'md' THEN 'text/markdown; charset=utf-8' ELSE 'application/pdf' END AS content_type FROM j",
    "upsert_plan": "WITH p AS (SELECT url, page_id FROM doc_pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY updated DESC NULLS LAST, page_id DESC) = 1), e AS (SELECT url, min(doc_id) AS target_id FROM documents WHERE url IS NOT NULL GROUP BY url) SELECT url, page_id, target_id, CASE WHEN target_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM p LEFT JOIN e USING (url)",
    "merged_jobs": "WITH jobs AS (SELECT task, version, id, status, updated, coalesce(status = 'published', false) AS done FROM publish_jobs), old AS (SELECT DISTINCT task, version, id, status, updated FROM jobs WHERE NOT done), new AS (SELECT task, version, id, status, updated FROM jobs WHERE done QUALIFY row_number() OVER (PARTITION BY task, version ORDER BY updated DESC NULLS LAST, id DESC NULLS LAST) = 1) SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.task = old.task AND new.version = old.version) UNION ALL SELECT * FROM new",
    "status_swap": "SELECT id, task, version, CASE WHEN status = 'queued' THEN 'snapshotting' ELSE status END AS status, coalesce(status = 'queued', false) AS swapped FROM (SELECT DISTINCT id, task, version, status FROM publish_jobs)",
    "batch_plan": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch FROM documents WHERE text <> ''",
    "recent_documents": "SELECT doc_id, strftime(updated AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM documents WHERE updated IS NOT NULL ORDER BY updated DESC, doc_id LIMIT 50",
    "display_titles": "SELECT id, substr(coalesce(nullif(trim(manual_title), ''), nullif(trim(title), ''), id), 1, 512) AS display FROM aw_tasks",
    "publish_keys": "WITH s AS (SELECT id, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'root') AS slug FROM aw_tasks) SELECT id, CASE WHEN regexp_full_match(slug, '[a-z0-9]+(?:-[a-z0-9]+)*') AND length(slug) <= 96 THEN slug ELSE 'document' END || '-' || right(id, 6) AS publish_key FROM s",
    "region_rollup": "WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT r_name, string_agg('- ' || n_name || ': ' || n || ' customers', chr(10) ORDER BY n_nationkey) AS lines, count(*) AS n_children FROM region JOIN nation ON n_regionkey = r_regionkey JOIN c ON c_nationkey = n_nationkey GROUP BY r_regionkey, r_name",
    "nested_tree": "SELECT r_regionkey, r_name, coalesce(string_agg(n_name, '|' ORDER BY n_nationkey), '') AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL",
    "tree_nodes": "WITH p AS (SELECT DISTINCT array_to_string(string_split(page_group, '/')[1:i], '/') AS node FROM (SELECT page_group, unnest(range(1, len(string_split(page_group, '/')) + 1)) AS i FROM doc_pages)) SELECT string_split(node, '/')[1] AS root, node FROM p",
    "card_modules": "WITH c AS (SELECT row_number() OVER (ORDER BY card_id) - 1 AS pos, word, try_cast(nullif(regexp_extract(label, '[0-9]+'), '') AS BIGINT) AS imp FROM word_cards), g AS (SELECT pos // 225 AS m, count(*) AS n, arg_min(word, pos) AS first_word, arg_max(word, pos) AS last_word, arg_min(struct_pack(v := imp), pos).v AS a, arg_max(struct_pack(v := imp), pos).v AS b FROM c GROUP BY 1) SELECT format('module-{:02d}', m + 1) AS slug, m * 225 AS start, least((m + 1) * 225, (SELECT count(*) FROM c)) AS \"end\", n, first_word, last_word, CASE WHEN a IS NULL THEN '重要性未标注' ELSE '重要性 ' || a END || CASE WHEN a IS NOT DISTINCT FROM b THEN '' ELSE '–' || coalesce(b::VARCHAR, '未标注') END AS importance_range FROM g",
    "module_gaps": "WITH n AS (SELECT count(*) AS n FROM word_cards), r AS (SELECT format('module-{:02d}', i + 1) AS slug, i * 50 AS start, least((i + 1) * 50, n) AS \"end\" FROM n, LATERAL (SELECT unnest(range(0, (n + 49) // 50)) AS i)), k AS (SELECT *, coalesce(lag(\"end\") OVER (ORDER BY start), 0) AS b FROM r WHERE slug <> 'module-02') SELECT slug, start, \"end\" FROM k WHERE start <> b",
    "sense_shares": "WITH s AS (SELECT card_id, senses, unnest(senses) AS s, generate_subscripts(senses, 1) - 1 AS sense_no, list_sum(list_transform(senses, lambda x: greatest(coalesce(x.count, 0), 0))) AS total FROM word_cards), p AS (SELECT card_id, sense_no, s.gloss AS gloss, coalesce(s.percentage, CASE WHEN total <= 0 THEN 0.0 ELSE s.count / total * 100 END) AS v FROM s) SELECT card_id, sense_no, gloss, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0 ELSE least(100, greatest(0, floor(least(greatest(v, -1), 101) + 0.5)))::INT END AS percentage FROM p",
    "card_tones": "SELECT card_id, ((row_number() OVER (ORDER BY card_id) - 1) % 7 + 1)::INT AS tone FROM word_cards",
    "study_views": "SELECT card_id, mode, CASE WHEN mode <> 'dictation' THEN word END AS word, CASE WHEN mode <> 'dictation' THEN phonetic END AS phonetic, CASE WHEN mode <> 'translation' THEN array_to_string(list_transform(meanings, lambda m: coalesce(m.text, '')), '|') END AS meanings, CASE WHEN mode = 'full' THEN array_to_string(list_transform(senses, lambda m: coalesce(m.gloss, '')), '|') END AS senses FROM word_cards, (SELECT unnest(['full', 'compact', 'dictation', 'translation']) AS mode)",
    "first_meanings": "SELECT card_id, CASE WHEN meanings IS NOT NULL THEN len(list_filter(meanings, lambda m: coalesce(m.key, false))) > 0 END AS any_key, CASE WHEN meanings IS NOT NULL THEN len(list_filter(meanings, lambda m: coalesce(m.phrase, false))) = len(meanings) END AS all_phrases, meanings[1].pos AS first_pos FROM word_cards",
    "merged_lists": "WITH l AS (SELECT category, url, 0 AS list_no, row_number() OVER (PARTITION BY category ORDER BY updated DESC, page_id) AS place FROM doc_pages UNION ALL SELECT category, url, 1, row_number() OVER (PARTITION BY category ORDER BY title, page_id) FROM doc_pages), f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY category, url ORDER BY place, list_no) = 1) SELECT category, url, row_number() OVER (PARTITION BY category ORDER BY place, list_no) AS merged_rank FROM f QUALIFY merged_rank <= 36",
    "page_urls_unique": "SELECT count(*) AS n, count(DISTINCT url) AS n_keys, count(*) = count(DISTINCT url) AS is_unique FROM doc_pages",
    "job_outcomes": "SELECT owner, CASE WHEN bool_or(coalesce(status = 'failed', false)) THEN 'failed' WHEN bool_and(coalesce(status = 'published', false)) THEN 'completed' WHEN max(version) >= 3 THEN 'expired' ELSE 'waiting' END AS outcome, count(*) AS n_jobs FROM (SELECT DISTINCT id, owner, status, version FROM publish_jobs) GROUP BY owner",
    "owner_titles": "WITH w AS (SELECT id, owner, string_split(coalesce(title, ''), ' ') AS a, string_split(coalesce(manual_title, ''), ' ') AS b FROM aw_tasks) SELECT id, list_sort(a) = list_sort(b) AS same, array_to_string(list_transform(list_filter(list_zip(list_concat(a, b), range(1, len(a) + len(b) + 1)), lambda z: list_position(list_concat(a, b), z[1]) = z[2]), lambda z: z[1]), ' ') AS words, owner || ' ' || id AS ids FROM w",
    "user_countdown": "WITH d AS (SELECT event_id, greatest(epoch(TIMESTAMP '2024-06-01 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT, 0) AS s FROM events) SELECT event_id, s // 86400 AS days, (s % 86400 // 3600)::INT AS hours, (s % 3600 // 60)::INT AS minutes, (s % 60)::INT AS seconds FROM d",
}
