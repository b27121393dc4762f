"""Queries on checks, defaults, look-ups, plans of changes and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import checks, lists, paths, text
from millrace.operators import footprint, relational, trees
from millrace.sources import files, sinks
from millrace.sources.shared import remove_at_exit, shared_dir, write_shared
from millrace.sources.tables import table


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "publish_jobs").select("id", "owner", "task", "version", "status", "updated").distinct()


def jobs_looked_up(spark: SparkSession, folder: str) -> DataFrame:
    """The jobs of the tasks that have a title of their own, in one look-up."""
    wanted = table(spark, folder, "aw_tasks").where("trim(manual_title) != ''").select(F.col("id").alias("task"))
    return files.lookup(_jobs(spark, folder), "task", wanted).select("id", "task", "version")


def jobs_listed(spark: SparkSession, folder: str) -> DataFrame:
    """The 40 jobs published last: a filtered, sorted and limited listing."""
    return files.listed(_jobs(spark, folder), F.col("status") == "published", [F.desc("updated"), F.col("id"), F.col("version")], 40, ["id", "version"])


def encoded_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles through base64 and JSON, as file services answer, and back."""
    body = F.base64(F.encode(F.to_json(F.struct("title", "owner")), "UTF-8"))
    return table(spark, folder, "aw_tasks").select("id", files.encoded_json(body, "title string, owner string", "{}").alias("v")).select("id", "v.title", "v.owner")


def failure_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Failure events of two shapes as one; here a task's own title stands for what the execution says, its other one for the trigger."""
    part = lambda c: F.struct(F.col(c).alias("workflow"), F.col("owner").alias("node"), F.col("status").alias("message"))
    rows = table(spark, folder, "aw_tasks").select("id", part("manual_title").alias("execution"), part("title").alias("trigger"))
    return files.failures(rows).select("id", "workflow", "node", "message")


def rewrite_rules(spark: SparkSession, folder: str) -> DataFrame:
    return lists.rewrite_rules(table(spark, folder, "doc_pages").select("url", "relative_path").distinct(), "url", "relative_path")


def redirect_text(spark: SparkSession, folder: str) -> DataFrame:
    rules = table(spark, folder, "region").select("r_regionkey", F.concat(F.lit("/"), F.lower("r_name"), F.lit("/*")).alias("source"), F.concat(F.lit("/regions/"), F.col("r_regionkey").cast("string")).alias("destination"))
    return checks.redirect_lines(rules, "r_regionkey")


def deletion_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Pages to delete so that only those with a document stay."""
    return sinks.deletions(table(spark, folder, "doc_pages").select("url").distinct(), "url", table(spark, folder, "documents").where("url IS NOT NULL"))


def rewrite_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What writing titles without blanks around them would change."""
    tasks = table(spark, folder, "aw_tasks").select("id", "manual_title")
    return sinks.rewrites(tasks, tasks.withColumn("manual_title", text.blank_to_null(F.col("manual_title"))), "id", "manual_title")


def segment_folders(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat_ws("/", "category", F.concat("page_id", F.lit(".segments")), F.lit("a.segments/b.rsc"))
    return table(spark, folder, "doc_pages").select("page_id", paths.segment_folder(path).alias("folder"))


def jobs_with_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Every job with its task's title; a job without its task is an error."""
    tasks = table(spark, folder, "aw_tasks").select(F.col("id").alias("task"), "title")
    return relational.required(_jobs(spark, folder).select("id", "version", "task"), tasks, ["task"], "a task").select("id", "version", "title")


def owned_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The jobs that the first owner may see."""
    jobs = _jobs(spark, folder)
    return checks.owned(jobs, "owner", jobs.agg(F.min("owner")).first()[0]).select("id", "version")


def signed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a signed address is for the file that was asked for; here those of even versions are."""
    kind = F.lit("md")
    asked = checks.blob_key(F.col("task"), F.col("version"), F.col("id"), kind)
    given = F.when(F.col("version") % 2 == 0, asked).otherwise(F.concat(asked, F.lit("x")))
    ok = checks.signed(asked, checks.content_type(kind), given, checks.content_type(kind), F.lit("https://files.example/x"), F.col("updated").cast("string"))
    return _jobs(spark, folder).select("id", "version", ok.alias("ok"))


def missing_settings(spark: SparkSession, folder: str) -> DataFrame:
    settings = F.create_map(F.lit("title"), F.col("title"), F.lit("status"), F.col("status"), F.lit("manual_title"), F.col("manual_title"))
    return table(spark, folder, "aw_tasks").select("id", F.array_join(checks.missing_keys(settings, ("title", "status", "manual_title", "secret")), ",").alias("missing"))


def weak_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Owners are long enough to be a secret or not."""
    return table(spark, folder, "aw_tasks").select("id", checks.strong_secret(F.col("manual_title")).alias("strong"))


def bearer_tokens(spark: SparkSession, folder: str) -> DataFrame:
    header = F.concat(F.when(F.col("delivery_id") % 3 == 0, "Basic ").otherwise(" Bearer  "), F.col("owner_id"))
    return table(spark, folder, "task_enrich_events").select("delivery_id", checks.bearer_token(header).alias("token"))


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """The owner of an authenticated record: of the right collection and with a proper id."""
    named = F.when(F.col("version") % 5 == 0, "others").otherwise("aw_clients")
    return _jobs(spark, folder).select("id", "version", checks.account(named, F.col("owner"), "aw_clients").alias("account"))


def answers_ok(spark: SparkSession, folder: str) -> DataFrame:
    error, code = F.when(F.col("status") == "failed", "broken"), F.when(F.col("version") % 2 == 0, F.col("version") % 5 * 100 + 100)
    return _jobs(spark, folder).select("id", "version", checks.response_ok(error, code, F.col("status") == "published").alias("ok"))


def limits_kept(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "aw_tasks").select("id", checks.limits({"title": (1, 14), "manual_title": (0, 10)}).alias("kept"))


def defaulted_titles(spark: SparkSession, folder: str) -> DataFrame:
    return checks.with_defaults(table(spark, folder, "aw_tasks").select("id", "title", "manual_title"), {"manual_title": F.col("title")}).select("id", "manual_title")


def titles_looked_up(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs with the own title of their task; those without one are left out."""
    titles = table(spark, folder, "aw_tasks").select(F.col("id").alias("task"), text.blank_to_null(F.col("manual_title")).alias("label"))
    return relational.looked_up(_jobs(spark, folder).select("id", "version", "task"), titles, ["task"], "label").select("id", "version", "label")


def pages_with_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each url of a page with how many documents it has, 0 without one."""
    count = table(spark, folder, "documents").where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n"))
    return relational.with_default(table(spark, folder, "doc_pages").select("url").distinct(), count, ["url"], "n", F.lit(0))


def shared_urls(spark: SparkSession, folder: str) -> DataFrame:
    return footprint.shared_paths(table(spark, folder, "doc_pages").select("page_id", "url"), table(spark, folder, "documents").where("url IS NOT NULL"), "url").select("page_id")


def zipped_words(spark: SparkSession, folder: str) -> DataFrame:
    """The words of titles beside their lengths, paired by position."""
    words = F.split("title", " ")
    rows = table(spark, folder, "aw_tasks").where("title IS NOT NULL").select("id", F.posexplode(relational.zipped(words, F.transform(words, lambda w: F.length(w)))).alias("i", "z"))
    return rows.select("id", F.col("i").cast("bigint").alias("i"), F.col("z.left").alias("word"), F.col("z.right").cast("bigint").alias("n"))


def job_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a job belongs to the owner of its task: the chain of keys compared, not only followed."""
    tasks = table(spark, folder, "aw_tasks").select(F.col("id").alias("task"), F.col("owner").alias("task_owner"))
    return _jobs(spark, folder).join(tasks, "task").select("id", "version", F.coalesce(F.col("owner") == F.col("task_owner"), F.lit(False)).alias("same"))


def bucket_report(spark: SparkSession, folder: str) -> DataFrame:
    """The 30 largest groups of documents by bytes: a report."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL").withColumn("size", F.octet_length("text").cast("bigint"))
    return footprint.largest(footprint.buckets(rows, F.col("source")), 30, "bytes", "bucket")


def tree_positions(spark: SparkSession, folder: str) -> DataFrame:
    index = F.when(F.col("version") % 3 == 0, "none").otherwise(F.col("version").cast("string"))
    return _jobs(spark, folder).select("id", "version", trees.position(index).alias("position"))


def emit_order(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of regions, nations and customers in the order in which a tree is written: a region, then for each nation its customers, then it."""
    region, nation, customer = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    middle = nation.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"))
    return trees.emit_order(region.select(F.col("r_regionkey").alias("r")), middle, customer.select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("c")).join(middle, "n"), ["r", "n", "c"])


def rendered_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL AND url IS NOT NULL").select("doc_id", text.render_markdown(F.col("source"), F.col("url"), F.col("text")).alias("page"))


def module_titles(spark: SparkSession, folder: str) -> DataFrame:
    title = F.concat(F.lit("线性代数 模块 "), F.col("version").cast("string"), F.lit("："), F.col("task"))
    return _jobs(spark, folder).select("id", "version", lists.short_module_title(F.when(F.col("version") % 2 == 0, title).otherwise(F.col("task"))).alias("title"))


def error_messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "aw_tasks").select("id", text.error_message(F.col("manual_title"), F.concat("status", F.lit("\nat line 1")), "failed").alias("message"))


def encoded_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "doc_pages").select("page_id", paths.encode_parts(F.col("relative_path")).alias("path"))


def source_sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text IS NOT NULL").groupBy("source").agg(F.sum(F.octet_length("text")).alias("n"))
    return rows.select("source", text.mebibytes(F.col("n")).alias("size"))


def _written(spark: SparkSession, folder: str) -> str:
    """Nations as Markdown files with front matter, and a note beside them, in a folder of their own."""
    target = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    remove_at_exit(spark, target)
    rows = table(spark, folder, "nation")
    page = F.concat(F.lit("---\ntitle: \""), F.col("n_name"), F.lit("\"\nregion: "), F.col("n_regionkey").cast("string"), F.lit("\n---\n# "), F.col("n_name"), F.lit("\n"))
    pages = rows.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ".md").otherwise(".MDX")).alias("file_name"), page.alias("content"))
    notes = rows.select(F.concat(F.lit("notes/"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("file_name"), F.col("n_name").alias("content"))
    sinks.write_files(pages.unionByName(notes), target).collect()  # one row a file, 50 of them
    return target


def scanned_pages(spark: SparkSession, folder: str) -> DataFrame:
    return files.markdown_files(spark, _written(spark, folder))


def scanned_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return files.file_stats(spark, _written(spark, folder)).select("relative_path", "size")


def scanned_digests(spark: SparkSession, folder: str) -> DataFrame:
    return files.file_digests(spark, _written(spark, folder), 20).select("relative_path", "sha256")


def loaded_collection(spark: SparkSession, folder: str) -> DataFrame:
    """The files as documents with typed front matter and the rules that they break."""
    rows = files.collection(scanned_pages(spark, folder), {"region": "int"}, {"far": F.col("region") < 3, "titled": F.col("title").isNotNull()})
    return rows.select("relative_path", "title", "region", F.array_join("problems", ",").alias("problems"))


def written_again(spark: SparkSession, folder: str) -> DataFrame:
    """Files written a second time: none is new."""
    target = _written(spark, folder)
    rows = table(spark, folder, "nation").select(F.concat(F.lit("notes/"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("file_name"), F.col("n_name").alias("content"))
    return write_shared(sinks.write_files(rows, target), "written")


_N = """WITH f AS (SELECT 'r' || n_regionkey || '/' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.md' ELSE '.MDX' END AS relative_path, n_name, n_regionkey, '---' || chr(10) || 'title: "' || n_name || '"' || chr(10) || 'region: ' || n_regionkey || chr(10) || '---' || chr(10) || '# ' || n_name || chr(10) AS content FROM nation),
g AS (SELECT relative_path, content FROM f UNION ALL SELECT 'notes/' || n_nationkey || '.txt', n_name FROM nation) """
_J = "(SELECT DISTINCT id, owner, task, version, status, updated FROM publish_jobs)"
_BLANKS = r"'^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g'"
QUERIES = {
    f.__name__: f
    for f in (
        jobs_looked_up, jobs_listed, encoded_titles, failure_parts, rewrite_rules, redirect_text, deletion_plan, rewrite_plan, segment_folders, jobs_with_tasks, owned_jobs, signed_answers, missing_settings, weak_secrets, bearer_tokens, accounts,
        answers_ok, limits_kept, defaulted_titles, titles_looked_up, pages_with_text, shared_urls, zipped_words, job_identity, bucket_report, tree_positions, emit_order, rendered_pages, module_titles, error_messages, encoded_paths, source_sizes,
        scanned_pages, scanned_sizes, scanned_digests, loaded_collection, written_again,
    )
}
SQL = {
    "jobs_looked_up": f"SELECT id, task, version FROM {_J} WHERE task IN (SELECT id FROM aw_tasks WHERE trim(manual_title) <> '')",
    "jobs_listed": f"SELECT id, version FROM {_J} WHERE status = 'published' ORDER BY updated DESC NULLS LAST, id, version LIMIT 40",
    "encoded_titles": "SELECT id, title, owner FROM aw_tasks",
    "failure_parts": "SELECT id, coalesce(nullif(trim(manual_title), ''), nullif(trim(title), '')) AS workflow, nullif(trim(owner), '') AS node, nullif(trim(status), '') AS message FROM aw_tasks",
    "rewrite_rules": "SELECT json_object('source', url, 'destination', relative_path)::VARCHAR AS json FROM (SELECT DISTINCT url, relative_path FROM doc_pages)",
    "redirect_text": "SELECT string_agg('/' || lower(r_name) || '/* /regions/' || r_regionkey || ' 200', chr(10) ORDER BY r_regionkey) || chr(10) AS text FROM region",
    "deletion_plan": "SELECT DISTINCT url FROM doc_pages WHERE url NOT IN (SELECT url FROM documents WHERE url IS NOT NULL)",
    "rewrite_plan": f"SELECT id, manual_title AS old, nullif(regexp_replace(manual_title, {_BLANKS}), '') AS new FROM aw_tasks WHERE manual_title IS DISTINCT FROM nullif(regexp_replace(manual_title, {_BLANKS}), '')",
    "segment_folders": "SELECT page_id, category || '/' || page_id || '.segments' AS folder FROM doc_pages",
    "jobs_with_tasks": f"SELECT j.id, version, title FROM {_J} j JOIN aw_tasks t ON t.id = task",
    "owned_jobs": f"SELECT id, version FROM {_J} WHERE owner = (SELECT min(owner) FROM publish_jobs)",
    "signed_answers": f"SELECT id, version, coalesce(version % 2 = 0 AND updated IS NOT NULL AND task IS NOT NULL AND id IS NOT NULL, false) AS ok FROM {_J}",
    "missing_settings": "SELECT id, concat_ws(',', CASE WHEN trim(coalesce(title, '')) = '' THEN 'title' END, CASE WHEN trim(coalesce(status, '')) = '' THEN 'status' END, CASE WHEN trim(coalesce(manual_title, '')) = '' THEN 'manual_title' END, 'secret') AS missing FROM aw_tasks",
    "weak_secrets": "SELECT id, coalesce(length(manual_title) >= 16, false) AS strong FROM aw_tasks",
    "bearer_tokens": r"SELECT delivery_id, CASE WHEN delivery_id % 3 <> 0 AND regexp_full_match(owner_id, '\S+') THEN owner_id END AS token FROM task_enrich_events",
    "accounts": f"SELECT id, version, CASE WHEN version % 5 <> 0 AND regexp_full_match(owner, '[a-z0-9]{{15}}') THEN owner END AS account FROM {_J}",
    "answers_ok": f"SELECT id, version, coalesce(coalesce(status, '') <> 'failed' AND CASE WHEN version % 2 = 0 THEN version % 5 * 100 + 100 BETWEEN 200 AND 299 ELSE status = 'published' END, false) AS ok FROM {_J}",
    "limits_kept": "SELECT id, length(coalesce(title, '')) BETWEEN 1 AND 14 AND length(coalesce(manual_title, '')) <= 10 AS kept FROM aw_tasks",
    "defaulted_titles": "SELECT id, coalesce(nullif(manual_title, ''), title) AS manual_title FROM aw_tasks",
    "titles_looked_up": f"SELECT j.id, version, nullif(regexp_replace(manual_title, {_BLANKS}), '') AS label FROM {_J} j JOIN aw_tasks t ON t.id = task WHERE nullif(regexp_replace(manual_title, {_BLANKS}), '') IS NOT NULL",
    "pages_with_text": "SELECT url, coalesce(n, 0) AS n FROM (SELECT DISTINCT url FROM doc_pages) LEFT JOIN (SELECT url, count(*) AS n FROM documents WHERE url IS NOT NULL GROUP BY url) USING (url)",
    "shared_urls": "SELECT page_id FROM doc_pages WHERE url IN (SELECT url FROM documents)",
    "zipped_words": "SELECT id, i - 1 AS i, w[i] AS word, length(w[i])::BIGINT AS n FROM (SELECT id, string_split(title, ' ') AS w FROM aw_tasks WHERE title IS NOT NULL), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)",
    "job_identity": f"SELECT j.id, version, coalesce(j.owner = t.owner, false) AS same FROM {_J} j JOIN aw_tasks t ON t.id = task",
    "bucket_report": "SELECT source AS bucket, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL GROUP BY source ORDER BY bytes DESC, bucket LIMIT 30",
    "tree_positions": f"SELECT id, version, CASE WHEN version % 3 = 0 THEN 0.0::DOUBLE ELSE coalesce(version::DOUBLE, 0.0) END AS position FROM {_J}",
    "emit_order": "WITH a AS (SELECT r_regionkey::BIGINT AS r, NULL::BIGINT AS n, NULL::BIGINT AS c FROM region UNION ALL SELECT n_regionkey, n_nationkey, NULL FROM nation UNION ALL SELECT n_regionkey, n_nationkey, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT r, n, c, row_number() OVER (ORDER BY r, n NULLS FIRST, c NULLS LAST) - 1 AS ordinal FROM a",
    "rendered_pages": r"SELECT doc_id, '# ' || source || ' (' || url || ')' || chr(10) || chr(10) || regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') || chr(10) AS page FROM documents WHERE text IS NOT NULL AND url IS NOT NULL",
    "module_titles": f"SELECT id, version, CASE WHEN version % 2 = 0 THEN '模块' || version || '：' || task ELSE task END AS title FROM {_J}",
    "error_messages": f"SELECT id, coalesce(nullif(regexp_replace(manual_title, {_BLANKS}), ''), nullif(regexp_replace(status, {_BLANKS}), ''), 'failed') AS message FROM aw_tasks",
    "encoded_paths": "SELECT page_id, array_to_string(list_transform(string_split(relative_path, '/'), lambda p: url_encode(p)), '/') AS path FROM doc_pages",
    "source_sizes": "SELECT source, printf('%.2f MiB', sum(strlen(text)) / 1048576.0) AS size FROM documents WHERE text IS NOT NULL GROUP BY source",
    "scanned_pages": _N + "SELECT relative_path, content FROM f",
    "scanned_sizes": _N + "SELECT relative_path, strlen(content)::BIGINT AS size FROM g",
    "scanned_digests": _N + "SELECT relative_path, sha256(content) AS sha256 FROM g WHERE strlen(content) >= 20",
    "loaded_collection": _N + "SELECT relative_path, n_name AS title, n_regionkey::INT AS region, CASE WHEN n_regionkey < 3 THEN '' ELSE 'far' END AS problems FROM f",
    "written_again": "SELECT 'notes/' || n_nationkey || '.txt' AS name, strlen(n_name)::BIGINT AS size, false AS written FROM nation",
}
