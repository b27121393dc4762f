"""Keyed queries take all rows of their tables."""

import datetime as dt

from millrace.plans import keyed

JOB = "id string, owner string, task string, version int, source_checksum string, status string, updated timestamp"


def at(day):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day)


def test_all_jobs_merge(spark, tmp_path):
    """A hot task of 300 versions, most of them published, beside a small one; a null status, a repeated row, a tie."""
    rows = [(f"h{v}", "o", "hot", v, "c", "published" if v % 3 else "failed", at(v)) for v in range(1, 301)]
    rows += [("h250b", "o", "hot", 250, "c", "published", at(500)), ("h250c", "o", "hot", 250, "c", "building", at(600)), ("h300b", "o", "hot", 300, "c", None, at(1))]
    rows += [rows[2], ("s1", "o", "small", 1, "c", "queued", at(1)), ("s2", "o", "small", 2, "c", "published", at(1)), ("s3", "o", "small", 2, "c", "published", at(1))]
    spark.createDataFrame(rows, JOB).write.parquet(f"{tmp_path}/publish_jobs.parquet")
    want = set()
    for key in {(r[2], r[3]) for r in rows}:
        own = [r for r in rows if (r[2], r[3]) == key]
        done = [r for r in own if r[5] == "published"]
        want |= {(*key, r[0], r[5]) for r in ([max(done, key=lambda r: (r[6], r[0]))] if done else own)}
    got = [(r.task, r.version, r.id, r.status) for r in keyed.merged_jobs(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and sum(t == "hot" for t, *_ in got) == 301


def test_lists_behind_a_hot_url(spark, tmp_path):
    """A url exported 150 times is the newest and the first by title; the 40 others of its category still fill the list."""
    rows = [(i, "math", "/hot", at(1000 + i), "a") for i in range(150)] + [(200 + i, "math", f"/p{i}", at(i), f"b{i:02}") for i in range(40)] + [(900, "408", "/one", at(1), "x")]
    spark.createDataFrame(rows, "page_id long, category string, url string, updated timestamp, title string").write.parquet(f"{tmp_path}/doc_pages.parquet")
    own = [r for r in rows if r[1] == "math"]
    lists = [sorted(own, key=lambda r: (-r[3].timestamp(), r[0])), sorted(own, key=lambda r: (r[4], r[0]))]
    want = list(dict.fromkeys(r[2] for turn in zip(*lists, strict=True) for r in turn))[:36]
    got = sorted((r.category, r.merged_rank, r.url) for r in keyed.merged_lists(spark, str(tmp_path)).collect())
    assert [u for c, _, u in got if c == "math"] == want and len(want) == 36 and got[0] == ("408", 1, "/one")
