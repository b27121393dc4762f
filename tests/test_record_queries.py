"""The registered search of records asks with the title of every page, each query once for all pages whose titles have the same tokens."""

import math
from collections import defaultdict

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F
from test_record_tokens import PAGES, brute_records, folder, groups, tokens  # noqa: F401

from millrace.functions import text
from millrace.operators import bloom_index
from millrace.plans import corpus


def test_every_title_asks(spark, folder):  # noqa: F811
    asked, want = {page[0]: tokens(page[2]) for page in PAGES}, {}
    for q, t in asked.items():
        for g in (g for g, own in groups().items() if t & own):
            own = {r: (url, held) for r, (group, url, held) in brute_records().items() if group == g}
            mean, found = sum(len(held) for _, held in own.values()) / len(own), []
            for r, (url, held) in own.items():
                idf = lambda w: math.log(1 + (len(own) - (n := sum(w in h for _, h in own.values())) + 0.5) / (n + 0.5))  # noqa: B023, E731
                if both := held & t:
                    found.append((-round(sum(idf(w) for w in both) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(held) / mean)), 6), url, r))
            want |= {(q, g, r): (-s, n) for n, (s, _, r) in enumerate(sorted(found)[:10], 1)}
    rows = entry.queries()["record_group_search"](spark, folder).collect()
    got = {(r.query_id, r.page_group, r.record_id): (r.bm25, r.position) for r in rows}
    assert len(rows) == len(got) and 21 in {q for q, _, _ in got}
    assert set(got) == set(want) and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


def test_same_titles_have_same_hits(spark, folder, tmp_path):  # noqa: F811
    pages = spark.read.parquet(f"{folder}/doc_pages.parquet")
    again = pages.where("page_id = 21").drop("page_id").crossJoin(spark.createDataFrame([(3,), (60,), (61,)], "page_id bigint")).withColumns({"url": F.concat("url", "page_id"), "title": F.lit("Vector notes, vector")})
    untitled = pages.where("page_id = 40").withColumns({"page_id": F.lit(62).cast("bigint"), "url": F.lit("/docs/none"), "title": F.lit("!")})
    pages.unionByName(again).unionByName(untitled).write.parquet(f"{tmp_path}/doc_pages.parquet")
    rows, hits = entry.queries()["record_group_search"](spark, str(tmp_path)).collect(), defaultdict(set)
    for r in rows:
        hits[r.query_id].add((r.page_group, r.record_id, r.bm25, r.position))
    assert len(rows) == sum(map(len, hits.values()))
    assert set(hits) == {3, 20, 21, 40, 60, 61}  # nothing has the words of the title of 19
    assert hits[3] == hits[21] == hits[60] == hits[61]
    some = defaultdict(set)
    for r in corpus.record_group_search(spark, str(tmp_path)).collect():
        some[r.query_id].add((r.page_group, r.record_id, r.bm25, r.position))
    assert some == {q: hits[q] for q in (20, 40, 60)}


@pytest.mark.parametrize("most", [500_000, 3])
def test_shares_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(bloom_index, "ASKED_TOKENS", most)
    asked, held = {1: "ab", 2: "bcd", 3: "x", 4: "d"}, {"one": "abd", "two": "c", "none": "z"}
    rows = lambda own, schema: spark.createDataFrame([(k, t) for k, v in own.items() for t in v], schema)
    got = bloom_index._shares(rows(held, "owner string, token string"), rows(asked, "query_id bigint, token string")).collect()
    want = {(q, o): len(set(t) & set(h)) / len(t) for q, t in asked.items() for o, h in held.items() if set(t) & set(h)}
    assert {(r.query_id, r.owner): r.score for r in got} == want and len(got) == len(want)


def test_each_text_is_stripped_as_alone(spark):
    texts = ["", " a ", "a b", "a\n" + "-" * 9_000 + "\n1", "é", "特征", "٣٤", "$x$ a $$\n$$ b", "```\ncode\n``` ok", "\\frac{a}{b} n", None]
    rows = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)] + [(99, None), (100, [])], "i int, texts array<string>")
    want = rows.select("i", F.when(F.col("texts").isNotNull(), F.transform("texts", text.strip_markup)).alias("t"))
    assert sorted(rows.select("i", text.strip_each(F.col("texts")).alias("t")).collect()) == sorted(want.collect())
