"""Token and filter queries over whole records, by brute force: what stands only in a description, a heading or a block counts too."""

import math
import re
from collections import Counter, defaultdict

import pytest

from millrace.operators.bloom_index import may_contain
from millrace.plans import corpus

PAGE = "page_id long, url string, title string, description string, category string, page_group string, structured_data struct<headings:array<struct<id:string,content:string>>,contents:array<struct<content_id:long,heading:string,content:string>>>, updated timestamp"
#: page_id, url, title, description, page_group, heading, block
PAGES = [
    (19, "/docs/a", "stale edition", "withdrawn text", "math/a", "olden", "outdated block"),
    (20, "/docs/a", "matrix notes", "eigenvalue summary", "math/a", "semaphore", "pipeline hazards matrix"),
    (21, "/docs/b", "vector notes", None, "math/a", "matrix", "cache lines"),
    (40, "/docs/c", "pipeline", "about caches", "math/b", "kernel", "notes on 特征值 matrix"),
]


def tokens(text):
    out = set()
    for run in re.findall("[\u4e00-\u9fff]+|[a-z0-9]+", text.lower()):
        if run > "z":
            out |= {f"c2:{run[i : i + 2]}" for i in range(len(run) - 1)} | {f"cw:{run}"}
        else:
            out |= ({f"w:{run}"} if len(run) > 1 else set()) | ({f"g:{run[i : i + 3]}" for i in range(len(run) - 2)} if len(run) > 3 else set())
    return out


def brute_records():
    """record_id: (group, url, tokens) of the core record, the root section and the section of each current page."""
    out = {}
    for i, url, title, description, group, heading, block in PAGES[1:]:
        about = description or ""
        out[f"core:{i}:0:0"] = (group, url, tokens(f"{title} {about} {heading} {title} math {group} math"))
        out[f"body:{i}:0:0"] = (group, url, tokens(f"{title} {about} {title} math math"))
        out[f"body:{i}:1:0"] = (group, f"{url}#h", tokens(f"{heading} {block} {title} {heading} math {title}"))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import datetime as dt

    rows = [(i, url, title, about, "math", group, ([("h", heading)], [(1, "h", block)]), dt.datetime(2026, 1, 1) + dt.timedelta(days=i)) for i, url, title, about, group, heading, block in PAGES]
    path = tmp_path_factory.mktemp("pages")
    spark.createDataFrame(rows, PAGE).write.parquet(f"{path}/doc_pages.parquet")
    return str(path)


def groups():
    out = defaultdict(set)
    for group, _, own in brute_records().values():
        out[group] |= own
    return out


def test_counts_and_sets(spark, folder):
    df = Counter(t for _, _, own in brute_records().values() for t in own)
    assert {r.token: r.df for r in corpus.record_token_df(spark, folder).collect()} == df
    assert {"w:eigenvalue", "w:semaphore", "w:hazards", "c2:特征"} <= set(df) and "w:outdated" not in df
    assert {r.page_group: r.n_tokens for r in corpus.record_token_set_size(spark, folder).collect()} == {g: len(t) for g, t in groups().items()}


def test_filters(spark, folder):
    hashes = {r.token: (r.a, r.b) for r in corpus.record_token_hashes(spark, folder).collect()}
    assert set(hashes) == set().union(*groups().values())
    bits = {(r.page_group, r.bits, r.bit) for r in corpus.record_bloom_bits(spark, folder).collect()}
    assert bits == {(g, 1 << 15, (hashes[t][0] + hashes[t][1] * k) % (1 << 15)) for g, own in groups().items() for t in own for k in range(4)}
    packed = {r.page_group: r for r in corpus.bloom_packed(spark, folder).collect()}
    assert {g: p.tokens for g, p in packed.items()} == {g: len(t) for g, t in groups().items()}
    assert all(may_contain(packed[g].data, packed[g].bits, t) for g, own in groups().items() for t in own)


def test_scores_and_hits(spark, folder):
    asked = {20: tokens("matrix notes"), 40: tokens("pipeline")}
    want = {(q, g): round(len(t & own) / len(t), 9) for q, t in asked.items() for g, own in groups().items() if t & own}
    assert {(r.query_id, r.page_group): r.score for r in corpus.record_bloom_scores(spark, folder).collect()} == want
    ranks = {(r.query_id, r.page_group): r.rank for r in corpus.record_group_rank(spark, folder).collect()}
    assert ranks == {(q, g): n for q in asked for n, g in enumerate(sorted((g for k, g in want if k == q), key=lambda g: (want[(q, g)] < 0.5, -want[(q, g)], g)), 1)}
    hits = {}
    for q, g in want:
        own = {r: (url, t) for r, (group, url, t) in brute_records().items() if group == g}
        mean, found = sum(len(t) for _, t in own.values()) / len(own), []
        for r, (url, t) in own.items():
            idf = lambda w: math.log(1 + (len(own) - (n := sum(w in t for _, t in own.values())) + 0.5) / (n + 0.5))
            if both := t & asked[q]:
                found.append((-round(sum(idf(w) for w in both) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(t) / mean)), 6), url, r))
        hits |= {(q, g, r): (-s, n) for n, (s, _, r) in enumerate(sorted(found)[:10], 1)}
    got = {(r.query_id, r.page_group, r.record_id): (r.bm25, r.position) for r in corpus.record_group_search(spark, folder).collect()}
    assert set(got) == set(hits) and all(got[k][1] == hits[k][1] and abs(got[k][0] - hits[k][0]) < 2e-6 for k in hits)
