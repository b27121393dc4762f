from collections import Counter, defaultdict
from itertools import zip_longest

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import routing_tokens
from millrace.operators import bloom_index, cards, footprint, index_build, records, relational, sharding, trees
from millrace.operators.merge import round_robin
from millrace.operators.search import _Asked, rank_categories, rank_shards, routed, search
from millrace.operators.search import build as search_build
from millrace.sources.shared import write_shared

PAGE = "page_id long, url string, relative_path string, title string, description string, category string, page_group string, structured_data struct<headings:array<struct<id:string,content:string>>,contents:array<struct<content_id:long,heading:string,content:string>>>, updated timestamp"


def page(i, heads, blocks, **more):
    own = {"url": f"/docs/p{i}", "title": f"Page {i}", "description": None, "category": "math", "page_group": "math/a"} | more
    data = None if heads is None else ([tuple(h) for h in heads], [(k, *b) for k, b in enumerate(blocks)])
    return (i, own["url"], None, own["title"], own["description"], own["category"], own["page_group"], data, None)


def test_records(spark):
    df = spark.createDataFrame([
        page(1, [("h1", "One"), ("h2", "Two")], [(None, "root text"), ("", "root text"), ("h1", "a b"), ("h3", "orphan part"), ("h1", "a b"), ("h1", None)], description=" d "),
        page(2, None, []), page(3, [], [("h", "x" * 13_000), ("h", "yy zz")], category="root", page_group="root"),
    ], PAGE)
    body = records.body_records(df).orderBy("page_id", "section_no", "chunk_no").collect()
    one = [r for r in body if r.page_id == 1]
    assert [(r.url, r.title, r.content) for r in one] == [("/docs/p1", "Page 1", "root text"), ("/docs/p1#h1", "One", "a b"), ("/docs/p1#h2", "Two", ""), ("/docs/p1#h3", "Page 1", "orphan part")]
    assert [r.description for r in one] == [" d ", None, None, None] and one[0].breadcrumbs == ["math"] and one[1].breadcrumbs == ["Page 1"]
    assert [(r.url, r.content) for r in body if r.page_id == 2] == [("/docs/p2", "")]
    three = [r for r in body if r.page_id == 3]
    assert three[0].breadcrumbs == [] and [len(r.content) for r in three] == [0, 6000, 6000, 1007] and {r.url for r in three[1:]} == {"/docs/p3#h"}
    core = {r.page_id: r for r in records.core_records(df).collect()}
    assert core[1].content == "One · Two" and core[2].content == "" and core[1].keywords == "Page 1 math math/a"


def test_chunks(spark):
    df = spark.createDataFrame([(["aaa", "bb", "cccccccccccc", "d"],), ([],), (None,), ([""],)], "p array<string>")
    got = [r.c for r in df.select(records.greedy_chunks(F.col("p"), 8).alias("c")).collect()]
    assert got == [["aaa\n\nbb", "cccccccc", "cccc\n\nd"], [], None, []]


def test_filters_have_no_false_negatives(spark):
    rows = [(f"o{i % 3}", f"w:word{i * j % 977}") for i in range(300) for j in range(9)] + [("o1", "c2:特征"), ("o1", "𠮷")]
    sets = spark.createDataFrame(rows, "o string, token string").distinct()
    own = bloom_index.filters(sets, ["o"])
    packed = {r.o: r for r in bloom_index.packed(own, ["o"]).collect()}
    assert all(bloom_index.may_contain(packed[o].data, packed[o].bits, t) for o, t in set(rows))
    assert all(len(p.data) * 8 == p.bits for p in packed.values()) and not bloom_index.may_contain(packed["o2"].data, packed["o2"].bits, "w:absent-token")
    asked = spark.createDataFrame([(1, t) for o, t in set(rows) if o == "o0"] + [(2, "w:nothing-like-it"), (3, "c2:特征"), (3, "w:nothing-like-it")], "query_id int, token string")
    score = {(r.query_id, r.o): r.score for r in bloom_index.scores(own, ["o"], asked).collect()}
    assert score[(1, "o0")] == 1.0 and score[(3, "o1")] == 0.5 and not any(q == 2 for q, _ in score)


def test_round_robin(spark):
    lists = {0: "abc", 1: "bd", 2: "", 3: "aae"}
    df = spark.createDataFrame([("q", k, i, u) for k, us in lists.items() for i, u in enumerate(us)], "q string, list_no int, place int, url string")
    want = list(dict.fromkeys(u for turn in zip_longest(*lists.values()) for u in turn if u))
    got = [r.url for r in round_robin(df, ["q"], "list_no", "place", "url", 4).orderBy("merged_rank").collect()]
    assert got == want[:4] == ["a", "b", "d", "c"]
    assert round_robin(df.limit(0), ["q"], "list_no", "place", "url", 4).collect() == []


def check_shards(units, shard_of, target):
    """What shards of one owner must be: each unit's label spells the digits of its hash (x where its part isn't parted, a and b for halves by key
    beyond the levels), a shard keeps the target or has one unit, and what a label's parent holds doesn't."""
    def digit(level, key):
        h = 0x811C9DC5
        for c in f"{level}:{key}":
            h = (h ^ ord(c)) * 0x01000193 % 2**32
        return str(h & 3)

    size, held = dict(units), defaultdict(set)
    if sum(size.values()) <= target or len(size) == 1:
        assert set(shard_of.values()) == {"0"}
        return
    for key, label in shard_of.items():
        for n in range(len(label) + 1):
            held[label[:n]].add(key)
    for key, label in shard_of.items():
        own = held[label]
        assert sum(size[k] for k in own) <= target or len(own) == 1
        assert sum(size[k] for k in held[label[:-1]]) > target and len(held[label[:-1]]) > 1
        for level, letter in enumerate(label):
            together = held[label[:level]]
            if level >= sharding.LEVELS:
                order = sorted(together)
                assert letter == ("a" if order.index(key) < -(-len(order) // 2) else "b")
            else:
                assert letter in (digit(level, key), "x") and (letter == "x") == (len({digit(level, k) for k in together}) == 1)


def test_stable_shards(spark):
    owners = {"g": [(f"/docs/{i}", 100 + i % 37) for i in range(400)], "s": [("/a", 10)], "b": [("/b", 9_999)], "t": [("/c", 3_000), ("/d", 3_000)]}
    df = spark.createDataFrame([(o, k, c) for o, us in owners.items() for k, c in us], "owner string, key string, chars long")
    got = {(r.owner, r.key): r.shard_key for r in sharding.stable_shards(df, 5_000).collect()}
    for owner, units in owners.items():
        check_shards(units, {k: s for (o, k), s in got.items() if o == owner}, 5_000)
    sums = Counter()
    for o, us in owners.items():
        for k, c in us:
            sums[(o, got[(o, k)])] += c
    assert all(v <= 5_000 or list(got.values()).count(s) == 1 or (o, s) == ("b", "0") for (o, s), v in sums.items())
    more = df.unionByName(spark.createDataFrame([("s", "/new", 10)], "owner string, key string, chars long"))
    assert {(r.owner, r.key): r.shard_key for r in sharding.stable_shards(more, 5_000).where("owner != 's'").collect()} == {k: v for k, v in got.items() if k[0] != "s"}
    assert sharding.stable_shards(df.limit(0), 5).collect() == []


def test_parts_and_splits(spark):
    df = spark.createDataFrame([(1, i, 40) for i in range(5)] + [(2, 0, 500), (2, 1, 10)], "page int, no int, chars int")
    got = {(r.page, r.no): r.part for r in sharding.record_parts(df, "page", ["no"], "chars", 100).collect()}
    assert [got[(1, i)] for i in range(5)] == [0, 0, 1, 1, 2] and [got[(2, i)] for i in range(2)] == [0, 1]
    many = spark.createDataFrame([("s", f"k{i}", 10) for i in range(50)] + [("t", "one", 999)], "shard string, k string, size int")
    out = sharding.split_oversized(many, "shard", "size", F.col("k"), ["k"], 100).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b <= 100 or r.n == 1 for r in out) and sum(r.n for r in out) == 51
    same = spark.createDataFrame([("s", "k", i, 10) for i in range(37)], "shard string, k string, no int, size int")
    out = sharding.split_oversized(same, "shard", "size", F.col("k"), ["no"], 50).groupBy("shard").agg(F.sum("size").alias("b"), F.min("no").alias("a"), F.max("no").alias("z"), F.count("*").alias("n")).collect()
    assert all(r.b <= 50 and r.z - r.a == r.n - 1 for r in out) and sum(r.n for r in out) == 37


def test_clean_pages(spark):
    df = spark.createDataFrame([
        page(1, [("h1", "Sum $x$ of https://a.b/c rows"), ("h2", "$y$")], [("h1", "a \\< b and \\alpha text"), ("h2", "$$z$$"), (None, "ｆｕｌｌ width")], title="On $n$ \\(k\\) sums", description="about `x` https://x.y now"),
        page(2, None, [], title=" $q$ "), page(3, [], [], title=None, description="$z$"),
    ], PAGE)
    one, two, three = records.clean_pages(df).orderBy("page_id").collect()
    assert (one.title, one.description) == ("On sums", "about `x` now")
    assert [h.content for h in one.structured_data.headings] == ["Sum of rows"] and [c.content for c in one.structured_data.contents] == ["a < b and text", "full width"]
    assert two.title == "Untitled" and two.structured_data is None and three.title == "Untitled" and three.description is None


def test_oversized_shards_are_parted(spark):
    rows = [page(i, [], [(None, f"words {i} " + "abc " * 500)], page_group="math/a") for i in range(1, 13)]
    df = spark.createDataFrame(rows, PAGE)
    whole = index_build.sharded_records(df).groupBy("shard").count().collect()
    parted = index_build.shard_files(index_build.sharded_records(df, 6_000)).collect()
    assert len(parted) > len(whole) and all(f.bytes <= 6_000 or f.records == 1 for f in parted) and sum(f.records for f in parted) == sum(r["count"] for r in whole)
    assert index_build.sharded_records(df.limit(0)).collect() == []


def test_ranks_of_categories_and_shards(spark):
    """The size term, scopes, modules, and a query without tokens, to which every shard of its categories is open."""
    recs = [("body", f"s{i}", f"c{i % 6}", f"c{i % 6}/g", f"r{i}", f"/{i}", [f"w:word{i % 3}", "w:common"]) for i in range(24)]
    df = spark.createDataFrame(recs, "kind string, shard string, category string, page_group string, record_id string, url string, tokens array<string>")
    sizes = df.select("kind", "shard", "category", "page_group", F.when(F.col("shard") == "s0", 10_000_000).otherwise(100).alias("bytes"))
    queries = spark.createDataFrame([(1, "word0", None, None, None), (2, "", "c1", "c1/g", None), (3, "common", None, None, ["c2", "c3"]), (4, "word0", "c0", "c0/g", None)], "query_id int, text string, scope_category string, scope_group string, allowed array<string>")
    index = search_build(df, sizes)
    given = queries.withColumn("tokens", routing_tokens(F.col("text"))).withColumn("n_tokens", F.size("tokens"))
    asked = _Asked(given.orderBy("query_id").collect())
    kept = rank_categories(routed(index.wide, "category", asked), index.wide, given).collect()
    by = {q: [r.category for r in sorted(kept, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2, 3, 4)}
    assert by[1] == ["c0", "c3", "c1", "c2"] and by[2][0] == "c1" and len(by[2]) == 4 and by[3] == ["c2", "c3"] and by[4][0] == "c0"
    shards = rank_shards(routed(index.narrow, "shard", asked), index.narrow, given, {"body": 9}).collect()
    ranks = {q: [r.shard for r in sorted(shards, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2, 4)}
    assert ranks[1][-1] == "s0" and len(ranks[2]) == 9 and ranks[2][:4] == ["s1", "s13", "s19", "s7"]  # the large shard last; own group first
    assert ranks[4][:4] == ["s12", "s18", "s6", "s0"]


def test_index_and_search(spark):
    words = ["eigenvalue", "semaphore", "特征值", "pipeline", "matrix"]
    rows = [page(i, [("h", f"On {words[i % 5]}")], [(None, f"text {words[i % 5]} number{i}"), ("h", f"part {words[(i + 1) % 5]}")], title=f"{words[i % 5]} notes {i}", category="math" if i % 2 else "408", page_group=f"{'math' if i % 2 else '408'}/g{i % 3}") for i in range(1, 41)]
    df = spark.createDataFrame(rows + [rows[0]], PAGE)
    own = write_shared(index_build.sharded_records(df), "test")
    assert own.where("kind = 'core'").count() == 40 and own.groupBy("record_id").count().where("count > 1").count() == 0
    files = index_build.shard_files(own).collect()
    assert sum(f.records for f in files) == own.count() and all(f.bytes == len(f.json.encode()) and f.file_name.startswith(f.shard) for f in files)
    narrow, wide = index_build.routes(own)
    made = index_build.manifest(40, index_build.shard_files(own), index_build.routers(index_build.shard_files(own), narrow), wide).first().json
    assert '"pages":40' in made and made.count('"category"') == 2
    found = own.select("kind", "shard", "category", F.col("owner").alias("page_group"), "record_id", "url", "chars", routing_tokens(records.record_text()).alias("tokens"))
    shards = found.groupBy("kind", "shard", "category", "page_group").agg(F.sum("chars").alias("bytes"))
    queries = spark.createDataFrame([(1, "特征值", None, None), (2, "number7", "math", "math/g1"), (3, "qqqq", None, None), (4, "", None, None), (5, None, None, None)], "query_id int, text string, scope_category string, scope_group string")
    got = defaultdict(list)
    for r in search(found, shards, queries).orderBy("query_id", "merged_rank").collect():
        got[r.query_id].append(r.url)
    assert set(got) == {1, 2} and "/docs/p7" in got[2] and all(len(set(u)) == len(u) <= 36 for u in got.values())
    assert {u.split("#")[0] for u in got[1]} <= {f"/docs/p{i}" for i in range(1, 41) if i % 5 in (1, 2)}


def test_footprint(spark):
    df = spark.createDataFrame([("a", b"x" * 40, 40), ("b", b"x" * 40, 40), ("c", b"y" * 40, 40), ("d", b"z", 1), ("e", b"z", 1), ("n", None, None)], "name string, content binary, size int")
    [g] = footprint.duplicate_groups(df, F.col("content"), "size", 32).collect()
    assert (g.copies, g.redundant) == (2, 40)
    assert tuple(footprint.total(df, "name").first()) == (6, 122, "a", 40)
    assert tuple(footprint.pruned(df, F.col("size") < 5).first()) == (2, 2) and tuple(footprint.pruned(df.limit(0), F.lit(True)).first()) == (0, 0)
    files = spark.createDataFrame([("p", "index", "1"), ("p", "copy", "1"), ("q", "index", "1"), ("q", "copy", "2"), ("r", "copy", "1"), ("s", "index", "1")], "folder string, name string, sha string")
    assert {r.folder: r.same for r in footprint.copy_check(files, "folder", "name", "sha", "index", "copy").collect()} == {"p": True, "q": False, "r": False}


def test_keyed(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 5, "n")], "k string, v int, s string")
    assert {r.k: (r.v, r.s) for r in relational.latest(df, ["k"], [F.col("v"), F.col("s")]).collect()} == {"a": (2, "y"), "b": (None, "z"), None: (5, "n")}
    assert {r.k: r.next_version for r in relational.next_version(df, ["k"], "v").collect()} == {"a": 3, "b": 1, None: 6}
    old = spark.createDataFrame([("a", 7), ("a", 6), ("c", 9)], "k string, id int")
    assert sorted((r.k or "", r.action, r.target_id) for r in relational.upsert_plan(df.select("k").distinct(), old, ["k"], "id").collect()) == [("", "insert", None), ("a", "update", 6), ("b", "insert", None)]
    swapped = relational.swapped(df, "s", "x", "w").collect()
    assert Counter((r.s, r.swapped) for r in swapped) == Counter([("w", True), ("y", False), ("y", False), ("z", False), ("n", False)])
    merged = relational.merged(df.where("k = 'a'").distinct(), spark.createDataFrame([("a", 3, "q"), ("a", 4, "p"), ("d", 1, "r")], "k string, v int, s string"), ["k"], [F.col("v")])
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 4, "p"), ("d", 1, "r")]


def test_numbers_and_batches(spark):
    df = spark.createDataFrame([(i * 7 % 51, "t") for i in range(51)], "id int, no string").repartition(5)
    out = relational.numbered(df, ["id"], "pos").collect()
    assert sorted((r.id, r.pos) for r in out) == [(i, i) for i in range(51)]
    assert Counter(r.batch for r in relational.batched(df, ["id"], 50).collect()) == {0: 50, 1: 1}
    assert relational.numbered(df.limit(0), ["id"]).collect() == []


def test_ranges_and_pairs(spark):
    points = spark.range(30).withColumnRenamed("id", "pos")
    ranges = spark.createDataFrame([("a", 0, 10), ("b", 10, 25), ("c", 5, 6), ("d", 7, 7), ("e", 28, 99)], "name string, start int, `end` int")
    got = Counter(r.name for r in relational.range_join(points, "pos", ranges, "start", "end", 4).collect())
    assert got == {"a": 10, "b": 15, "c": 1, "e": 2}
    zipped = spark.createDataFrame([([1, 2], ["x", "y"]), (None, ["x"])], "a array<int>, b array<string>")
    assert [r.z for r in zipped.select(relational.zipped(F.col("a"), F.col("b")).alias("z")).collect()] == [[(1, "x"), (2, "y")], None]
    with pytest.raises(Exception, match="different length"):
        spark.createDataFrame([([1], ["x", "y"])], "a array<int>, b array<string>").select(relational.zipped(F.col("a"), F.col("b"))).collect()
    with pytest.raises(Exception, match="page is missing"):
        relational.required(points, points.where("pos > 3").withColumn("x", F.lit(1)), ["pos"], "page").collect()
    one = spark.createDataFrame([("a", 5), ("b", 50)], "id string, age int")
    assert [r.id for r in relational.only_candidate(one, F.col("age") < 60, "id").collect()] == [] and [r.id for r in relational.only_candidate(one, F.col("age") < 10, "id").collect()] == ["a"]


def test_trees(spark):
    acts = spark.createDataFrame([("a1", "e1", "2"), ("a2", "e1", None), ("a3", "e2", "x"), ("a4", "e1", "2")], "id string, event string, idx string")
    messages = spark.createDataFrame([("m1", "a1"), ("m2", "a1"), ("m3", "gone"), ("m4", "a4")], "mid string, act string")
    kept = trees.with_children(acts, messages, "id", "act")
    assert sorted(r.id for r in kept.collect()) == ["a1", "a4"]
    placed = acts.withColumn("p", trees.position(F.col("idx")))
    events = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "ev string")
    got = {r.ev: [a.id for a in r.acts] for r in trees.nested(events, placed, "ev", "event", ["p", "id"], ["id"], "acts").collect()}
    assert got == {"e1": ["a2", "a1", "a4"], "e2": ["a3"], "e3": []}
    lines = trees.summaries(placed, ["event"], F.col("id"), F.lit("s"), ["p", "id"]).where("event = 'e1'").first()
    assert (lines.lines, lines.n_children) == ("- a2: s\n- a1: s\n- a4: s", 3)
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("q", "b")], "parent string, node string")
    roots = spark.createDataFrame([("r",), ("q",)], "root string")
    below = trees.reachable(edges, roots)
    assert sorted(tuple(r) for r in below.collect()) == [("q", "b"), ("q", "q"), ("r", "a"), ("r", "b"), ("r", "r")]
    bad = relational.memberships(spark.createDataFrame([("a",), ("b",), ("z",)], "node string"), below, "node", "root")
    assert sorted((r.node, r.owners, r.owner_names) for r in bad.collect()) == [("b", 2, "q, r"), ("z", 0, "(none)")]
    with pytest.raises(ValueError, match="cycle"):
        trees.reachable(edges.unionByName(spark.createDataFrame([("b", "r")], edges.schema)), roots, 6)


def test_cards(spark):
    rows = [(1, [("g", 6, None), ("h", 2, None)]), (2, [("g", 1, 120.0), ("h", -4, None), ("i", None, float("nan"))]), (3, None), (4, [("g", 0, None)])]
    df = spark.createDataFrame(rows, "card_id long, senses array<struct<gloss:string,count:int,percentage:double>>")
    assert {(r.card_id, r.gloss): r.percentage for r in cards.sense_shares(df).collect()} == {(1, "g"): 75, (1, "h"): 25, (2, "g"): 100, (2, "h"): 0, (2, "i"): 0, (4, "g"): 0}
    words = spark.createDataFrame([(i, f"w{i}", None if i == 3 else f"重要性 {i // 2}") for i in range(6)], "pos int, word string, label string")
    ranges = spark.createDataFrame([("m1", 0, 2), ("m2", 2, 4), ("m3", 4, 9)], "slug string, start int, `end` int")
    own = cards.modules(words, ranges)
    assert sorted((r.slug, r.n, r.first_word, r.last_word, r.importance_range) for r in own.collect()) == [("m1", 2, "w0", "w1", "重要性 0"), ("m2", 2, "w2", "w3", "重要性 1–未标注"), ("m3", 2, "w4", "w5", "重要性 2")]
    assert [r.slug for r in cards.outside(own).collect()] == ["m3"] and cards.gaps(ranges).collect() == []
    assert [r.slug for r in cards.gaps(ranges.where("slug != 'm2'")).collect()] == ["m3"]
    assert [r.t for r in spark.range(8).select(cards.tone(F.col("id")).alias("t")).collect()] == [1, 2, 3, 4, 5, 6, 7, 1]
    assert cards.view(words.withColumn("senses", F.lit(1)).withColumn("phonetic", F.lit(1)), "dictation").columns == ["pos", "label"]
