from pyspark.sql import functions as F

from millrace.functions import lists
from millrace.operators import relational


def test_lists(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"], "b"), (["a", "a"], ["a"], "c"), (None, None, "x")], "a array<string>, b array<string>, i string")
    got = df.select(lists.with_item(F.col("a"), F.col("i")).alias("w"), lists.same_items(F.col("a"), F.col("b")).alias("s"), lists.merged_order(F.col("b"), F.col("a")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], True, ["b", "a"]), (["a", "a", "c"], False, ["a"]), (["x"], True, None)]


def test_replies(spark):
    replies = ['```json\n{"title": " T ", "slug": "a-b", "tags": [" x ", ""]}\n```', '{"title": "T", "slug": "A B", "summary": " s "}', "no json", '{"title": " "}', None, "[1]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = {r.i: r.m for r in df.select("i", lists.metadata_reply(F.col("r")).alias("m")).collect()}
    assert tuple(got[0]) == ("T", "a-b", "", ["x"]) and tuple(got[1]) == ("T", "document", "s", []) and [got[i] for i in (2, 3, 4, 5)] == [None] * 4


def test_titles_outcomes_rules(spark):
    titles = spark.createDataFrame([("高等数学 模块 3 : 极限",), ("线性代数模块12：秩",), ("政治 模块 1：x",)], "t string")
    assert [r[0] for r in titles.select(lists.short_module_title(F.col("t"))).collect()] == ["模块3：极限", "模块12：秩", "政治 模块 1：x"]
    jobs = spark.createDataFrame([("a", "done", 1), ("a", "done", 1), ("b", "done", 1), ("b", "bad", 1), ("c", None, 90), ("d", "run", 2)], "g string, s string, n int")
    assert {r.g: (r.outcome, r.n_jobs) for r in lists.outcome(jobs, ["g"], "s", "done", "bad", F.col("n"), 90).collect()} == {"a": ("completed", 2), "b": ("failed", 2), "c": ("expired", 1), "d": ("waiting", 1)}
    assert lists.rewrite_rules(spark.createDataFrame([("/a", "/b")], "x string, y string"), "x", "y").first().json == '{"source":"/a","destination":"/b"}'
    assert tuple(relational.unique(jobs, ["g"]).first()) == (6, 4, False) and tuple(relational.unique(jobs.limit(0), ["g"]).first()) == (0, 0, True)
