import json
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators.exactly_once import proper
from millrace.sources import files, sinks
from millrace.sources.shared import shared_dir, write_shared
from millrace.streaming import messages


def test_files(spark, tmp_path):
    (tmp_path / "math/中 文").mkdir(parents=True)
    (tmp_path / "math/a.MDX").write_text("---\ntitle: T\nversion: 3\nday: 2026-01-02\n---\nbody\n")
    (tmp_path / "math/中 文/b.md").write_text("no front matter")
    (tmp_path / "math/c.txt").write_text("x" * 50)
    own = files.markdown_files(spark, str(tmp_path))
    assert {r.relative_path: r.content[:3] for r in own.collect()} == {"math/a.MDX": "---", "math/中 文/b.md": "no "}
    assert {r.relative_path: r.size for r in files.file_stats(spark, str(tmp_path)).collect()}["math/c.txt"] == 50
    assert [r.relative_path for r in files.file_digests(spark, str(tmp_path), 50).collect()] == ["math/c.txt"]
    docs = {r.relative_path: r for r in files.collection(own, {"version": "int", "day": "date"}, {"title": F.col("title").isNotNull(), "version": F.col("version") > 0}).collect()}
    assert docs["math/a.MDX"].version == 3 and docs["math/a.MDX"].body == "body\n" and docs["math/a.MDX"].problems == []
    assert docs["math/中 文/b.md"].problems == ["title", "version"]


def test_json(spark, tmp_path):
    for name, rows in (("one", [{"w": "a"}, {"w": "b"}]), ("two", [{"w": "c", "x": 1}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    got = files.json_tables(spark, [str(tmp_path / "two.json"), str(tmp_path / "one.json")], "w string")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("b", 1), ("c", 0)]
    (tmp_path / "m.json").write_text(json.dumps({"version": 4, "mode": "routed", "categories": []}))
    kind = "version int, mode string, categories array<string>"
    assert files.manifest(spark, str(tmp_path / "m.json"), kind, 4, "routed").first().version == 4
    with pytest.raises(Exception, match="expected kind"):
        files.manifest(spark, str(tmp_path / "m.json"), kind, 3, "routed").collect()
    rows = [(1, b'{"a": 1}'), (2, b"\xff\xfe"), (3, b"{"), (4, b'{"a":"' + b"x" * 70_000 + b'"}'), (5, None)]
    bodies = files.json_bodies(spark.createDataFrame(rows, "id int, body binary"), "body", "a int")
    assert {r.id: (r.value.a if r.value else None, r.problem) for r in bodies.collect()} == {1: (1, None), 2: (None, "not UTF-8"), 3: (None, "not JSON"), 4: (None, "too large"), 5: (None, "empty")}
    coded = spark.createDataFrame([("eyJwYWdlcyI6WyJhIl19",), (None,)], "c string").select(files.encoded_json(F.col("c"), "pages array<string>", '{"pages":[]}').alias("v"))
    assert [r.v.pages for r in coded.collect()] == [["a"], []]
    fail = spark.createDataFrame([(("w", " ", None), ("v", "n", "m")), (None, ("v", "n", "m"))], "execution struct<workflow:string,node:string,message:string>, trigger struct<workflow:string,node:string,message:string>")
    assert [(r.workflow, r.node, r.message) for r in files.failures(fail).collect()] == [("w", "n", "m"), ("v", "n", "m")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/x.json", "1"), ("b.json", "中"), ("n.json", None)], "file_name string, content string")
    assert all(r.written for r in sinks.write_files(df, str(tmp_path)).collect())
    assert (tmp_path / "b.json").read_text() == "中" and not any(r.written for r in sinks.write_files(df, str(tmp_path)).collect())
    with pytest.raises(Exception, match="outside"):
        sinks.write_files(spark.createDataFrame([("../y", "1")], df.schema), str(tmp_path)).collect()
    base = f"file://{tmp_path}/table"
    first, new = sinks.commit(df, base)
    assert new and sinks.commit(df.repartition(3).orderBy(F.desc("file_name")), base) == (first, False)
    second, new = sinks.commit(df.unionByName(df), base)
    assert new and second != first and sinks.current(spark, base) == second and spark.read.parquet(second).count() == 6
    assert [r.file_name for r in sinks.deletions(df, "file_name", df.where("content = '1'")).orderBy("file_name").collect()] == ["b.json", "n.json"]
    changed = sinks.rewrites(df, df.withColumn("content", F.upper("content")), "file_name", "content").collect()
    assert changed == []


def test_shared(spark):
    kept = write_shared(spark.range(5), "five")
    assert kept.count() == 5 and shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark)).rstrip("/")


def test_streams(spark, tmp_path):
    schema = "id string, at timestamp, task string, checksum string, version int"
    at = "2026-01-0{} 00:00:00"
    batches = [[("A ", at.format(1), "t", "x", 1), ("b", at.format(1), "u", "y", 1)], [("a", at.format(2), "t", "x", 2), ("c", at.format(2), "t", "z", 3)], [("b", at.format(3), "u", "y", 1)]]
    source, run = tmp_path / "in", uuid.uuid4().hex
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
        assert i < 3
    stream = lambda: messages.file_stream(spark, str(source), spark.read.parquet(str(source)).schema)
    once = messages.run_to_table(messages.once(stream(), proper(F.col("id")), "at", "30 days").select("_key"), f"t1-{run}")
    assert sorted(r[0] for r in once.collect()) == ["a", "b", "c"]
    latest = messages.run_latest(stream().drop("id", "at"), f"file://{tmp_path}/latest", ["task"], [F.col("version"), F.col("checksum")], f"t2-{run}")
    assert sorted((r.task, r.version) for r in latest.collect()) == [("t", 3), ("u", 1)]
    base, own = f"file://{tmp_path}/latest", (["task"], [F.col("version"), F.col("checksum")])
    messages.compact(spark, base, latest.schema, *own)
    assert sinks.exists(spark, f"{base}/base/CURRENT") and sorted((r.task, r.version) for r in messages.read_latest(spark, base, latest.schema, *own).collect()) == [("t", 3), ("u", 1)]
    assert messages.read_latest(spark, f"{base}-none", latest.schema, *own).collect() == []
    numbered = messages.run_to_table(messages.versions(stream(), "task", "checksum", "version"), f"t3-{run}")
    assert sorted((r.task, r.version) for r in numbered.collect()) == [("t", 1), ("t", 2), ("u", 1)]
