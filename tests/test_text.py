import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import checks, hashing, markdown, paths, text
from millrace.operators.bloom_index import hash_tokens


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


def test_search_text(spark):
    source = "特征值 $$\\frac{1}{2}$$ 与 https://example.com/x 的　关系 `a` \\text{若} \\alpha[b] ```x\ny``` ﬁn"
    assert one(spark, source, text.search_text) == "特征值 与 的 关系 `a` 若 fin"
    assert [one(spark, v, text.search_text) for v in (None, "", "a", "。。", "ab")] == ["", "", "", "", "ab"]


@pytest.mark.parametrize(("source", "tokens"), [
    ("特征值", ["c2:特征", "c2:征值", "cw:特征值"]),
    ("pipeline", ["w:pipeline", "g:pip", "g:ipe", "g:pel", "g:eli", "g:lin", "g:ine"]),
    ("abc中文 中文abc", ["w:abc中文", "g:abc", "g:bc中", "g:c中文", "c2:中文", "cw:中文", "w:abc"]),
    ("一", ["c:一"]), ("a", []), ("abc", ["w:abc"]), ("ＡＢＣ", ["w:abc"]), ("", []), (None, []), ("一二三四五六七八九", [f"c2:{a}{b}" for a, b in zip("一二三四五六七八", "二三四五六七八九", strict=True)]),
])
def test_routing_tokens(spark, source, tokens):
    assert one(spark, source, text.routing_tokens) == tokens


def python_hashes(value):
    raw = value.encode("utf-16-le")
    a, b = 0x811C9DC5, 0x9E3779B9
    for c in (int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)):
        a = (a ^ c) * 0x01000193 % 2**32
        b = (b ^ c) * 0x85EBCA6B % 2**32
        b ^= b >> 13
    return a, b | 1


def test_hashes(spark):
    values = ["w:pipeline", "", "c2:特征", "𠮷a", "x" * 500, "￿"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", hashing.fnv32(F.col("v")), hashing.mixed32(F.col("v"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {v: python_hashes(v) for v in values}
    assert python_hashes("w:pipeline") == (3194441474, 3956717473)
    a, b = hash_tokens(values)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [python_hashes(v) for v in values] and len(hash_tokens([])[0]) == 0
    digits = df.select("v", *hashing.fnv_quarters(F.col("v"), ["0:", "11:"])).collect()
    assert all((r[1], r[2]) == (python_hashes("0:" + r[0])[0] & 3, python_hashes("11:" + r[0])[0] & 3) for r in digits)
    assert one(spark, 1700, lambda v: hashing.bloom_size(v, 16384, 65536), "int") == 32768
    assert [one(spark, n, lambda v: hashing.bloom_size(v, 16384, 65536), "int") for n in (0, 1638, 1639, 99999)] == [16384, 16384, 32768, 65536]


@pytest.mark.parametrize(("path", "url", "output", "scope"), [
    ("index.md", "/docs", "docs.md", ("root", "root")),
    ("math/index.mdx", "/docs/math", "docs/math.md", ("math", "math")),
    ("math/example.mdx", "/docs/math/example", "docs/math/example.md", ("math", "math/example")),
    ("408/computer-networks/01-network.md", "/docs/408/computer-networks/01-network", "docs/408/computer-networks/01-network.md", ("408", "408/computer-networks")),
    ("math\\advanced-mathematics\\Index.mdx", "/docs/math/advanced-mathematics", "docs/math/advanced-mathematics.md", ("math", "math/advanced-mathematics")),
])
def test_paths(spark, path, url, output, scope):
    assert one(spark, path, paths.page_url) == url and one(spark, path, paths.markdown_path) == output
    assert tuple(one(spark, path, paths.scope)) == scope


def test_path_parts(spark):
    assert [one(spark, p, paths.top_area) for p in ("_next/static/x", "_next/y", "docs/a", "x/y", "x")] == ["_next/static", "_next/other", "docs", "x", "(root)"]
    assert [one(spark, p, paths.extension) for p in ("a/b.TXT", "a.b/c", ".env")] == [".txt", "(none)", "(none)"]
    assert [one(spark, p, paths.file_segment) for p in ("Math/A b", "。", "")] == ["math-a-b", "root", "root"]
    assert [one(spark, p, paths.segment_folder) for p in ("a/b.segments/c.txt", "a/b/c.txt", "x.segments")] == ["a/b.segments", None, "x.segments"]
    assert one(spark, "a b/c+d/中", paths.encode_parts) == "a%20b/c%2Bd/%E4%B8%AD"
    assert [one(spark, p, lambda v: paths.under(v, ("app/api", "app/x"))) for p in ("app/api", "app/api/y", "app/apix")] == [True, True, False]


MDX = 'import A from "a";\nexport const x = {\n  y: [1,\n  2],\n};\n# T\n<Demo a="b" />\n```js\nimport kept\n```\nend'


def test_markdown(spark):
    assert one(spark, MDX, markdown.strip_mdx) == "# T\n```js\nimport kept\n```\nend"
    assert one(spark, None, markdown.strip_mdx) == ""
    source = "# 一、甲\n### 1. 乙\n#### 丙\n```\n# 一、x\n~~~\n```\n## 2.1 丁\n##  （3）戊\n##无"
    leveled = one(spark, source, markdown.level_headings)
    assert leveled.text == "## 一、甲\n### 1. 乙\n### 丙\n```\n# 一、x\n~~~\n```\n### 2.1 丁\n###  （3）戊\n##无" and leveled.changed == 4
    plain = one(spark, "# A\n## 1. B", markdown.level_headings)
    assert plain.text == "## A\n## 1. B" and plain.changed == 1
    dirty = '﻿---\ntitle: x\n---\nimport y\n<script src="a">hi</script> <b>ok</b> [l](javascript:alert(1))\n```\n<script>\n```\r\n'
    assert one(spark, dirty, lambda v: markdown.publishable(v, F.lit("T"))) == "# T\n\nhi &lt;b&gt;ok&lt;/b&gt; [l](#))\n```\n<script>\n```\n"
    assert one(spark, "# " + "x" * (1 << 20), lambda v: markdown.publishable(v, F.lit("T"))) is None
    assert one(spark, 'a"b', lambda v: markdown.index_page(v, F.lit(""), "Parts", F.array(F.lit("p"), F.lit("q")))) == '---\ntitle: "a\\"b"\ndescription: "a\\"b"\n---\n\n# a"b\n\n## Parts\n\n- p\n- q\n'


def test_frontmatter_and_titles(spark):
    source = "---\r\ntitle: \"A: b\"\ndescription:\n---\nbody\n---\n"
    head, body = text.split_frontmatter(F.lit(source))
    r = spark.range(1).select(text.frontmatter_value(head, "title").alias("t"), text.frontmatter_value(head, "description").alias("d"), body.alias("b")).first()
    assert (r.t, r.d, r.b) == ("A: b", None, "body\n---\n")
    titles = spark.createDataFrame([(" m ", "a"), ("", "a"), (None, " ")], "m string, a string").select(text.display_title(F.col("m"), F.col("a"), F.lit("f")).alias("t"))
    assert [x.t for x in titles.collect()] == ["m", "a", "f"]
    assert one(spark, [" a ", "", None, *["b" * 70] * 9], text.clean_tags, "array<string>") == ["a", *["b" * 64] * 7]
    assert one(spark, "x\n# H 1\n# H2", text.first_heading) == "H 1"
    c = one(spark, 90061, text.countdown, "int")
    assert tuple(c) == (1, 1, 1, 1) and tuple(one(spark, -5, text.countdown, "int")) == (0, 0, 0, 0)
    assert unicodedata.normalize("NFKC", "ﬁ①") == one(spark, "ﬁ①", text.nfkc) and re.fullmatch(r"1\.50 MiB", one(spark, 1572864, text.mebibytes, "int"))


def test_checks(spark):
    valid = spark.createDataFrame([("task12345678901", "msg123456789012", 3, "pdf"), ("../private", "msg123456789012", 3, "pdf"), ("task12345678901", "msg-1", 3, "md"), ("task12345678901", "msg123456789012", 0, "md"), ("task12345678901", "msg123456789012", 3, "html"), (None, None, None, None)], "t string, m string, v int, k string")
    got = valid.select(checks.artifact(*[F.col(c) for c in "tmvk"]).alias("ok"), checks.blob_key(*[F.col(c) for c in ("t", "v", "m", "k")]).alias("key")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False, False]
    assert got[0].key == "documents/tasks/task12345678901/v3/messages/msg123456789012/document.pdf"
    assert [one(spark, u, checks.service_url) for u in ("https://a.example/x", "http://localhost:1/", "http://a.example", "https://u:p@a.example", "https://a.example?q=1", "https://a.example#f", "nope", None)] == [True, True, False, False, False, False, False, False]
    assert [one(spark, h, checks.bearer_token) for h in ("Bearer  abc ", "Basic x", None, "Bearer " + "x" * 20_000)] == ["abc", None, None, None]
    assert one(spark, {"a": "x", "b": " "}, lambda m: checks.missing_keys(m, ("a", "b", "c")), "map<string,string>") == ["b", "c"]
    rules = spark.createDataFrame([(2, "/b/*", "/c"), (1, "/a", "/x")], "o int, source string, destination string")
    assert checks.redirect_lines(rules, "o").first().text == "/a /x 200\n/b/* /c 200\n"
    for bad in ([(1, "/a/*/*", "/x")], [(1, "a", "/x")], [(i, "/a", "/x") for i in range(101)], [(1, None, "/x")]):
        with pytest.raises(Exception):
            checks.redirect_lines(spark.createDataFrame(bad, "o int, source string, destination string"), "o").collect()


def test_small_checks(spark):
    df = spark.createDataFrame([(None, 200, False, "ab", ""), (None, None, True, None, "x"), ("e", 200, True, "abcd", None), (None, 404, True, "", "y")], "error string, status int, has_id boolean, a string, owner string")
    assert [r[0] for r in df.select(checks.response_ok(F.col("error"), F.col("status"), F.col("has_id"))).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(checks.limits({"a": (0, 3), "owner": (0, 1)})).collect()] == [True, True, False, True]
    assert [r.owner for r in checks.with_defaults(df, {"owner": F.lit("d")}).collect()] == ["d", "x", "d", "y"]
    assert checks.owned(df, "owner", "x").count() == 1
    assert one(spark, "body ", lambda v: text.render_markdown(F.lit("T"), F.lit("/u"), v)) == "# T (/u)\n\nbody\n"
    assert [one(spark, m, lambda v: text.error_message(v, F.lit("first\nsecond"), "d")) for m in (" ", "m")] == ["first", "m"]
