import random

import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm.residue import BODY, KNOWN, PUBLIC, SLOT, Batch, _batch, _rows, batch_of, fit_batch, passages, residue

KINDS = [f"{a} {b}" for a in ("lazy", "flat", "sparse", "packed") for b in ("matrix", "limit", "buffer", "queue", "tree")]
NOTES = [f"The lesson on the {k} opens with a drawing (Fig. {i}). Most answers lose marks because the {k} is confused with other steps." for i, k in enumerate(KINDS)]
ABOUT = ["Status code 404 tells the client that a resource is missing; both appear in quiz 2.", "The phrase lorem ipsum is used by designers to judge spacing."]
SEEN = [f"# About {k}\n\nThe page you asked for has moved. Please go back to the start page. zan-0{i:02d}ab4" for i, k in enumerate(KINDS[:6])]
SEEN += [f"# The {k}\n\nSign in again to read this lesson." for k in KINDS[:4]]
SEEN += [f"{NOTES[i]}\n\n## {{{{ {k} }}}}\n\n{NOTES[i + 1]}" for i, k in enumerate(("title", "author", "summary", "unit"))]


def judged(texts):
    """Which of the texts are residue, in a corpus of notes and some residue."""
    rows = batch_of([*texts, *NOTES * 20, *[n + "\n\n" + a for n in NOTES for a in ABOUT], *SEEN])
    found = Batch(rows).residue(*fit_batch(rows)).tolist()
    ids = rows.column("doc_id").to_pylist()
    return [any(f for i, f in zip(ids, found, strict=True) if i == n) for n in range(len(texts))]


RESIDUE = [
    "# Title\n\n404 Not Found\n\nThe page you requested has moved.",
    "# Queue\n\nThe page you asked for has moved.",
    "Sign in again to read this.",
    NOTES[0] + "\n\n## {{ title }}\n\n" + NOTES[1],
    NOTES[2] + " ${doc.title} " + NOTES[3],
    NOTES[2] + " <%= author %> " + NOTES[3],
    NOTES[2] + "\n\n{author}\n\n" + NOTES[3],  # of no known template language, but with a name that those hold
    NOTES[2] + "\n\n{{ " + "a rather long name of a value " * 3 + "}}\n\n" + NOTES[3],
    "title: undefined\ndescription: null\n\n# undefined",
    "您需要启用 JavaScript 才能运行此应用。",
    "测试文本" * 30,
    "# 小结\n\n（请在此补充例题）",
    "Dear <your name here>,\n\nthe lesson is ready.",
    "Lorem ipsum dolor ipsum lorem dolor ipsum lorem dolor lorem ipsum dolor sit.",
]


@pytest.fixture(scope="module")
def verdicts():
    return dict(zip(RESIDUE, judged(RESIDUE), strict=True))


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(verdicts, text):
    assert verdicts[text]


def test_notes():
    texts = [
        *NOTES[:3], "# Title", "", "  \n ",
        NOTES[4] + "\n\n" + ABOUT[0] + "\n\n" + ABOUT[1],
        "Use `{{ title }}` here.\n\n```js\nrender('{{ section }}', `${x}`);\n```\n\n" + NOTES[5],
        "The matrix $A_{{2}{j}}$ begins at 1. " + NOTES[6],
        "See [Docs](/docs) and [1] (p. 4). " + NOTES[7],
    ]
    assert judged(texts) == [False] * len(texts)


def test_passages():
    parts, code, body, title = passages("# Queue\n\nPlease go back. zan-00ab45\n\n```\nx = 1\n```\nname: null")
    assert [p.trusted for p in parts if p.role == SLOT] == [False, True] and code > 0 and body is None and title.startswith("# queue")
    parts, _, body, title = passages("# Queue\n\nPlease go back. zan-00ab45")
    assert [p.trusted for p in parts if p.role == BODY] == [True] and body == "please go back. <trace>"


def test_table(spark):
    seen = NOTES * 5 + SEEN
    rows = [(i, t, None) for i, t in enumerate(seen)] + [(900, None, 1), (901, "", 1), (902, "Please enable JavaScript to run this app.", 1), (902, "Please enable JavaScript to run this app.", 1)]
    rows += [(903, "x {{ name }} y " + NOTES[0] * 400, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, again int")
    found = sorted(r.doc_id for r in residue(df, F.col("doc_id"), F.col("text")).collect())
    assert found == [*range(100, 100 + len(SEEN)), 902, 903]
    assert residue(df.limit(0), F.col("doc_id"), F.col("text")).collect() == []


# The messages and filler of the given tables, written down for this test alone: nothing is learnt from them.
MESSAGES = r"""Active JavaScript en su|请打开脚本支持后刷新|您的浏览器已禁用脚本|turn on scripts in your browser|本站需要启用|Please enable JavaScript to view|TODO: write this page|请求过于频繁|has scripting switched off|
表示するには JavaScript|502 Bad Gateway|requires JavaScript and cookies|哎呀，找不到这一页|uncaught exception in render|Coming soon. This page|お探しのページは|Seite nicht gefunden|cannot open this folder|client has been rate limited|您访问的页面不存在|
登录已过期，请重新登录|This is a default page|该文章已下线或正在审核|Verify that you are human|加载失败，点击重试|此页为自动生成的空白模板|网络异常，内容|正文略，稍后补充|Bitte aktivieren Sie|client-side exception|ocurrido un fallo interno|link you followed may be broken|
Access Denied|Something went wrong on our side|内容待补充，敬请期待|服务器繁忙|503 Service Temporarily|page isn't working right now|403 禁止访问|系统内部错误|Internal Server Error|Page not found|アクセスが拒否|Zugriff verweigert|Página no encontrada|Gateway time-out|Session expired|Unable to load|
ipsum lorem|lorem ipsum ipsum|ipsum ipsum|(?m:^Lorem ipsum \w+ \w+ \w+ \w+)|404 Not Found|"code":404|网站维护中|dummy content|(?:测试文本){3}|(?:示例内容){3}|(?:占位文字){3}|(?:测试){6}|(?:sample text ){3}|(?:your text here ){3}|(?:placeholder text ){3}|(?:qwer|asdf|blah|xxx|foo|bar|test) (?:qwer|asdf|blah|xxx|foo|bar|test) (?:qwer|asdf|blah|xxx|foo|bar|test)|ERROR|エラーが発生|エラー""".replace("\n", "")
_CODE = regex.compile(r"^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[^\n]*$|\Z)|`[^`\n]+`|\$\$.*?\$\$|(?<![\\$])\$(?![{$])[^$\n]+\$", regex.S | regex.M)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("text != ''").collect()]
    parsed = [p for d, t in rows for p in _rows(d, t)]
    return dict(rows), parsed


def test_seeds_are_not_in_the_data(documents):
    texts = "\n".join(documents[0].values())
    assert not [s for line in PUBLIC for s in regex.split(r"(?<=[.!?。！？])\s*", line) if len(s) > 3 and s in texts]


def test_any_sample_gives_the_same_records(documents):
    """Precision and recall of models of random samples of 2,000 to 8,000 documents, over all documents."""
    texts, parsed = documents
    short = {d for d, t in texts.items() if len(t) < 700 and regex.search(MESSAGES, t, regex.I)}
    slots = {d for d, t in texts.items() if KNOWN.search(_CODE.sub(" ", t)) or regex.search(r"(?m)^\s*(?:#+|\S+[:：])\s*(?:undefined|null|NaN)", _CODE.sub(" ", t))}
    everything = _batch(parsed)
    batch, ids = Batch(everything), everything.column("doc_id").to_pylist()
    whole = {i for i, f in zip(ids, batch.residue(*fit_batch(everything)), strict=True) if f}
    assert len(whole) > 400 and len(whole - short - slots) <= 0.01 * len(whole) and len(slots - whole) <= 0.01 * len(slots)
    for seed in range(20):
        chosen = random.Random(seed)
        model = fit_batch(_batch(chosen.sample(parsed, 2_000 + 300 * seed)))
        found = {i for i, f in zip(ids, batch.residue(*model), strict=True) if f}
        assert len(found & whole) >= 0.95 * len(found) and len(found & whole) >= 0.9 * len(whole), (seed, len(found), len(whole))
        if seed >= 7:
            assert len(found & whole) >= 0.95 * len(whole), (seed, len(found), len(whole))


def test_spark_gives_what_one_batch_gives(spark, documents):
    everything = _batch(documents[1])
    want = {i for i, f in zip(everything.column("doc_id").to_pylist(), Batch(everything).residue(*fit_batch(everything)), strict=True) if f}
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert {r.doc_id for r in residue(df, F.col("doc_id"), F.col("text")).collect()} == want
