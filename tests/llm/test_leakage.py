import unicodedata

import regex
from pyspark.sql import functions as F

from millrace.llm.leakage import Scanner, leaked, leaked_spans, tokens

WORDS = [f"word{i}" for i in range(60)]
ITEM = " ".join(WORDS[:40])
HAN = "某机卡贝米型有组框拉菲程反复索取第页甲坊以斤兰米尔纱换匹诺贝"


def brute(docs, items, window=20):
    def split(text):
        text = regex.sub(r"\p{Cf}", "", unicodedata.normalize("NFKC", text)).casefold()
        return regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|[[\p{L}\p{N}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}ー]]+", text, regex.V1)

    grams = lambda t: {tuple(t[i : i + window]) for i in range(len(t) - window + 1)}
    held = [(i, grams(split(t))) for i, t in items if t]
    return sorted({(d, i) for d, t in docs if t for i, g in held if g & grams(split(t))})


def test_tokens():
    assert tokens("Ａb-c 特征 x​y **q**_r カﾅー") == ["ab", "c", "特", "征", "xy", "q", "r", "カ", "ナ", "ー"]


def test_scanner_threshold_and_offsets():
    scanner = Scanner([(7, ITEM), (8, HAN)])
    assert scanner.found("x " + " ".join(WORDS[5:24])) == []
    text = "前 " + ", ".join(w.upper() for w in WORDS[5:25]) + "! rest"
    assert scanner.found(text) == [7]
    [(item, at, n, start, end)] = scanner.spans(text)
    assert (item, at, n) == (7, 5, 20) and text[start:end].startswith("WORD5") and text[start:end].endswith("WORD24")
    dirty = "​".join(HAN[3:25]) + "\n"
    assert scanner.found(dirty) == [8] and scanner.spans(dirty)[0][3:] == (0, len(dirty) - 1)


def test_tables(spark):
    docs = [(1, None, 0), (2, "", 0), (3, ITEM, 0), (3, ITEM, 0), (4, "a " * 9_000 + ITEM + HAN, 0), (5, " ".join(WORDS[21:40]), 0)]
    items = [(7, ITEM), (8, HAN), (9, None), (10, ""), (11, "short one"), (12, "lead " + ITEM)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string")
    args = (F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("text"))
    got = sorted(tuple(r) for r in leaked(d, *args).collect())
    assert got == brute([r[:2] for r in docs], items) == [(3, 7), (3, 12), (4, 7), (4, 8), (4, 12)]
    assert leaked(d.limit(0), *args).collect() == []
    assert leaked(d, F.col("doc_id"), F.col("text"), i.limit(0), F.col("item_id"), F.col("text")).collect() == []
    assert {(r.doc_id, r.item_id) for r in leaked_spans(d, *args).collect()} == set(got)


def test_given_tables_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    d, i = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = sorted(tuple(r) for r in leaked(d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("text")).collect())
    assert got == brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in i.collect()])


def test_items_beyond_an_automaton(spark):
    """The join of passages gives the rows of the automaton: many items, one passage in several, documents longer than a block of hashes."""
    docs = [(1, None), (2, ""), (3, ITEM), (3, ITEM), (4, "a " * 70_000 + ITEM + HAN), (5, " ".join(WORDS[21:40])), (6, ITEM + " x " + ITEM + " " + ITEM), (None, ITEM)]
    items = [(7, ITEM), (8, HAN), (9, None), (10, ""), (11, "short one"), (12, "lead " + ITEM), (13, " ".join(WORDS[:25]) + " gap " + " ".join(WORDS[20:45])), *[(100 + i, f"item {i} " + " ".join(f"t{i * j}" for j in range(40))) for i in range(50)]]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    args = (d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("text"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(leaked(*args, automaton=0)) == rows(leaked(*args)) and leaked(*args).count() > 8
    assert rows(leaked_spans(*args, automaton=0)) == rows(leaked_spans(*args))
    assert leaked(d.limit(0), *args[1:], automaton=0).collect() == []


def test_given_tables_both_ways(spark):
    d, i = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    args = (d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("text"))
    for operator in (leaked, leaked_spans):
        assert sorted(map(tuple, operator(*args, automaton=0).collect())) == sorted(map(tuple, operator(*args).collect()))


def test_fifty_million_code_points_of_items(spark):
    """Items far beyond an automaton, with known passages of documents among them."""
    word = lambda c, n: F.substring(F.conv(F.xxhash64(c, n).cast("string"), 10, 36), 1, 7)
    passage = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda n: word(F.col("id"), n)))
    items = spark.range(0, 160_000, 1, 8).select("id", passage.alias("text"))
    items = items.unionByName(spark.createDataFrame([(900_000, ITEM), (900_001, HAN)], "id long, text string"))
    assert items.agg(F.sum(F.length("text"))).first()[0] > 50_000_000
    chosen = [17, 90_000, 159_999]
    leaks = items.where(F.col("id").isin(chosen)).select("id", F.concat(F.lit("before that "), F.substring_index("text", " ", 27), F.lit(" and after")).alias("text"))
    docs = leaks.unionByName(spark.createDataFrame([(1, "x " + ITEM), (2, "no leak " * 50), (3, HAN[:19])], "id long, text string"))
    found = leaked(docs, F.col("id"), F.col("text"), items, F.col("id"), F.col("text"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 900_000), *[(i, i) for i in chosen]]
