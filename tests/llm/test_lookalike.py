from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.lookalike import Looks, confusables, known_looks, look_classes, one_form, one_forms, respell, same_look, suspect_tokens, suspects


@pytest.mark.parametrize(("a", "b"), [
    ("Torhald rule", "Тоrһаlԁ rulе"), ("page", "ｐａｇｅ"), ("b​inomial", "binomial"), ("bituraful", "bit­uraful"), ("übung", "übung"), ("a b c", "a　b\xa0 c"),
    ("量不", "量不"), ("一⻅", "⼀见"), ("ﬁle", "file"), ("ガ", "ｶﾞ"), ("ｘ，１", "x,1"), ("сахар", "caxap"), ("end \r\nx", "end\nx"), ("ëx", "ёx"), ("a", " a "), ("co-op", "co‑op"), ("co-op", "co‐op"),
    ("ρaypal", "paypal"), ("αpple", "apple"), ("κate", "kate"), ("Ꭺpple", "Apple"), ("ոote", "note"), ("カ", "力"), ("ロ", "口"), ("一", "ー"), ("𝗵ello", "hello"), ("デ一タ", "データ"), ("夕スク", "タスク"), ("人カ", "人力"), ("Іnk", "Ink"), ("ⲟne", "one"), ("ꓲꓠ", "ꓲN")])
def test_same(a, b):
    assert one_form(a) == one_form(b)


@pytest.mark.parametrize(("a", "b"), [
    ("Page", "page"), ("resume", "résumé"), ("l", "1"), ("O", "0"), ("x2", "x²"), ("字。", "字."), ("a\nb", "a b"), ("🧑‍💻", "🧑💻"), ("жар", "map"), ("½", "1/2"), ("I", "l"), ("α", "a"), ("Ink", "lnk"), ("rn", "m"), ("日", "曰"), ("в", "b"), ("–", "-")])
def test_different(a, b):
    assert one_form(a) != one_form(b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aаoοѕ​­́̈ｱﾞ⻅⼀ﬁ‑ρακᎪոカ力ロ口一ー𝗵IІlӏナ")), max_size=40))
def test_idempotent(text):
    assert one_form(one_form(text)) == one_form(text)


def test_script_choice():
    assert respell("жap") == "жар"  # the rest is Cyrillic only, so all of it is
    assert respell("αoς") == "αος"
    assert respell("ԁаtа") == "data"
    assert one_form(one_form("Тһе ｆｉｌｅ​")) == one_form("Тһе ｆｉｌｅ​") == "The file"


def test_pairs_against_brute_force(spark):
    texts = [(1, "page", 0), (2, "ｐage", 0), (3, "page", 0), (3, "page", 0), (4, None, 0), (5, "", 0), (6, "  ", 0), (7, "\xa0", 0), (8, "Page", 0), (9, "раgе", 0), (10, "x" * 50_000, 0), (11, "x" * 49_999 + "ｘ", 0)]
    df = spark.createDataFrame(texts, "id long, form string, text int")
    rows = sorted({(i, t) for i, t, _ in texts if t and t.strip()})
    want = sorted({("w", min(i, j), max(i, j)) for (i, t), (j, u) in combinations(rows, 2) if i != j and t != u and one_form(t) == one_form(u)})
    assert sorted(tuple(r) for r in same_look([(df, "w", "id", "form")]).collect()) == want and len(want) == 6
    assert same_look([(df.limit(0), "w", "id", "form")]).collect() == []
    assert {r.id: r.form for r in one_forms(df, "w", "id", "form").collect()}[4] is None


def test_given_words(spark):
    cards = spark.read.parquet("/root/testdata/sf0.01/word_cards.parquet").select("card_id", "word")
    rows = [(r.card_id, r.word, one_form(r.word)) for r in cards.collect() if r.word and r.word.strip()]
    want = sorted(("word", *sorted((a[0], b[0]))) for a, b in combinations(rows, 2) if a[2] == b[2] and a[1] != b[1])
    assert sorted(tuple(r) for r in same_look([(cards, "word", "card_id", "word")]).collect()) == want


def test_named_tokens():
    assert suspects("Тоrсh and Torch, сахар жар naïve αβ x") == [("Тоrсh", "mixed", "Torch"), ("сахар", "whole", "caxap")]
    assert suspects("データ処理の力 page") == []


def test_east_asian_words_stay():
    text = "データ処理タスクの力を、入口で二回テストする。もう一つのカメラ、ロボット、エネルギー、トロール。"
    assert one_form(text) == text


def test_public_table():
    table = confusables()
    assert len(table) > 5_000 and table["а"] == "a" and table["カ"] == "力"
    import pickle

    again = pickle.loads(pickle.dumps(known_looks()))
    assert again.spellings == known_looks().spellings and one_form("Тоrсh", Looks({})) == "Тоrсh"


def test_classes_and_tokens(spark):
    texts = [(1, "page", 0), (2, "ｐage", 0), (3, "page", 0), (3, "page", 0), (4, None, 0), (5, "", 0), (6, "раgе", 0), (7, "Page", 0)]
    df = spark.createDataFrame(texts, "id long, form string, kind int")
    assert sorted(tuple(r) for r in look_classes([(df, "w", "id", "form")]).collect()) == [("w", 1, 1, 2, 3), ("w", 2, 1, 3, 3), ("w", 3, 1, 2, 3), ("w", 6, 1, 3, 3)]
    assert [tuple(r) for r in suspect_tokens(df, "w", "id", "form").collect()] == [("w", 6, "раgе", "mixed", "page")]
    assert look_classes([(df.limit(0), "w", "id", "form")]).collect() == suspect_tokens(df.limit(0), "w", "id", "form").collect() == []


def test_links_are_the_pairs(spark):
    cards = spark.read.parquet("/root/testdata/sf0.01/word_cards.parquet").select("card_id", "word")
    parts = [(cards, "word", "card_id", "word")]
    pairs = same_look(parts).collect()
    links = {}
    for r in pairs:
        for i in (r.a_id, r.b_id):
            links[i] = links.get(i, 0) + 1
    assert links and {r.id: r.links for r in look_classes(parts).collect()} == links
