from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.splitting import sections, split, split_sections

LIMIT, OVERLAP = 60, 12


def check(text, limit, overlap):
    pieces = split(text, limit, overlap)
    assert all(0 < end - start <= limit for start, end, _ in pieces)
    assert "".join(text[start + again : end] for start, end, again in pieces) == text
    assert all(again <= overlap for _, _, again in pieces) and (not pieces or pieces[0][2] == 0)
    assert all(b[0] + b[2] == a[1] and b[0] >= a[0] for a, b in zip(pieces, pieces[1:], strict=False))
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB ,.。，\n中é1", max_size=400))
def test_pieces(text):
    check(text, LIMIT, OVERLAP)
    check(text, 8, 4)


def test_natural_places():
    text = "First one here. Second one, longer than it.\n\n" + "Third one is here too. Fourth."
    pieces = check(text, LIMIT, 0)
    assert [text[s:e] for s, e, _ in pieces] == ["First one here. Second one, longer than it.\n\n", "Third one is here too. Fourth."]
    again = check(text, LIMIT, 30)[1]
    assert text[again[0] : again[0] + again[2]] == "Second one, longer than it.\n\n"
    marks = "é" * 200
    assert all(text[s] != "́" for text in (marks,) for s, _, _ in check(marks, LIMIT, OVERLAP))
    check("x" * 500_000, 6000, 200)
    assert len(check("Ab c. " * 100_000, 6000, 200)) < 250


def test_sections_and_table(spark):
    blocks = [("a", "x"), (None, "r"), ("a", ""), ("", "s"), ("a", None), ("a", " "), ("b", "y" * 7000), ("c", "A b. " * 1300)]
    schema = "page_id long, structured_data struct<contents: array<struct<content_id: long, heading: string, content: string>>>, text string, overlap int"
    rows = [(1, ([(i, h, c) for i, (h, c) in enumerate(blocks)],), "t", 1), (2, (None,), "t", 1), (3, None, None, None), (None, ([(9, None, "z" * 6001)],), "t", 1), (5, ([(9, None, "z" * 6000), None],), "t", 1)]
    df = spark.createDataFrame(rows, schema)
    assert sections([{"heading": h, "content": c} for h, c in blocks])[:2] == [("a", "x\n\n "), ("", "r\n\ns")]
    out = split_sections(df).collect()
    assert {(r.page_id, r.heading) for r in out} == {(1, "b"), (1, "c"), (None, "")}
    assert all(len(r.text) == r.end - r.start <= 6000 for r in out)
    again = split_sections(df.unionAll(df)).collect()
    assert len(again) == 2 * len(out) and split_sections(df.limit(0)).collect() == []


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/doc_pages.parquet")
    texts = {(p.page_id, h): t for p in pages.collect() for h, t in sections([b.asDict() for b in p.structured_data.contents or []]) if len(t) > 6000}
    pieces = {}
    for r in sorted(split_sections(pages).collect(), key=lambda r: r.piece_no):
        pieces.setdefault((r.page_id, r.heading), []).append(r)
    assert pieces.keys() == texts.keys() and texts
    for key, own in pieces.items():
        assert "".join(r.text[r.overlap :] for r in own) == texts[key] and all(len(r.text) <= 6000 for r in own)
