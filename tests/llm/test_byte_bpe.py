import base64

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.byte_bpe import PATTERN, TOKENIZERS, Encoder, RankQueue, encode_texts, ids_to_text

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TRUTH = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("the ain 中文的特征值のを裏覚醒…é​\n")), max_size=80))
def test_same_as_library(text):
    assert ENCODER.encode(text) == TRUTH.encode_ordinary(text)


def test_long_pretokens():
    for text in ("a" * 20_000, "特征值" * 5_000, "abcde" * 3_000 + "=" * 4_000, "<|endoftext|>"):
        assert ENCODER.encode(text) == TRUTH.encode_ordinary(text)
        assert ids_to_text(ENCODER.encode(text)) == text


def test_queue_order():
    queue = RankQueue(70_000)
    for rank, at in ((69_999, 1), (3, 9), (3, 2), (64, 5), (4096, 0)):
        queue.push(rank, at)
    assert [queue.pop() for _ in range(6)] == [(3, 2), (3, 9), (64, 5), (4096, 0), (69_999, 1), None]


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello 世界", None), (3, "Hello 世界", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df, F.col("doc_id"), F.col("text")).collect())
    assert out == [(1, []), (2, []), (3, TRUTH.encode_ordinary("Hello 世界")), (3, TRUTH.encode_ordinary("Hello 世界"))]
    assert encode_texts(df.limit(0), F.col("doc_id"), F.col("text")).collect() == []


def test_whole_documents():
    parquet = pytest.importorskip("pyarrow.parquet").read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    for text in parquet.column(0).to_pylist():
        if text:
            assert ENCODER.encode(text) == TRUTH.encode_ordinary(text)
    assert regex.compile(PATTERN).findall("it's 5") == ["it", "'s", " 5"]
