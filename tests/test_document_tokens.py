"""Routing tokens of whole documents, by brute force."""

import unicodedata
from collections import Counter

import pytest
import regex

from millrace.plans import corpus


def brute(text):
    out = set()
    for run in regex.findall(r"\p{Han}+|[\p{L}\p{N}]+", unicodedata.normalize("NFKC", text or "").lower()):
        parts = lambda size, mark: {f"{mark}:{run[i : i + size]}" for i in range(len(run) - size + 1)}
        units = len(run.encode("utf-16-le")) // 2
        if regex.fullmatch(r"\p{Han}+", run):
            out |= ({f"c:{run}"} if len(run) == 1 else parts(2, "c2")) | ({f"cw:{run}"} if 2 <= len(run) <= 8 else set())
        else:
            out |= ({f"w:{run}"} if units >= 2 else set()) | (parts(3, "g") if units >= 4 else set())
    return out


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("given", [False, True])
def test_document_tokens(spark, tmp_path, given):
    """Long, null, empty, repeated, wide and mixed texts; and the given documents."""
    long = " ".join(f"word{i} 特征{i}" for i in range(20_000)) + " lastword"
    rows = [(1, long), (2, None), (3, ""), (4, "Ａｂｃｄ ﬁle 𠮷a ｶﾅ"), (5, "矩阵matrix特征值 x"), (5, "矩阵matrix特征值 x"), (6, " \n\t")]
    folder = "/root/testdata/sf0.001" if given else write(spark, tmp_path, rows)
    if given:
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = Counter((r.doc_id, r.token) for r in corpus.document_tokens(spark, folder).collect())
    assert got == Counter((i, t) for i, text in rows for t in brute(text)) and len({i for i, _ in got}) > 2
