"""Byte-level BPE ids of texts, from a public vocabulary of ranks.

A pre-token is cut first wherever no token of the vocabulary holds the two bytes that meet there: no merge can cross such a
place, so the parts have the ids of the whole. Each part is merged with a rank queue: a linked list of its symbols, for each
merge rank a bucket of the list positions where that merge is possible, and a bitmap of three levels over the ranks whose
first set bit names the next merge. An entry whose pair has changed since is skipped when its turn comes. A part of n bytes
costs O(n log n) at worst, however long it is. Parts and pre-tokens seen before are remembered, in a table of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import spread

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
#: The pattern that splits text into pre-tokens (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries after which a table of remembered parts is emptied.
REMEMBER = 200_000


class RankQueue:
    """Positions by merge rank; the lowest rank, and in it the leftmost position, comes first."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low, self.mid, self.top = [0] * words, [0] * ((words >> 6) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        block = (self.top & -self.top).bit_length() - 1
        word = (block << 6) + (self.mid[block] & -self.mid[block]).bit_length() - 1
        bits = self.low[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] = bits & (bits - 1)
            if not self.low[word]:
                self.mid[block] &= ~(1 << (word & 63))
                if not self.mid[block]:
                    self.top &= ~(1 << block)
        return rank, position


class Encoder:
    """Ids of texts by one vocabulary of ranks (lines of base64 bytes and rank)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.split = regex.compile(pattern).findall
        meets = np.zeros((256, 256), bool)
        for token in self.ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8)
                meets[b[:-1], b[1:]] = True
        self.apart = ~meets
        self.parts: dict[bytes, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def merge(self, part: bytes) -> list[int]:
        """Ids of bytes that are one part."""
        ranks, queue = self.ranks, self.queue
        n = len(part)
        if n == 1 or part in ranks:
            return [ranks[part]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbol: list[bytes | None] = [part[i : i + 1] for i in range(n)]
        for i in range(n - 1):
            if (rank := ranks.get(symbol[i] + symbol[i + 1])) is not None:
                queue.push(rank, i)
        while (head := queue.pop()) is not None:
            rank, i = head
            if symbol[i] is None or (j := after[i]) >= n or ranks.get(pair := symbol[i] + symbol[j]) != rank:
                continue  # stale: one of the two symbols has been merged since
            symbol[i], symbol[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := ranks.get(pair + symbol[k])) is not None:
                    queue.push(new, i)
            if (h := before[i]) >= 0 and (new := ranks.get(symbol[h] + pair)) is not None:
                queue.push(new, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[symbol[i]])
            i = after[i]
        return out

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode()
        if raw in self.ranks:
            return [self.ranks[raw]]
        b = np.frombuffer(raw, np.uint8)
        cuts = [0, *(np.flatnonzero(self.apart[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
        out: list[int] = []
        for start, end in zip(cuts, cuts[1:], strict=False):
            part = raw[start:end]
            ids = self.parts.get(part)
            if ids is None:
                ids = self.merge(part)
                if len(part) <= 64:
                    if len(self.parts) >= REMEMBER:
                        self.parts.clear()
                    self.parts[part] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens: their strings in it are ordinary text."""
        out: list[int] = []
        words = self.words
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                ids = self.word(word)
                if len(word) <= 24:
                    if len(words) >= REMEMBER:
                        words.clear()
                    words[word] = ids
            out += ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a vocabulary, read once in a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(df: DataFrame, key: Column, text: Column, path: str | None = None) -> DataFrame:
    """``key`` (as it is) and ``ids`` ARRAY<INT> of each row's text, by the vocabulary at ``path``. Empty and null texts have an
    empty list; repeated rows come out as often as they come in; an empty table gives no rows. Texts are encoded whole."""
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    rows = spread(df.select(key, text.alias("_text")))
    name, kind = rows.columns[0], rows.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                now = batch.slice(start, 1024)
                ids = [encoder.encode(t) if t else [] for t in now.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([now.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[name, "ids"])

    return rows.mapInArrow(run, f"`{name}` {kind}, ids array<int>")


def ids_to_text(ids: list[int], path: str | None = None) -> str:
    """The text of ids; the inverse of the encoding."""
    with open(path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as lines:
        tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return b"".join(tokens[i] for i in ids).decode()


def p6_ids(spark, folder: str) -> DataFrame:
    """Ids of every document."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return encode_texts(documents, F.col("doc_id"), F.col("text"))


def p6_decoded(spark, folder: str) -> DataFrame:
    """The digest of the text that the ids of each document lead back to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in encoder_of(f"{TOKENIZERS}/byte_bpe_50k.tiktoken").ranks.items()}
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, ids)).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return p6_ids(spark, folder).mapInArrow(run, "doc_id bigint, text string").select("doc_id", F.md5("text").alias("digest"))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded}
SQL = {"p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"}
