"""Evaluation passages inside training texts.

A text is read as tokens: one Han character or kana, or a maximal run of other letters and digits. Case, character width,
punctuation, markup, spacing and invisible characters do not count. Each token of the evaluation items gets one symbol, every
other token the same foreign symbol, so a passage of WINDOW tokens is a string of WINDOW symbols. All passages of all items
go into one Aho-Corasick automaton; each document is scanned once, and the token offsets of a hit lead back to the code
points of the stored text.

Items of more text than one automaton is made for (``AUTOMATON``) aren't sent to the tasks. Their passages are a table of
digests then, and a filter of bounded size over all of them; each document is still scanned once, by a rolling hash, and only
passages that the filter lets through are joined with the table. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import map_rows, spread
from millrace.sources.shared import write_shared

#: Consecutive shared tokens that make a leak.
WINDOW = 20
#: Code points of all evaluation items up to which they are one automaton in each task (a token of an item takes up to 2,000 bytes of it).
AUTOMATON = 200_000
#: Bits of the filter over the passages of more items: at most, and for each code point of the items.
FILTER_BITS, BITS_PER_POINT = 1 << 28, 16
#: Remembered raw tokens before the table is emptied.
REMEMBER = 200_000

_JOINED = r"\p{Cf}­͏ᅟᅠ឴឵᠋-᠏︀-️"
_TOKEN = regex.compile(rf"[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}ー][{_JOINED}゙゚ﾞﾟ]*|(?:(?![\p{{Han}}\p{{Hiragana}}\p{{Katakana}}ー])[\p{{L}}\p{{N}}\p{{M}}][{_JOINED}]*)+")
_HIDDEN = regex.compile(rf"[{_JOINED}]+")
_PLAIN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}ー])[\p{L}\p{N}\p{M}])+")


def _parts(raw: str) -> list[str]:
    """A token as stored to the tokens it counts as (nearly always one)."""
    if raw.isascii():
        return [raw.lower()]
    return _PLAIN.findall(unicodedata.normalize("NFKC", _HIDDEN.sub("", raw)).casefold())


def tokens(text: str) -> list[str]:
    """The tokens of a text in their comparable form."""
    return [part for raw in _TOKEN.findall(text) for part in _parts(raw)]


@dataclass
class Scanner:
    """The automaton of some evaluation items."""

    items: list[tuple[int, str]]
    window: int = WINDOW
    symbols: dict[str, str] = field(default_factory=dict)
    seen: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        owners: dict[str, dict[int, int]] = {}
        for item, text in self.items:
            line = "".join(self.symbols.setdefault(t, self._next()) for t in tokens(text))
            for at in range(len(line) - self.window + 1):
                owners.setdefault(line[at : at + self.window], {}).setdefault(item, at)
        self.automaton = ahocorasick.Automaton()
        for passage, places in owners.items():
            self.automaton.add_word(passage, tuple(places.items()))
        self.automaton.make_automaton()
        self.any = bool(owners)

    def _next(self) -> str:
        n = len(self.symbols) + 1
        return chr(n if n < 0xD800 else n + 0x800)  # without the surrogates; at most 1.1 million distinct tokens

    def _symbol(self, raw: str) -> str:
        found = "".join(self.symbols.get(part, "\0") for part in _parts(raw))
        if len(self.seen) >= REMEMBER:
            self.seen.clear()
        self.seen[raw] = found
        return found

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(token at which a window begins, item, the window's first place in the item), in order of the text."""
        if not self.any:
            return []
        seen, symbol = self.seen, self._symbol
        line = "".join([seen[raw] if raw in seen else symbol(raw) for raw in _TOKEN.findall(text)])
        return [(end - self.window + 1, item, at) for end, places in self.automaton.iter(line) for item, at in places]

    def found(self, text: str) -> list[int]:
        """Items of which the text has a passage."""
        return sorted({item for _, item, _ in self.hits(text)})

    def spans(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, token of the item, tokens, first code point of the text, code point after the last) of each longest run of hits."""
        runs: list[list[int]] = []
        open_runs: dict[int, list[int]] = {}
        for begin, item, at in self.hits(text):
            run = open_runs.get(item)
            if run and run[1] == begin - 1:
                run[1] = begin
            else:
                open_runs[item] = run = [begin, begin, item, at]
                runs.append(run)
        if not runs:
            return []
        places = [m.span() for m in _TOKEN.finditer(text) for _ in _parts(m.group())]
        return [(item, at, last - first + self.window, places[first][0], places[last + self.window - 1][1]) for first, last, item, at in runs]


_scanners: dict[int, tuple[list[tuple[int, str]], int, Scanner]] = {}


def _scanner(items: list[tuple[int, str]], window: int) -> Scanner:
    """The scanner of the items, made once in a Python worker."""
    key = hash((tuple(items), window))
    kept = _scanners.get(key)
    if not kept or kept[0] != items or kept[1] != window:
        _scanners.clear()
        _scanners[key] = kept = (items, window, Scanner(items, window))
    return kept[2]


def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")


#: An odd number, its inverse modulo 2^64, and how many of their powers are made at a time.
_BASE, _BACK, _STEP = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 1 << 16


def _window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    """A hash of each window of token hashes, by differences of a running sum; whole numbers modulo 2^64, in blocks that overlap by a window."""
    out = [np.zeros(0, np.uint64)]
    for start in range(0, max(0, len(hashes) - window + 1), _STEP):
        own = hashes[start : start + _STEP + window - 1]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(own * _powers(_BASE, len(own)), dtype=np.uint64)])
        out.append((sums[window:] - sums[:-window]) * _powers(_BACK, len(sums) - window))
    return np.concatenate(out)


_known_powers: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _known_powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, _STEP + 64), base, np.uint64)
        known[0] = 1
        _known_powers[base] = known = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def _bits(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The positions of hashes in a filter: three each."""
    mixed = hashes ^ (hashes >> np.uint64(31))
    step = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(17) | np.uint64(1)
    return [(mixed + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(3)]


def _digest(passage: list[str]) -> bytes:
    return hashlib.blake2b("\0".join(passage).encode(), digest_size=16).digest()


class _Hasher:
    """Tokens of texts with their hashes; the hashes of tokens seen before are remembered in a table of bounded size."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > REMEMBER:
            seen.clear()
        return np.array([seen[w] if w in seen else seen.setdefault(w, _token_hash(w)) for w in words], np.uint64)


def _item_passages(items: DataFrame, window: int) -> DataFrame:
    """``digest``, ``item_id``, ``at`` (its first place) of each passage of the items (i, t), and its ``hash``; in a written table."""

    def make():
        hasher = _Hasher()

        def passages(item: int, text: str) -> Iterator[tuple]:
            words = tokens(text)
            hashes = _window_hashes(hasher(words), window).view(np.int64).tolist()
            return ((_digest(words[at : at + window]), item, at, h) for at, h in enumerate(hashes))

        return passages

    rows = map_rows(spread(items), "digest binary, item_id bigint, at int, hash bigint", make)
    return write_shared(rows.groupBy("digest", "item_id", "hash").agg(F.min("at").alias("at")), "passages")


def _filter(passages: DataFrame, bits: int) -> np.ndarray:
    """The filter of the passages as words of 64 bits; a word is put together before it is shuffled, and no more than ``bits`` / 64 come to the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), bits)))
                word = at >> np.uint64(6)
                starts = np.flatnonzero(np.diff(word, prepend=np.uint64(1 << 63)))
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(word[starts].astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    table = passages.select("hash").mapInArrow(words, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table.column("word").to_numpy()] = table.column("value").to_numpy()
    return out.view(np.uint64)


def _possible(rows: DataFrame, window: int, bits: int, words, spans: bool) -> DataFrame:
    """The passages of documents (row_id, doc_id, text) that the filter lets through: ``digest`` and, for spans, the token and the code points."""

    def make():
        hasher = _Hasher()

        def passages(row: int, doc: int, text: str) -> Iterator[tuple]:
            own = [(part, m) for m in _TOKEN.finditer(text) for part in _parts(m.group())] if spans else None
            parts = [part for part, _ in own] if spans else tokens(text)
            hashes = _window_hashes(hasher(parts), window)
            left = np.arange(len(hashes))
            for at in (_bits(hashes, bits) if len(hashes) else []):
                place = at[left]
                left = left[(words.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
            for i in left.tolist():
                digest = _digest(parts[i : i + window])
                yield (row, doc, digest, i, own[i][1].start(), own[i + window - 1][1].end()) if spans else (row, doc, digest, 0, 0, 0)

        return passages

    return map_rows(rows, "row_id bigint, doc_id bigint, digest binary, begin int, doc_start int, doc_end int", make)


def _joined(rows: DataFrame, items: DataFrame, size: int, window: int, spans: bool) -> DataFrame:
    """The result where the items are too many for an automaton; see the module."""
    passages = _item_passages(items, window)
    bits = min(FILTER_BITS, 1 << max(16, (size * BITS_PER_POINT - 1).bit_length()))
    words = rows.sparkSession.sparkContext.broadcast(_filter(passages, bits))  # FILTER_BITS at most
    own = rows.select(F.monotonically_increasing_id().alias("row_id") if spans else F.lit(0).cast("bigint").alias("row_id"), "doc_id", "text")
    possible = _possible(own, window, bits, words, spans)
    if not spans:
        return possible.select("doc_id", "digest").distinct().join(passages.select("digest", "item_id"), "digest").select("doc_id", "item_id")
    hits = write_shared(possible, "possible").join(passages.select("digest", "item_id", "at"), "digest")
    run = F.col("begin") - F.row_number().over(Window.partitionBy("row_id", "doc_id", "item_id").orderBy("begin"))
    runs = hits.withColumn("_run", run).groupBy("row_id", "doc_id", "item_id", "_run")
    return runs.agg(F.min_by("at", "begin").alias("item_token"), (F.count("*") - 1 + window).cast("int").alias("n_tokens"), F.min("doc_start").alias("doc_start"), F.max("doc_end").alias("doc_end")).drop("row_id", "_run")


def _scan(docs: DataFrame, key: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, window: int, spans: bool, automaton: int) -> DataFrame:
    rows = spread(docs.select(key.cast("bigint").alias("doc_id"), text.alias("text")).where("text IS NOT NULL AND text != ''"))
    known = items.select(item_id.cast("bigint").alias("i"), item_text.alias("t")).where("t IS NOT NULL AND i IS NOT NULL").distinct()
    size = known.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    if size > automaton:
        return _joined(rows, known, size, window, spans)
    held = sorted(tuple(r) for r in known.collect())  # at most ``automaton`` code points

    def make():
        scanner = _scanner(held, window)

        def found(doc: int, text: str) -> Iterator[tuple]:
            return ((doc, item) for item in scanner.found(text))

        def placed(doc: int, text: str) -> Iterator[tuple]:
            return ((doc, *span) for span in scanner.spans(text))

        return placed if spans else found

    return map_rows(rows, "doc_id bigint, item_id bigint" + (", item_token int, n_tokens int, doc_start int, doc_end int" if spans else ""), make)


def leaked(docs: DataFrame, key: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, window: int = WINDOW, automaton: int = AUTOMATON) -> DataFrame:
    """``doc_id`` and ``item_id`` of each document and evaluation item that share ``window`` consecutive tokens.

    A passage of several items counts for each. Null and empty texts, on either side, and items of fewer tokens leak nothing;
    repeated rows give one row a pair; empty tables give none. Documents are scanned whole. Items may have any size: beyond
    ``automaton`` code points their passages are joined instead of sent to the tasks."""
    return _scan(docs, key, text, items, item_id, item_text, window, False, automaton).distinct()


def leaked_spans(docs: DataFrame, key: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, window: int = WINDOW, automaton: int = AUTOMATON) -> DataFrame:
    """Each longest shared passage with its place: ``item_token`` (first token in the item, for the first of equal places),
    ``n_tokens``, and the code points ``doc_start`` to ``doc_end`` of the stored text. Repeated rows are reported each."""
    return _scan(docs, key, text, items, item_id, item_text, window, True, automaton)


def _inputs(spark, folder: str) -> tuple:
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    return docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text")


def p7_found(spark, folder: str) -> DataFrame:
    """Each document and evaluation item that it leaks."""
    return leaked(*_inputs(spark, folder))


def p7_spans(spark, folder: str) -> DataFrame:
    """Where each document has passages of evaluation items."""
    return leaked_spans(*_inputs(spark, folder))


# For texts whose compatibility forms are full-width ones only, as all passages of the given tables are.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_WINDOWS = r"""{name} AS (SELECT DISTINCT {id}, array_to_string(list_slice(t, i, i + 19), ' ') AS w FROM (SELECT {id},
  regexp_extract_all(lower(translate(regexp_replace(text, '\p{{Cf}}', '', 'g'), '{wide}', '{narrow}')), '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}ー]|(?:[^\P{{L}}\p{{Han}}\p{{Hiragana}}\p{{Katakana}}ー]|\p{{N}}|\p{{M}})+') AS t
  FROM {table} WHERE text <> ''), LATERAL (SELECT unnest(range(1, len(t) - 18)) AS i))"""

QUERIES = {"p7_found": p7_found, "p7_spans": p7_spans}
SQL = {
    "p7_found": "WITH " + ", ".join(_WINDOWS.format(name=n, id=i, table=t, wide=_WIDE, narrow=_NARROW) for n, i, t in (("d", "doc_id", "documents"), ("b", "item_id", "benchmark"))) + " SELECT DISTINCT doc_id, item_id FROM d JOIN b USING (w)"
}
