"""Cutting oversized sections at natural boundaries, with overlap.

A section is first cut into atoms: at blank lines, line ends and sentence ends, inside an atom that is still too long at
clause marks, then at blanks, at last anywhere (never inside a combined character). Each place between two atoms has a strength.
Adjacent atoms are held in a heap and merged, weakest place first, as long as the merged body and the overlap before it fit;
what is left are the pieces, parted at the strongest places.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_rows, spread
from millrace.llm.sentences import sentences

#: Code points of a piece at most, of the overlap at most, and what joins the blocks of a section.
LIMIT, OVERLAP, JOINT = 6_000, 200, "\n\n"
#: Strengths of places between atoms.
ANYWHERE, BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)

_LINE = regex.compile(r"[^\S\n]*(?:\r?\n|\r)[^\S\n]*")
_CLAUSE = regex.compile(r"[,;:，、；：—–][”’\"»」』)）]*\s*")
_BLANK = regex.compile(r"\s+")
_INSIDE = regex.compile(r"[\p{M}\p{Cf}️\U0001F3FB-\U0001F3FF]")


def _atoms(text: str, most: int) -> list[tuple[int, int]]:
    """(end, strength of the place at the end) of each atom; ends with the text."""
    places: dict[int, int] = {}
    found = sentences(text)
    for (_, end), (start, _) in zip(found, found[1:], strict=False):
        lines = text.count("\n", end, start)
        places[start] = PARAGRAPH if lines > 1 else LINE if lines else SENTENCE
    for m in _LINE.finditer(text):
        places.setdefault(m.end(), CLAUSE)  # a line end within a sentence
    out: list[tuple[int, int]] = []
    begin = 0
    for end in [*sorted(p for p in places if 0 < p < len(text)), len(text)]:
        _cut(text, begin, end, most, (CLAUSE, _CLAUSE), out)
        out.append((end, places.get(end, PARAGRAPH)))
        begin = end
    return out


def _cut(text: str, begin: int, end: int, most: int, by: tuple, out: list[tuple[int, int]]) -> None:
    """Adds the inner places of an atom that is too long."""
    if end - begin <= most:
        return
    strength, marks = by
    if strength == ANYWHERE:
        while end - begin > most:
            at = begin + most
            while at > begin + most // 2 and _INSIDE.match(text, at):
                at -= 1
            out.append((at, ANYWHERE))
            begin = at
        return
    after = (BLANK, _BLANK) if strength == CLAUSE else (ANYWHERE, None)
    for m in marks.finditer(text, begin, end):
        if begin < m.end() < end:
            _cut(text, begin, m.end(), most, after, out)
            out.append((m.end(), strength))
            begin = m.end()
    _cut(text, begin, end, most, after, out)


def _overlap(text: str, body: int, end: int, places: list[int], overlap: int) -> int:
    """Where the repeated end of a piece's predecessor begins: the earliest natural place among its last code points."""
    low = max(body, end - overlap)
    i = bisect_left(places, low)
    if i < len(places) and places[i] < end:
        return places[i]
    for pattern in (_CLAUSE, _BLANK):
        m = pattern.search(text, low, end)
        if m and m.end() < end:
            return m.end()
    while low < end and _INSIDE.match(text, low):
        low += 1
    return low


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of each piece, in code points: a piece is text[start:end], of which the first ``overlap`` repeat the
    end of the piece before. Without their overlaps the pieces make the text again. A text within the limit is one piece; an
    empty one has none."""
    if limit < 8 or not 0 <= overlap <= limit // 2:
        raise ValueError("limit must be 8 or more and overlap between 0 and half of it")
    if len(text) <= limit:
        return [(0, len(text), 0)] if text else []
    room = limit - overlap
    atoms = _atoms(text, room)
    n = len(atoms)
    begin = [0, *(end for end, _ in atoms[:-1])]
    end = [end for end, _ in atoms]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(atoms[i][1], end[i + 1] - begin[i], i, end[i], end[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, middle, last = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or (j := after[i]) >= n or end[j] != last or begin[i] + size != last:
            continue  # one of the two has been merged since
        if size > (limit if begin[i] == 0 else room):
            continue
        end[i], alive[j] = last, False
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            heapq.heappush(heap, (atoms[_at(end[i], atoms)][1], end[k] - begin[i], i, end[i], end[k]))
        if (h := before[i]) >= 0:
            heapq.heappush(heap, (atoms[_at(end[h], atoms)][1], end[i] - begin[h], h, end[h], end[i]))
    places = sorted(e for e, s in atoms if s >= SENTENCE)
    out: list[tuple[int, int, int]] = []
    i, previous = 0, 0
    while i < n:
        start = begin[i] if not out else _overlap(text, previous, begin[i], places, overlap)
        out.append((start, end[i], begin[i] - start))
        previous = begin[i]
        i = after[i]
    return out


def _at(end: int, atoms: list[tuple[int, int]]) -> int:
    """The atom that ends there."""
    return bisect_left(atoms, (end, -1))


def sections(blocks: list[dict] | None) -> list[tuple[str, str]]:
    """(heading, text) of each section of a page, in the order in which they begin; null and empty blocks are left out, and the
    section without heading has ''."""
    held: dict[str, list[str]] = {}
    for block in blocks or []:
        if block and block["content"]:
            held.setdefault(block["heading"] or "", []).append(block["content"])
    return [(heading, JOINT.join(parts)) for heading, parts in held.items()]


def split_sections(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each section of more than ``limit`` code points: ``page_id``, ``heading``, ``piece_no`` from 0, ``start`` and
    ``end`` in the section, ``overlap`` repeated code points, and the piece as ``text``.

    Needs page_id and structured_data.contents of ``pages``; a page is one row, and repeated rows are pages of their own. Null
    arrays, blocks and contents give nothing. Pages too short to have such a section never leave the JVM."""
    blocks = F.expr("transform(structured_data.contents, b -> named_struct('heading', b.heading, 'content', b.content))")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), blocks.alias("blocks"))
    size = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda n, b: n + F.coalesce(F.length(b["content"]), F.lit(0)) + len(JOINT))
    rows = spread(rows.where(size > limit))

    def make():
        def pieces(page: int, blocks: list[dict]) -> Iterator[tuple]:
            for heading, text in sections(blocks):
                if len(text) > limit:
                    for no, (start, end, again) in enumerate(split(text, limit, overlap)):
                        yield page, heading, no, start, end, again, text[start:end]

        return pieces

    return map_rows(rows, "page_id bigint, heading string, piece_no int, start int, end int, overlap int, text string", make)


def p2_found(spark, folder: str) -> DataFrame:
    """The sections that had to be cut."""
    return split_sections(spark.read.parquet(f"{folder}/doc_pages.parquet")).select("page_id", "heading").distinct()


def p2_pieces(spark, folder: str) -> DataFrame:
    """The pieces of all sections that had to be cut."""
    return split_sections(spark.read.parquet(f"{folder}/doc_pages.parquet"))


def p2_rejoined(spark, folder: str) -> DataFrame:
    """Each section put together again from its pieces, without what they repeat, as a digest; and whether all pieces keep the limits."""
    pieces = p2_pieces(spark, folder)
    piece = F.struct("piece_no", F.expr("substring(text, overlap + 1)").alias("own"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["own"]), "")  # a section, which was a row before
    kept = F.bool_and((F.length("text") <= LIMIT) & (F.col("overlap") <= OVERLAP) & (F.col("end") - F.col("start") == F.length("text")))
    return pieces.groupBy("page_id", "heading").agg(F.md5(whole).alias("digest"), kept.alias("kept"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rejoined": p2_rejoined}
SQL = {
    "p2_rejoined": """WITH blocks AS (SELECT page_id, unnest(structured_data.contents) AS c, generate_subscripts(structured_data.contents, 1) AS i FROM doc_pages)
SELECT page_id, coalesce(c.heading, '') AS heading, md5(string_agg(c.content, chr(10) || chr(10) ORDER BY i)) AS digest, true AS kept FROM blocks WHERE c.content <> ''
GROUP BY page_id, coalesce(c.heading, '') HAVING sum(length(c.content)) + 2 * (count(*) - 1) > 6000""",
    "p2_found": """WITH blocks AS (SELECT page_id, unnest(structured_data.contents) AS c FROM doc_pages)
SELECT page_id, coalesce(c.heading, '') AS heading FROM blocks WHERE c.content IS NOT NULL AND c.content <> ''
GROUP BY page_id, coalesce(c.heading, '') HAVING sum(length(c.content)) + 2 * (count(*) - 1) > 6000"""
}
