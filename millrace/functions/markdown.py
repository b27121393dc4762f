"""Line-wise Markdown transforms.

A batch of documents becomes one flat column of lines; what a line is, is told by patterns over the whole column, fences and
statements by running sums over it, and changed lines are put back where they were. The work is in proportion to the lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How sections are numbered in headings, and what a heading is.
HAN_NUMBER = "[一二三四五六七八九十百]+"
MAJOR = rf"^{HAN_NUMBER}[、.．]\s*"
MINOR = rf"^\d+\.\d+(?:\.\d+)*[、.．]?\s*|^[（(](?:{HAN_NUMBER}|\d+)[）)]\s*"
ARABIC = r"^\d+[、.．]\s*"
HEADING = r"^(?P<marks>#{1,6})(?P<blank>\s+)(?P<words>.*)$"
# Lines of fences, module statements and components; tags that are removed, other tags, script links.
FENCE, NAMED_FENCE = "^(```|~~~)", r"^\s*(?P<mark>`{3,}|~{3,})"
STATEMENT, COMPONENT = r"^(import|export)[\s{(]", r"^</?[A-Z][\w.-]*(\s|>|/>)"
DANGEROUS, ANY_TAG, SCRIPT_LINK = r"(?i)</?(?:script|iframe|object|embed|style|link|meta)\b[^>]*>", r"(?i)<(/?[a-z][^>]*)>", r"(?i)\]\(\s*javascript:[^)]+\)"
_AROUND = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


class Lines:
    """The lines of a batch of documents as one column."""

    def __init__(self, texts: pa.Array, line_end: str):
        given = pc.fill_null(texts.cast(pa.string()), "")
        parts = pc.split_pattern_regex(given, line_end) if len(line_end) > 1 else pc.split_pattern(given, line_end)
        self.offsets = np.asarray(parts.offsets, np.int64) - parts.offsets[0].as_py()
        self.all = parts.flatten()
        self.doc = np.repeat(np.arange(len(given)), np.diff(self.offsets))

    def match(self, pattern: str) -> np.ndarray:
        return _match(self.all, pattern)

    def inside(self, marks: np.ndarray) -> np.ndarray:
        """Lines that an odd number of marks comes before in their document."""
        before = np.cumsum(marks) - marks
        return (before - before[self.offsets[:-1][self.doc]]) % 2 == 1 if len(marks) else marks

    def changed(self, at: np.ndarray, values: pa.Array) -> None:
        """Puts other lines in some places."""
        mask = np.zeros(len(self.all), bool)
        mask[at] = True
        self.all = pc.replace_with_mask(self.all, pa.array(mask), values.cast(self.all.type))

    def joined(self, keep: np.ndarray | None = None) -> pa.Array:
        """The documents of all lines, or of those to keep."""
        lines, offsets = self.all, self.offsets
        if keep is not None:
            lines, offsets = lines.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(keep)])[offsets]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), lines), "\n")


def _match(values: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False), bool)


def _running_over(start: np.ndarray, change: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Lines that a statement runs over: from a start whose brackets stay open to the line that closes them, within a document. ``change`` is
    how many more brackets each line opens than it closes."""
    over = np.zeros(len(start), bool)
    if not len(start):
        return over
    level = np.cumsum(change)
    free = 0
    for i in np.flatnonzero(start & (change > 0)).tolist():
        if i < free:
            continue
        base, end, step = level[i] - change[i], i + 1, 16
        last = np.searchsorted(doc, doc[i], side="right")
        while end < last:  # blocks of growing size, so the search costs what it finds
            closed = np.flatnonzero(level[end : min(end + step, last)] <= base)
            if len(closed):
                end += closed[0] + 1
                break
            end, step = min(end + step, last), step * 2
        over[i + 1 : end] = True
        free = end
    return over


@F.arrow_udf(T.StringType())
def strip_mdx(body: pa.Array) -> pa.Array:
    """A document without module statements (with the lines their brackets run over) and component lines; fenced code stays."""
    lines = Lines(body, r"\r?\n")
    bare = pc.replace_substring_regex(lines.all, _AROUND, "")
    marks = _match(bare, FENCE)
    code = marks | lines.inside(marks)
    text = np.flatnonzero(~code)  # only these lines count for statements
    own = lines.all.take(pa.array(text))
    statement = _match(bare.take(pa.array(text)), STATEMENT)
    depth = pc.subtract(pc.count_substring_regex(own, r"[{(\[]"), pc.count_substring_regex(own, r"[})\]]")).to_numpy(zero_copy_only=False)
    gone = statement | _running_over(statement, np.asarray(depth, np.int64), lines.doc[text]) | _match(bare.take(pa.array(text)), COMPONENT)
    keep = np.ones(len(lines.all), bool)
    keep[text[gone]] = False
    return lines.joined(keep)


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("changed", T.IntegerType())]))
def level_headings(source: pa.Array) -> pa.Array:
    """STRUCT<text, changed>: headings brought to levels 2 and 3 by their numbering; fenced lines stay, a fence closes only with
    its own mark. Where any heading counts in Han numerals, Arabic numbers are the level below."""
    lines = Lines(source, "\n")
    marks = lines.match(NAMED_FENCE)
    at = np.flatnonzero(marks)
    kinds = [v["mark"][0] for v in pc.extract_regex(lines.all.take(pa.array(at)), NAMED_FENCE).to_pylist()]
    toggles, opened, doc = np.zeros(len(marks), bool), "", -1
    for i, kind in zip(at.tolist(), kinds, strict=True):
        if lines.doc[i] != doc:
            doc, opened = lines.doc[i], ""
        if opened in ("", kind):
            toggles[i], opened = True, "" if opened else kind
    heads = np.flatnonzero(lines.match(HEADING) & ~marks & ~lines.inside(toggles))
    part = pc.extract_regex(lines.all.take(pa.array(heads)), HEADING)
    given, blank, rest = (pc.struct_field(part, f) for f in ("marks", "blank", "words"))
    words = pc.replace_substring_regex(rest, r"^\s+|\s+$", "")
    level, major = np.asarray(pc.binary_length(given), np.int64), _match(words, MAJOR)
    counted = np.zeros(len(source), bool)
    counted[lines.doc[heads[major]]] = True
    third = _match(words, MINOR) | (counted[lines.doc[heads]] & _match(words, ARABIC))
    target = np.select([major, third, level == 1, level >= 4], [2, 3, 2, 3], level)
    other = target != level
    made = pc.binary_join_element_wise(pa.array(np.array(["", "#", "##", "###"])[np.minimum(target, 3)][other], pa.string()), *(c.filter(pa.array(other)) for c in (blank, rest)), "")
    lines.changed(heads[other], made)
    count = np.bincount(lines.doc[heads[other]], minlength=len(source)).astype(np.int32)
    return pa.StructArray.from_arrays([lines.joined(), pa.array(count)], names=["text", "changed"])


@F.arrow_udf(T.StringType())
def _safe_lines(text: pa.Array) -> pa.Array:
    lines = Lines(text, "\n")
    marks = lines.match(r"^\s*(~~~|```)")
    outside = ~marks & ~lines.inside(marks)
    statement = np.flatnonzero(outside & lines.match(r"^\s*(?:import|export)\s+"))
    lines.changed(statement, pa.array([""] * len(statement), pa.string()))
    at = np.flatnonzero(outside & lines.match(r"(?i)<|javascript:"))
    own = lines.all.take(pa.array(at))
    for pattern, plain in ((DANGEROUS, ""), (ANY_TAG, r"&lt;\1&gt;"), (SCRIPT_LINK, "](#)")):
        own = pc.replace_substring_regex(own, pattern, plain)
    lines.changed(at, own)
    return lines.joined()


#: Bytes of a cleaned document at most.
DOCUMENT_BYTES = 1 << 20


def publishable(markdown: Column, title: Column) -> Column:
    """Markdown safe to publish: no byte order mark, statements, dangerous tags and script links; other tags escaped, outside
    fences; without front matter and with a level-1 heading. Null where the result is over 1 MiB, for the caller to report."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(markdown, F.lit("")), r"^\x{FEFF}", ""), r"\r\n?", "\n")
    body = _safe_lines(text)
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)\A---\s*\n.*?\n---\s*\n", ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    titled = F.concat(F.when(body.rlike(r"(?m)^#\s+"), body).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), body)), F.lit("\n"))
    return F.when(F.octet_length(titled) <= DOCUMENT_BYTES + 1, titled)


def index_page(title: Column, summary: Column, child_heading: str, children: Column) -> Column:
    """An index page with front matter, summary and the list of its children."""
    from millrace.functions.text import to_json_text

    head = F.concat(F.lit("---\ntitle: "), to_json_text(title), F.lit("\ndescription: "), to_json_text(F.coalesce(F.nullif(summary, F.lit("")), title)), F.lit("\n---\n\n# "), title, F.lit("\n\n"))
    about = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(summary, F.lit("\n\n"))).otherwise("")
    listed = F.concat(F.lit(f"## {child_heading}\n\n"), F.array_join(F.transform(children, lambda c: F.concat(F.lit("- "), c)), "\n"), F.lit("\n"))
    return F.concat(head, about, F.when(F.size(children) > 0, listed).otherwise(""))
