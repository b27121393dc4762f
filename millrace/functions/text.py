"""Text expressions. All are JVM-side but ``nfkc``, which Spark has no function for; it only gets rows that aren't ASCII."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; null stays null."""
    return F.coalesce(_nfkc(F.when(~text.rlike(r"^\p{ASCII}*$"), text)), text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_array(texts: pd.Series) -> pd.Series:
    """``nfkc`` of each text of an array."""
    return texts.map(lambda a: None if a is None else [None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t) for t in a])


# What search text is freed of, in order; each match becomes the second item.
MARKUP = (
    (r"(?s)```.*?```", " "),
    (r"(?s)~~~.*?~~~", " "),
    (r"\\text\{([^{}]{0,300})\}", " $1 "),
    (r"\\operatorname\{([^{}]{0,120})\}", " $1 "),
    (r"(?s)\$\$.*?\$\$", " "),
    (r"(?s)\\\[.*?\\\]", " "),
    (r"(?s)\\\(.*?\\\)", " "),
    (r"\$[^$\n]{1,2000}\$", " "),
    (r"\\(?:begin|end)\{[^{}]{1,80}\}", " "),
    (r"\\[a-zA-Z]+\*?(?:\[[^\]]{0,100}\])?", " "),
    (r"(?i)https?://[^\s\p{Z}\x{FEFF}\x{85}]+", " "),
    (r"[{}_^]+", " "),
    (r"[\s\p{Z}\x{FEFF}\x{85}]+", " "),
)
LETTER = r"[\p{L}\p{N}]"


def strip_markup(text: Column) -> Column:
    """Text without code, formulas, commands and URLs, blanks collapsed; '' where fewer than two letters or digits are left."""
    clean = F.trim(reduce(lambda t, step: F.regexp_replace(t, F.lit(step[0]), F.lit(step[1])), MARKUP, F.coalesce(text, F.lit(""))))
    return F.when(F.regexp_count(clean, F.lit(LETTER)) >= 2, clean).otherwise("")


def strip_each(texts: Column) -> Column:
    """``strip_markup`` of each text of an array. What is left is bound by a lambda: inside of one an expression that stands twice is evaluated twice;
    and the second letter or digit is looked for instead of counting all."""
    left = F.transform(texts, lambda t: F.trim(reduce(lambda t, step: F.regexp_replace(t, F.lit(step[0]), F.lit(step[1])), MARKUP, F.coalesce(t, F.lit("")))))
    return F.transform(left, lambda t: F.when(t.rlike(r"[\p{L}\p{N}][^\p{L}\p{N}]*[\p{L}\p{N}]"), t).otherwise(""))


def search_text(text: Column) -> Column:
    """``strip_markup`` of the NFKC form. Not idempotent: removing one formula can leave another, so apply it as often as meant."""
    return strip_markup(nfkc(F.coalesce(text, F.lit(""))))


def routing_tokens(text: Column, normalize: bool = True) -> Column:
    """The distinct routing tokens of a text, in order of first appearance.

    A run of Han characters gives c:X for a single one, c2:XY for each two in a row and cw:run for runs of 2 to 8; any other run
    of letters and digits gives w:run from 2 UTF-16 units and g:abc for each three characters of runs from 4."""
    plain = F.lower(nfkc(text) if normalize else text)
    runs = F.regexp_extract_all(F.coalesce(plain, F.lit("")), F.lit(r"\p{IsHan}+|[\p{L}\p{N}]+"), F.lit(0))

    none = F.array().cast("array<string>")

    def tokens(run: Column) -> Column:
        n = F.length(run)
        units = F.octet_length(F.encode(run, "UTF-16BE")) / 2
        # a look-ahead finds the overlapping parts in one pass
        parts = lambda size, mark: F.transform(F.regexp_extract_all(run, F.lit(f"(?=(.{{{size}}}))"), F.lit(1)), lambda p: F.concat(F.lit(mark), p))
        one = lambda when, mark: F.when(when, F.array(F.concat(F.lit(mark), run))).otherwise(none)
        han = F.concat(one(n == 1, "c:"), parts(2, "c2:"), one((n >= 2) & (n <= 8), "cw:"))
        other = F.concat(one(units >= 2, "w:"), F.when(units >= 4, parts(3, "g:")).otherwise(none))
        return F.when(run.rlike(r"^\p{IsHan}+$"), han).otherwise(other)

    return F.array_distinct(F.flatten(F.transform(runs, tokens)))


def trimmed(text: Column) -> Column:
    """Text without blanks of any kind around it."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def cut(text: Column, most: int) -> Column:
    """The first ``most`` code points: a field's length limit."""
    return F.substring(text, 1, most)


def display_title(manual: Column, auto: Column, fallback: Column) -> Column:
    """The first of the three that isn't blank, trimmed, at most 512 code points."""
    return cut(F.coalesce(blank_to_null(manual), blank_to_null(auto), fallback), 512)


def clean_tags(tags: Column) -> Column:
    """Tags trimmed, of at most 64 code points, without empty ones, the first eight."""
    return F.slice(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: cut(trimmed(t), 64)), lambda t: t != ""), 1, 8)


def first_heading(markdown: Column) -> Column:
    """The text of the first level-1 heading, '' without one."""
    return F.regexp_extract(markdown, r"(?m)^#\s+(.+)$", 1)


def split_frontmatter(content: Column) -> tuple[Column, Column]:
    """(front matter, body) of a document; '' and the whole where it has none."""
    pattern = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"
    return F.regexp_extract(content, pattern, 1), F.regexp_replace(content, pattern, "")


def frontmatter_value(frontmatter: Column, key: str) -> Column:
    """The value of a one-line key, trimmed and without the quotes around it; null where it isn't there."""
    value = trimmed(F.regexp_extract(frontmatter, rf"(?m)^{key}:[^\S\n]*(.+)$", 1))
    return blank_to_null(F.regexp_replace(value, r"""^["']|["']$""", ""))


def to_json_text(value: Column) -> Column:
    """A string as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def render_markdown(title: Column, url: Column, body: Column) -> Column:
    """A page as one Markdown file."""
    return F.concat(F.lit("# "), title, F.lit(" ("), url, F.lit(")\n\n"), F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit("\n"))


def error_message(message: Column, stack: Column, default: str, most: int = 8192) -> Column:
    """The first of message, first line of the stack, default that isn't blank."""
    return cut(F.coalesce(blank_to_null(message), blank_to_null(F.substring_index(stack, "\n", 1)), F.lit(default)), most)


def countdown(seconds: Column) -> Column:
    """Whole seconds as days, hours, minutes and seconds left; nothing below zero."""
    left = F.greatest(F.coalesce(seconds, F.lit(0)).cast("bigint"), F.lit(0))
    return F.struct((left / 86400).cast("bigint").alias("days"), (left % 86400 / 3600).cast("int").alias("hours"), (left % 3600 / 60).cast("int").alias("minutes"), (left % 60).cast("int").alias("seconds"))


def mebibytes(size: Column) -> Column:
    """A size as text, in MiB with two digits."""
    return F.format_string("%.2f MiB", size / F.lit(1024.0 * 1024.0))
