"""DuckDB SQL of text expressions, shared by the checks of several queries."""

from __future__ import annotations

from millrace.functions.text import MARKUP


def strip_markup(text: str) -> str:
    """SQL of ``functions.text.strip_markup``."""
    out = f"coalesce({text}, '')"
    for pattern, new in MARKUP:
        pattern = pattern.replace("{1,2000}", "{1,1000}[^$\\n]{0,1000}")  # RE2 repeats at most a thousand times
        out = f"regexp_replace({out}, '{pattern}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return f"trim({out})"


def tokens(source: str, key: str, text: str) -> str:
    """CTEs ``words`` and ``tokens`` (key, token; distinct) of a table, for text of the basic plane in NFKC form."""
    return rf"""words AS (SELECT DISTINCT {key}, unnest(regexp_extract_all(lower({text}), '\p{{Han}}+|[\p{{L}}\p{{N}}]+')) AS w FROM {source}),
tokens AS (SELECT DISTINCT {key}, unnest(CASE WHEN regexp_full_match(w, '\p{{Han}}+')
  THEN list_concat(CASE WHEN length(w) = 1 THEN ['c:' || w] ELSE list_transform(range(1, length(w)), lambda i: 'c2:' || substr(w, i, 2)) END, CASE WHEN length(w) BETWEEN 2 AND 8 THEN ['cw:' || w] ELSE [] END)
  ELSE list_concat(CASE WHEN length(w) >= 2 THEN ['w:' || w] ELSE [] END, CASE WHEN length(w) >= 4 THEN list_transform(range(1, length(w) - 1), lambda i: 'g:' || substr(w, i, 3)) ELSE [] END) END) AS token FROM words)"""


def fnv32(token: str) -> str:
    """SQL of ``functions.hashing.fnv32``."""
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length({token}) + 1), lambda i: unicode(substr({token}, i, 1))::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def mixed32(token: str) -> str:
    """SQL of ``functions.hashing.mixed32``."""
    product = "((xor(h, c) * 51819 + (((xor(h, c) * 34283) & 65535) * 65536)) & 4294967295)"
    return f"(list_reduce(list_prepend(2654435769::BIGINT, list_transform(range(1, length({token}) + 1), lambda i: unicode(substr({token}, i, 1))::BIGINT)), lambda h, c: xor({product}, {product} >> 13)) | 1)"


def hashed(name: str = "hashed", source: str = "tokens") -> str:
    """A CTE with the hashes a and b of each distinct token."""
    return f"{name} AS (SELECT token, {fnv32('token')} AS a, {mixed32('token')} AS b FROM (SELECT DISTINCT token FROM {source}))"


def power_of_two(value: str) -> str:
    """The least power of two not below a whole number."""
    return f"list_min(list_filter(list_transform(range(0, 41), lambda p: (1::BIGINT << p)), lambda x: x >= {value}))"
