"""Expressions on paths and URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _slug(path: Column) -> Column:
    plain = F.regexp_replace(F.translate(path, "\\", "/"), r"(?i)\.(md|mdx)$", "")
    return F.regexp_replace(plain, r"(?i)(^|/)index$", "")


def page_url(path: Column, base: str = "/docs") -> Column:
    """The URL of a source path: without extension, an index page at its folder."""
    slug = _slug(path)
    return F.concat(F.lit(base), F.when(slug == "", "").otherwise(F.concat(F.lit("/"), slug)))


def markdown_path(path: Column, base: str = "docs") -> Column:
    """Where a source path's Markdown file goes."""
    return F.concat(page_url(path, base), F.lit(".md"))


def scope(path: Column) -> Column:
    """STRUCT<category, group> of a source path: its first and its first two parts, root for the index page."""
    parts = F.filter(F.split(F.regexp_replace(F.translate(path, "\\", "/"), r"(?i)\.(md|mdx)$", ""), "/"), lambda p: p != "")
    parts = F.when(F.lower(F.try_element_at(parts, F.lit(-1))) == "index", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    category = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("root"))
    group = F.when(F.size(parts) >= 2, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(category)
    return F.struct(category.alias("category"), group.alias("group"))


def path_title(path: Column) -> Column:
    """The file name without its extension."""
    name = F.element_at(F.split(F.regexp_replace(F.translate(path, "\\", "/"), r"(?i)\.(md|mdx)$", ""), "/"), -1)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("Untitled"))


# Prefixes of built sites and the area they count for, first match.
AREAS = (("_next/static/", "_next/static"), ("_next/", "_next/other"), ("search/", "search"), ("docs/", "docs"))


def top_area(path: Column) -> Column:
    """The area of a built file: one of the named prefixes, else its first folder."""
    plain = F.translate(path, "\\", "/")
    folder = F.when(F.instr(plain, "/") > 0, F.substring_index(plain, "/", 1)).otherwise("(root)")
    return reduce(lambda rest, area: F.when(plain.startswith(area[0]), area[1]).otherwise(rest), reversed(AREAS), folder)


def extension(path: Column) -> Column:
    """The lower-case extension with its point; (none) without one."""
    found = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))
    return F.when(found == "", "(none)").otherwise(found)


def file_segment(text: Column) -> Column:
    """Text as part of a file name."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("root"))


def under(path: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a path is one of the prefixes or lies below it."""
    return reduce(lambda a, b: a | b, [(path == p) | path.startswith(p + "/") for p in prefixes])


def segment_folder(path: Column, suffix: str = ".segments") -> Column:
    """The path up to and with its first part that ends so; null without one."""
    return F.nullif(F.regexp_extract(path, rf"^((?:[^/]*/)*?[^/]*{suffix.replace('.', chr(92) + '.')})(?:/|$)", 1), F.lit(""))


def encode_parts(path: Column) -> Column:
    """Each part of a path URL-encoded, blanks as %20."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")
