"""Expressions on small lists and structured replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.checks import PUBLISH_KEY
from millrace.functions.text import clean_tags, cut


def with_item(items: Column, item: Column) -> Column:
    """A list with an item at its end unless it is in it; its other items stay as they are."""
    own = F.coalesce(items, F.array().cast("array<string>"))
    return F.when(F.array_contains(own, item), own).otherwise(F.concat(own, F.array(item)))


def same_items(a: Column, b: Column) -> Column:
    """Whether two lists have the same items equally often, in any order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def merged_order(first: Column, second: Column) -> Column:
    """The distinct items of both lists, those of the first before the others."""
    return F.array_union(first, second)


def metadata_reply(reply: Column) -> Column:
    """STRUCT<title, slug, summary, tags> from a model's reply: JSON, with or without a code fence around it. Title (512), summary
    (2,000) and tags (8 of 64) are cut; a slug that isn't one of at most 96 characters becomes document. Null where there is no JSON
    object with a title."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    value = F.from_json(F.when(F.try_parse_json(bare).isNotNull(), bare), "title string, slug string, summary string, tags array<string>")
    title = F.nullif(F.trim(value["title"]), F.lit(""))
    slug = F.when(value["slug"].rlike(PUBLISH_KEY) & (F.length(value["slug"]) <= 96), value["slug"]).otherwise("document")
    made = F.struct(cut(title, 512).alias("title"), slug.alias("slug"), cut(F.trim(F.coalesce(value["summary"], F.lit(""))), 2000).alias("summary"), clean_tags(value["tags"]).alias("tags"))
    return F.when(title.isNotNull(), made)


# Subjects whose module titles are shortened.
SUBJECTS = ("高等数学", "线性代数", "概率论与数理统计")


def short_module_title(title: Column) -> Column:
    """A module's title without its subject: 模块N：T."""
    return F.regexp_replace(title, rf"^(?:{'|'.join(SUBJECTS)})\s*模块\s*(\d+)\s*[：:]\s*(.+)$", "模块$1：$2")


def outcome(jobs: DataFrame, group: list[str], state: str, good: str, bad: str, tries: Column, most: int) -> DataFrame:
    """``outcome`` of each group of jobs that are waited for: failed if any is, completed if all are, expired after ``most`` tries, else
    waiting. ``n_jobs`` counts them."""
    done, broken = F.bool_and(F.coalesce(F.col(state) == good, F.lit(False))), F.bool_or(F.coalesce(F.col(state) == bad, F.lit(False)))
    return jobs.groupBy(*group).agg(F.when(broken, "failed").when(done, "completed").when(F.max(tries) >= most, "expired").otherwise("waiting").alias("outcome"), F.count("*").alias("n_jobs"))


def rewrite_rules(pairs: DataFrame, source: str, destination: str) -> DataFrame:
    """``json``: a rewrite rule for each pair of paths."""
    return pairs.select(F.to_json(F.struct(F.col(source).alias("source"), F.col(destination).alias("destination"))).alias("json"))
