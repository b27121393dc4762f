"""Trees of fixed depth: kept parents, nested children, summaries from the leaves up, page trees as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_children(parents: DataFrame, children: DataFrame, parent_id: str, child_parent: str) -> DataFrame:
    """Parents that have a child; apply from the leaves up to cascade."""
    return parents.join(children.select(F.col(child_parent).alias(parent_id)).distinct(), parent_id, "left_semi")


def position(index: Column) -> Column:
    """An order key from a text or number; what is no number comes as 0."""
    return F.coalesce(index.cast("string").try_cast("double"), F.lit(0.0))


def nested(parents: DataFrame, children: DataFrame, parent_id: str, child_parent: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array of structs. A parent's children come into one row, as the result says; a parent
    of more children than fit a row is better left flat."""
    own = children.groupBy(F.col(child_parent).alias(parent_id)).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    return parents.join(own, parent_id, "left").withColumn(name, F.coalesce(name, F.array().cast(dict(own.dtypes)[name])))


def summaries(children: DataFrame, parent: list[str], title: Column, summary: Column, order: list[str]) -> DataFrame:
    """``lines`` of each parent: "- title: summary" of its children in order, joined by line ends, and ``n_children``."""
    line = F.concat(F.lit("- "), title, F.lit(": "), summary)
    rows = children.select(*parent, F.struct(*[F.col(c) for c in order], line.alias("_line")).alias("_child"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("_child")), lambda c: c["_line"]), "\n")
    return rows.groupBy(*parent).agg(listed.alias("lines"), F.count("*").alias("n_children"))


def reachable(edges: DataFrame, roots: DataFrame, depth: int = 32) -> DataFrame:
    """``root`` and ``node`` of every node below each root, by ``edges`` (parent, node). One join a level, until a level is empty; deeper than
    ``depth`` is an error (a cycle)."""
    from millrace.sources.shared import write_shared

    level = roots.select(F.col("root"), F.col("root").alias("node")).distinct()
    out = level
    for _ in range(depth):
        level = write_shared(level.join(edges.select(F.col("parent").alias("node"), F.col("node").alias("_next")), "node").select("root", F.col("_next").alias("node")).distinct(), "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the tree is deeper than {depth} levels or has a cycle")


def emit_order(roots: DataFrame, middle: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes of a tree of three levels with ``ordinal`` from 0: a root, then for each node below it its leaves and then the node itself.
    ``keys`` name the levels; ``middle`` has the first two, ``leaves`` all. Numbered by ranges, so no task holds all nodes."""
    from millrace.operators.relational import numbered

    a, b, c = keys
    own = lambda df, given: df.select(*[(F.col(k) if k in given else F.lit(None)).cast("bigint").alias(k) for k in keys])
    rows = own(roots, [a]).unionByName(own(middle, [a, b])).unionByName(own(leaves, keys))
    # a node comes after its leaves, a root before all below it: absent keys sort last and first
    rows = rows.withColumns({"_b": F.coalesce(b, F.lit(-(1 << 62))), "_c": F.coalesce(c, F.lit((1 << 62)))})
    return numbered(rows, [a, "_b", "_c"], "ordinal").select(*keys, F.col("ordinal").cast("bigint").alias("ordinal"))
