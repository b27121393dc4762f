"""Search records of pages: one core record a page, body records for each section in bounded chunks.

All of it happens within a page's row, by array functions; nothing is shuffled, however many pages there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import path_title
from millrace.functions.text import blank_to_null, cut, nfkc_array, search_text, strip_each

#: Code points of a chunk, of the heading summary of a core record, of a description.
CHUNK, SUMMARY, DESCRIPTION = 6_000, 600, 300


def breadcrumbs(category: Column) -> Column:
    """Where a page stands: its category, nothing for the root."""
    return F.when(category == "root", F.array().cast("array<string>")).otherwise(F.array(category))


def _searchable(texts: Column) -> Column:
    """Texts of an array as search text, with escaped angle brackets as they are meant."""
    return strip_each(nfkc_array(F.transform(texts, lambda t: F.replace(F.coalesce(t, F.lit("")), F.lit("\\<"), F.lit("<")))))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages as an index takes them: ``title`` as search text, the file's name where nothing is left; ``description`` as search text of at most
    DESCRIPTION code points, null where nothing is left; headings and blocks as search text, those with none left out.

    Cleaning isn't idempotent: sections clean blocks again, and chunks their paragraphs once more, as the index does."""
    data = F.col("structured_data")
    rows = pages.withColumn("_heads", _searchable(F.transform(data["headings"], lambda h: h["content"]))).withColumn("_texts", _searchable(F.transform(data["contents"], lambda c: c["content"])))
    with_text = lambda items, texts: F.filter(F.zip_with(items, texts, lambda i, t: i.withField("content", t)), lambda i: i["content"] != "")
    named = path_title(F.coalesce("relative_path", F.lit(""))) if "relative_path" in pages.columns else path_title(F.lit(""))
    return rows.withColumns({
        "title": F.coalesce(F.nullif(search_text(F.coalesce(blank_to_null(F.col("title")), named)), F.lit("")), named),
        "description": F.nullif(cut(search_text(blank_to_null(F.col("description"))), DESCRIPTION), F.lit("")),
        "structured_data": F.when(data.isNotNull(), F.struct(with_text(data["headings"], F.col("_heads")).alias("headings"), with_text(data["contents"], F.col("_texts")).alias("contents"))),
    }).drop("_heads", "_texts")


def core_records(pages: DataFrame) -> DataFrame:
    """One record a page: title, description, category, page_group, url, breadcrumbs, the joined headings as content, keywords."""
    headings = F.coalesce(F.array_join(F.transform("structured_data.headings", lambda h: h["content"]), " · "), F.lit(""))
    return pages.select(
        "page_id", "url", "category", "page_group", "title", F.when(F.trim("description") != "", cut(F.col("description"), DESCRIPTION)).alias("description"),
        breadcrumbs(F.col("category")).alias("breadcrumbs"), cut(headings, SUMMARY).alias("content"), F.concat_ws(" ", "title", "category", "page_group").alias("keywords"),
    )


def fixed_pieces(text: Column, size: int = CHUNK) -> Column:
    """A text in consecutive pieces of ``size`` code points, the last one shorter; none of an empty or null text."""
    n = F.length(text)
    pieces = F.transform(F.sequence(F.lit(0), ((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(n > 0, pieces).otherwise(F.array().cast("array<string>"))


def part_starts(sizes: Column, most: int, joint: int) -> Column:
    """Where parts begin (from 0) if items of these sizes are taken in order and a part ends before an item that would make it more than
    ``most``, with ``joint`` between items. The fold carries two numbers and the starts as text, never the items, so it copies next to nothing."""
    start = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("at"), F.lit("").alias("starts"))

    def step(s: Column, size: Column) -> Column:
        new = (s["at"] == 0) | (s["held"] + size + joint > most)
        starts = F.when(new, F.concat(s["starts"], s["at"].cast("string"), F.lit(","))).otherwise(s["starts"])
        return F.struct(F.when(new, size).otherwise(s["held"] + size + joint).cast("bigint").alias("held"), (s["at"] + 1).alias("at"), starts.alias("starts"))

    listed = F.aggregate(sizes, start, step, lambda s: F.split(s["starts"], ","))
    return F.transform(F.filter(listed, lambda t: t != ""), lambda t: t.cast("int"))


def greedy_chunks(paragraphs: Column, size: int = CHUNK) -> Column:
    """Paragraphs joined by empty lines into chunks of at most ``size`` code points, in order, each as full as it gets."""
    pieces = F.flatten(F.transform(paragraphs, lambda p: fixed_pieces(p, size)))
    # the pieces and their starts are bound by a lambda each, so that they are made once and not for each chunk
    chunks = lambda p, s: F.transform(s, lambda at, i: F.array_join(F.slice(p, at + 1, F.coalesce(F.try_element_at(s, i + 2), F.size(p)) - at), "\n\n"))
    bound = F.transform(F.array(pieces), lambda p: F.element_at(F.transform(F.array(part_starts(F.transform(p, lambda x: F.length(x)), size, 2)), lambda s: chunks(p, s)), 1))
    return F.element_at(bound, 1)


def _contents(column: str, fields: tuple[str, ...]) -> Column:
    """The column's structs reduced to string fields without nulls; none where the column is null."""
    kind = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    return F.coalesce(F.transform(column, lambda c: F.struct(*[F.coalesce(c[f], F.lit("")).alias(f) for f in fields])).cast(kind), F.array().cast(kind))


def sections(pages: DataFrame, clean: bool = True) -> DataFrame:
    """A row for each section of each page: ``section_no`` (0 for the root section, then headings in order, then headings that only
    blocks name), ``heading`` ('' for the root), ``section_title`` and the distinct ``paragraphs`` in order of first appearance. Sections
    without content stay, with no paragraphs. ``clean`` removes markup from the blocks first; it takes ``clean_pages``."""
    blocks = F.col("_blocks")
    rows = pages.withColumn("_blocks", _contents("structured_data.contents", ("heading", "content"))).withColumn("_heads", _contents("structured_data.headings", ("id", "content")))
    if clean:
        stripped = strip_each(F.transform(blocks, lambda b: b["content"]))
        rows = rows.withColumn("_blocks", F.zip_with(blocks, stripped, lambda b, t: F.struct(b["heading"].alias("heading"), t.alias("content"))))
    rows = rows.withColumn("_blocks", F.filter("_blocks", lambda b: b["content"] != ""))
    named = F.array_union(F.transform("_heads", lambda h: h["id"]), F.transform("_blocks", lambda b: b["heading"]))
    one = rows.select("*", F.posexplode(F.array_union(F.array(F.lit("")), named)).alias("section_no", "heading"))
    titles = F.transform(F.filter("_heads", lambda h: h["id"] == F.col("heading")), lambda h: h["content"])
    return one.select(
        "page_id", "url", "category", "page_group", "title", "description", "section_no", "heading",
        F.coalesce(F.nullif(F.try_element_at(titles, F.lit(-1)), F.lit("")), F.col("title")).alias("section_title"),
        F.array_distinct(F.transform(F.filter("_blocks", lambda b: b["heading"] == F.col("heading")), lambda b: b["content"])).alias("paragraphs"),
    )


def body_records(pages: DataFrame, clean: bool = True) -> DataFrame:
    """The chunks of every section as records: one at least for each section, with empty content where it has none; the
    description only on the first chunk of the root section; all chunks of a section share its URL."""
    rows = sections(pages, clean)
    own = F.filter(strip_each(F.col("paragraphs")), lambda p: p != "") if clean else F.col("paragraphs")
    rows = rows.withColumn("paragraphs", own).withColumn("_chunks", greedy_chunks(F.col("paragraphs"))).drop("paragraphs")
    chunks = F.when(F.size("_chunks") == 0, F.array(F.lit(""))).otherwise(F.col("_chunks"))
    root = F.col("heading") == ""
    return rows.select("*", F.posexplode(chunks).alias("chunk_no", "content")).select(
        "page_id", "category", "page_group", "section_no", "chunk_no", "content",
        F.when(root, F.col("title")).otherwise(F.col("section_title")).alias("title"),
        F.when(root & (F.col("chunk_no") == 0) & (F.trim("description") != ""), cut(F.col("description"), DESCRIPTION)).alias("description"),
        F.when(root, breadcrumbs(F.col("category"))).otherwise(F.array("title")).alias("breadcrumbs"),
        F.when(root, F.concat_ws(" ", "title", "category")).otherwise(F.concat_ws(" ", "title", "section_title", "category")).alias("keywords"),
        F.when(root, F.col("url")).otherwise(F.concat("url", F.lit("#"), "heading")).alias("url"),
    )


def record_text() -> Column:
    """All text of a record that is searched: its fields and breadcrumbs that aren't empty, joined by blanks."""
    fields = [F.nullif(F.col(c), F.lit("")) for c in ("title", "description", "content", "keywords")]
    return F.concat_ws(" ", *fields, F.concat_ws(" ", F.filter("breadcrumbs", lambda b: b != "")))
