"""Vocabulary cards: modules as ranges of positions, shares of senses, views of a card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is left out of a card in each way to study.
MODES = {"full": (), "compact": ("senses",), "dictation": ("senses", "word", "phonetic"), "translation": ("senses", "meanings")}


def importance(label: Column) -> Column:
    """The first run of digits of a label, null without one."""
    return F.nullif(F.regexp_extract(label, "[0-9]+", 0), F.lit("")).try_cast("bigint")


# What a range of importances is called.
def _named(value: Column) -> Column:
    return F.when(value.isNull(), "重要性未标注").otherwise(F.concat(F.lit("重要性 "), value.cast("string")))


def modules(cards: DataFrame, ranges: DataFrame, position: str = "pos") -> DataFrame:
    """``slug``, ``start``, ``end``, ``n`` (cards), ``first_word``, ``last_word`` and ``importance_range`` of each range of positions. A range that
    reaches beyond the cards has fewer of them than ``end`` - ``start``; see ``outside``."""
    from millrace.operators.relational import range_join

    inside = range_join(cards.select(position, "word", importance(F.col("label")).alias("imp")), position, ranges, "start", "end")
    own = inside.groupBy("slug", "start", "end").agg(
        F.count("*").alias("n"), F.min_by("word", position).alias("first_word"), F.max_by("word", position).alias("last_word"), F.min_by(F.struct("imp"), position)["imp"].alias("a"), F.max_by(F.struct("imp"), position)["imp"].alias("b")
    )
    both = F.when(F.col("a").eqNullSafe(F.col("b")), _named(F.col("a"))).otherwise(F.concat(_named(F.col("a")), F.lit("–"), F.coalesce(F.col("b").cast("string"), F.lit("未标注"))))
    return own.withColumn("importance_range", both).drop("a", "b")


def outside(found: DataFrame) -> DataFrame:
    """Modules whose range isn't wholly within the cards."""
    return found.where("n != `end` - start")


def gaps(ranges: DataFrame) -> DataFrame:
    """Ranges that don't begin where the one before them, by ``start``, ends; the first is to begin at 0. Ranges are numbered by parts of the order
    and joined with the one before, so no task holds all. Starts must differ."""
    from millrace.operators.relational import numbered

    rows = numbered(ranges, ["start"], "_no")
    before = rows.select((F.col("_no") + 1).alias("_no"), F.col("end").alias("_before"))
    return rows.join(before, "_no", "left").where("start != coalesce(_before, 0)").drop("_before", "_no")


def percent(value: Column) -> Column:
    """A share in whole percent between 0 and 100; no number counts as 0."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.least(F.greatest(value, F.lit(-1.0)), F.lit(101.0)) + 0.5).cast("int")))).otherwise(F.lit(0))


def sense_shares(cards: DataFrame) -> DataFrame:
    """``card_id``, ``sense_no``, ``gloss``, ``percentage``: the given percentage, else the sense's part of the counts of its card, where counts below
    zero count as none. All within the card's row."""
    sum_counts = F.aggregate("senses", F.lit(0).cast("bigint"), lambda n, s: n + F.greatest(F.coalesce(s["count"], F.lit(0)), F.lit(0)))
    rows = cards.withColumn("_total", sum_counts).select("card_id", "_total", F.posexplode("senses").alias("sense_no", "s"))
    share = F.when(F.col("_total") <= 0, F.lit(0.0)).otherwise(F.col("s.count") / F.when(F.col("_total") > 0, F.col("_total")) * 100)
    return rows.select("card_id", "sense_no", F.col("s.gloss").alias("gloss"), percent(F.coalesce(F.col("s.percentage"), share)).alias("percentage"))


def view(cards: DataFrame, mode: str) -> DataFrame:
    """Cards as one way to study shows them: the columns it hides are dropped."""
    return cards.drop(*MODES[mode])


def tone(position: Column) -> Column:
    """The colour number of a card by its position from 0."""
    return (position % 7 + 1).cast("int")
