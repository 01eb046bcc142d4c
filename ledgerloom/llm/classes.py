"""From classes of equal records and links between classes to records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linked_records(members: DataFrame, links: DataFrame, expand: int, text: str = "class_id") -> DataFrame:
    """Pairs of records (a < b) that are in one class or in linked classes.

    ``text`` tells the texts of a class apart; by default a class is one text. All pairs are written out but for more
    than ``expand`` copies of one text, which keep the form of a star: their least record is paired with each other
    one, and stands for the text in its pairs with other texts of its class and of linked classes. ``class_report`` has
    all members of every class, so nothing is lost.
    """
    copies = members.groupBy("class_id", F.col(text).alias("text")).agg(
        F.count(F.lit(1)).alias("n"), F.min("record").alias("least")
    )
    every = members.select("class_id", F.col(text).alias("text"), "record").join(copies, ["class_id", "text"])
    star = every.where((F.col("n") > expand) & (F.col("record") > F.col("least"))).select(
        F.col("least").alias("a"), F.col("record").alias("b")
    )
    ends = every.where((F.col("n") <= expand) | (F.col("record") == F.col("least"))).select("class_id", "record")
    several = members.groupBy("class_id").count().where("count > 1").select("class_id")
    inside = ends.join(several, "class_id")
    full = inside.alias("x").join(inside.alias("y"), "class_id").where("x.record < y.record").select(
        F.col("x.record").alias("a"), F.col("y.record").alias("b")
    )
    across = (
        links.join(ends.select(F.col("class_id").alias("a"), F.col("record").alias("ra")), "a")
        .join(ends.select(F.col("class_id").alias("b"), F.col("record").alias("rb")), "b")
        .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    )
    return full.unionByName(star).unionByName(across)


def class_report(members: DataFrame, links: DataFrame) -> DataFrame:
    """(record, first, class_size, links): one row per record: its class, named by its least record, the class's size and
    the number of classes linked to it."""
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("class_id").agg(F.min("record").alias("first"), F.count(F.lit(1)).alias("class_size"))
    return members.select("record", "class_id").join(sizes, "class_id").join(ends, "class_id", "left").select(
        "record", "first", "class_size", F.coalesce("links", F.lit(0)).alias("links")
    )
