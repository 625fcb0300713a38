"""Pairs of near texts and numbers, found by equi-joins on what near ones must have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_edits(texts: DataFrame, most: int) -> DataFrame:
    """(a, b, distance): the pairs a < b of different texts (column text) at most `most` edits apart. (FZ4)

    Of a text's most + 1 pieces an edit touches one, so another text within `most` edits holds one of them unchanged, at most `most` places away. Pieces meet such
    places by (length, number of the piece, piece); a length that differs by more is never looked for. Texts shorter than most + 1 have empty pieces,
    which meet every text of a fitting length: those are near by their lengths alone, or nearly so.
    """
    n = most + 1
    rows = texts.select("text").where("text is not null").distinct().withColumn("size", F.length("text"))
    start = lambda i, size: F.floor(i * size / n).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(most)))
    own = rows.select("text", "size", each.alias("i"))
    piece = lambda at: F.substring("text", at + 1, start(F.col("i") + 1, F.col("size")) - start(F.col("i"), F.col("size")))
    own = own.select(F.col("text").alias("x"), "size", "i", piece(start(F.col("i"), F.col("size"))).alias("piece"))
    lengths = F.sequence(F.greatest(F.length("text") - most, F.lit(0)), F.length("text") + most)
    other = rows.select("text", F.explode(lengths).alias("size")).select("text", "size", each.alias("i"))
    other = other.select("text", "size", "i", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")).withColumn("at", start(F.col("i"), F.col("size")) + F.col("shift")).where("at >= 0")
    other = other.select(F.col("text").alias("y"), "size", "i", piece(F.col("at")).alias("piece")).distinct()
    pairs = own.join(other, ["size", "i", "piece"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", most)).where(F.col("distance").between(0, most))


def one_digit_apart(numbers: DataFrame) -> DataFrame:
    """(a, b): the pairs a < b of whole numbers (column value) with as many digits that differ in one of them. They meet where the same digit is left out. (FZ7)"""
    rows = numbers.select("value").where("value is not null").distinct().withColumn("s", F.col("value").cast("string"))
    without: Column = F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.concat(F.substring("s", F.lit(1), i - 1), F.lit("*"), F.substring("s", i + 1, F.length("s"))))
    cut = rows.select("value", F.explode(without).alias("rest"))
    return cut.select(F.col("value").alias("a"), "rest").join(cut.select(F.col("value").alias("b"), "rest"), "rest").where("a < b").select("a", "b").distinct()
