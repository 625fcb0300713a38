"""Streams: standing answers, counts of statuses, and the scoring of arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import THRESHOLDS
from ..operators.review import QUESTION
from . import tables


def answers_to_keep(stream: DataFrame) -> DataFrame:
    """The columns of answers that the table of standing answers keeps; a missing question is the label as a whole. (STR1)"""
    return stream.select(*[F.coalesce(c, F.lit("")).alias(c) if c == "key" else F.col(c) for c in QUESTION], "decision", "seq")


def standing_answers(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The last answer of each question so far, from a table under `path`; one that was undone is null. (STR1)

    Late records change nothing that a later seq has settled, so no watermark is needed; the state is the table.
    """
    rows = tables.run_upsert(answers_to_keep(stream), path, checkpoint, list(QUESTION), ["seq"])
    return rows.withColumn("decision", F.nullif(F.col("decision"), F.lit("clear")))


def answer_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Answers by kind and day of event time (UTC); records later than `late` are left out. (STR2)"""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "decision").agg(F.count("*").alias("n")).select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("w.start") / 86400).cast("int")).cast("string").alias("day"), "decision", "n")


def counted_answers(stream: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> DataFrame:
    """answer_counts() in a table under `path`. A day's count only grows, so the largest is the last. (STR2)"""
    return tables.run_upsert(answer_counts(stream, late), path, checkpoint, ["day", "decision"], ["n"], "update")


def scored_documents(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Signals of arriving documents (label_id, seq, words array<struct<text,conf,sideways>>), one row a label: those of the document with the largest seq. (STR3)

    A document comes whole, so each is scored by itself: all signals are taken over its array, and nothing is kept between batches.
    """
    letters = lambda w: F.length(F.regexp_replace(w["text"], r"[^\p{L}]", ""))
    n = lambda test: F.size(F.filter("words", test))
    share = lambda test: F.bround(n(test) / F.size("words"), 3)
    th = THRESHOLDS
    total = F.aggregate("words", F.lit(0.0), lambda s, w: s + w["conf"])
    scored = stream.where("size(words) > 0").select(
        "label_id", "seq", F.size("words").cast("long").alias("words"), n(lambda w: (w["conf"] >= th.unreadable_word_conf) & (letters(w) >= 3)).cast("long").alias("clear_words"),
        share(lambda w: w["conf"] >= th.unreadable_word_conf).alias("clear_share"), F.bround(total / F.size("words"), 3).alias("mean_conf"),
        share(lambda w: w["conf"] < th.clear_min_conf).alias("low_share"), n(lambda w: w["sideways"]).cast("long").alias("sideways"),
    )
    return tables.run_upsert(scored, path, checkpoint, ["label_id"], ["seq"])
