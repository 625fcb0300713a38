"""Sinks: guarded CSV, JSON lines by date, numbered sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.batch import guarded
from ..functions.text import slug


def write_csv(df: DataFrame, path: str) -> None:
    """Text cells are guarded against formulas. (SNK1, SNK2, SNK5)"""
    df.select(*[guarded(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def append_answers(answers: DataFrame, path: str) -> None:
    """Files are complete or absent, so no lock is needed. (SNK4)"""
    answers.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").json(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """(SNK6, SNK8, JS1)"""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def export_name(source: Column, day: Column) -> Column:
    """(SNK3)"""
    return F.concat(slug(source), F.lit("-"), F.date_format(day, "yyyyMMdd"), F.lit(".csv"))


def numbered(prefix: str, n: Column) -> Column:
    """PREFIX-0001 (SNK10)"""
    return F.format_string(f"{prefix}-%04d", n)
