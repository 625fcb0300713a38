"""Verdicts against the truth: accuracy, rollups, planted defects, timings by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def outcome(wanted: Column, got: Column) -> Column:
    """right; conservative (a match sent to review); accepted (a problem that passed); false_alarm. (AG7)"""
    ok = F.when(wanted == "match", got == "MATCH").when(wanted == "review", got == "NEAR MATCH").when(wanted == "absent", got == "NOT FOUND").when(wanted == "skip", got == "SKIPPED").otherwise(got == "MISMATCH")
    return F.when(ok, "right").when(got == "NEAR MATCH", "conservative").when(got == "MATCH", "accepted").otherwise("false_alarm")


def expectations(text: Column) -> Column:
    """key=value;key=value as a map. (PR9)"""
    return F.str_to_map(text, F.lit(";"), F.lit("="))


def score_fields(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds wanted and outcome to results (id, key, expected, verdict); truth has (id, expect). Blank values are to be skipped. (JN9)"""
    wanted = F.coalesce(F.get(F.map_values(F.map_filter("expect", lambda k, v: k == F.col("key"))), F.lit(0)), F.when(F.trim("expected") == "", "skip").otherwise("match"))
    rows = results.join(truth.select("id", expectations(F.col("expect")).alias("expect")), "id").withColumn("wanted", wanted)
    return rows.withColumn("outcome", outcome(F.col("wanted"), F.col("verdict"))).drop("expect")


def tally(scored: DataFrame, *by: str) -> DataFrame:
    """Counts of outcomes by the given columns and in total, where these are null. (AG7, AG8)"""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("right", "conservative", "accepted", "false_alarm")]
    return scored.rollup(*by).agg(F.count("*").alias("n"), *counts)


def planted_audit(results: DataFrame) -> DataFrame:
    """Per defect: how many were caught, sent to review, and passed, from (defect, status). (AG9)"""
    return results.groupBy("defect").agg(F.count("*").alias("planted"), F.count_if(F.col("status") == "FAIL").alias("caught"), F.count_if(F.col("status") == "REVIEW").alias("review"), F.count_if(F.col("status") == "PASS").alias("passed"))


def by_rank(df: DataFrame, value: str, place, *by: str) -> DataFrame:
    """The value at a rank (0-based) that place makes of the group's size n, in sorted order; no interpolation. (AG10, AG11)

    Rows are counted by value first; the running count finds the rank. Repeated values so cost one row, and nothing is collected.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy(value)
    rows = counts.withColumns({"upto": F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy(*by))})
    at = place(F.col("n"))
    return rows.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*by, F.col(value).alias("at_rank"))


def p95(df: DataFrame, value: str, *by: str) -> DataFrame:
    return by_rank(df, value, lambda n: F.floor(F.lit(0.95) * (n - 1)), *by)


def upper_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    return by_rank(df, value, lambda n: F.floor(n / 2), *by)


def stratified(df: DataFrame, permit: str, strata: list[str], n: int, seed: int = 1) -> DataFrame:
    """One row a permit, then strata in turn, n in all; the draw is by the MD5 of seed:permit. (WN6)"""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(permit).cast("string")))
    first = df.groupBy(permit).agg(F.min_by(F.struct(*df.columns), F.struct(*sorted(c for c in df.columns if c != permit))).alias("r")).select("r.*")
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(draw, permit))
    return first.withColumn("turn", turn).orderBy("turn", *strata).limit(n)
