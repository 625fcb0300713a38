"""Tables that a stream keeps up to date: one row for each key, the one with the largest order, whatever comes late or twice.

A micro-batch is reduced to one row a key and written beside the ones before; a reader takes the last row of each key over the newest base and the batches
after it. Every so many batches a base takes them in. A batch that is run again after a failure writes the same folder, so nothing counts twice, and no table
passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Batches after which a new base is written.
COMPACTED = 20


def last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key (null is a key too) the one with the largest order; of equal ones, the largest row."""
    others = [c for c in rows.columns if c not in keys]
    ranked = F.struct(*order, *[c for c in others if c not in order])
    return rows.groupBy(*keys).agg(F.max(ranked).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest base and of the batches after it."""
    bases, batches = (spark.read.parquet(f"{path}/{kind}") for kind in ("bases", "batches"))
    newest = bases.agg(F.max("_at")).first()[0]
    return bases.where(F.col("_at") == newest).drop("_at").unionByName(batches.where(F.col("_at") > newest).drop("_at"))


def read_table(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The table as of the batches that are complete."""
    rows = _stored(spark, path)
    return last_rows(rows.where("_filled").drop("_filled"), keys, order)


def _start(spark: SparkSession, path: str, schema) -> None:
    """An empty base and batch before the first one, so that readers find folders. Batch -1 is written by nobody else."""
    empty = spark.createDataFrame([], schema).withColumn("_filled", F.lit(True))
    row = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(False).alias("_filled"))
    for kind in ("bases", "batches"):
        empty.unionByName(row).coalesce(1).write.mode("overwrite").parquet(f"{path}/{kind}/_at=-1")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], mode: str = "append", compacted: int = COMPACTED) -> StreamingQuery:
    """Starts a query that works through what is there, keeps the table under `path` up to date, and stops. Started again with the same folders, it goes on where it ended.

    Rows without a larger order than the stored one change nothing, so late and repeated records do no harm. In update mode the stream's aggregates replace
    those that earlier batches gave.
    """
    spark, schema = stream.sparkSession, stream.schema
    _start(spark, path, schema)

    def store(batch: DataFrame, at: int) -> None:
        last_rows(batch, keys, order).withColumn("_filled", F.lit(True)).write.mode("overwrite").parquet(f"{path}/batches/_at={at}")
        if (at + 1) % compacted == 0:
            known = _stored(batch.sparkSession, path)
            last_rows(known.where("_filled").drop("_filled"), keys, order).withColumn("_filled", F.lit(True)).write.mode("overwrite").parquet(f"{path}/bases/_at={at}")

    return stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], mode: str = "append", compacted: int = COMPACTED) -> DataFrame:
    """Runs upsert_stream() to its end and reads the table."""
    upsert_stream(stream, path, checkpoint, keys, order, mode, compacted).awaitTermination()
    return read_table(stream.sparkSession, path, keys, order)
