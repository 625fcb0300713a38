"""What the operators of this subpackage share: reading tables, cutting lineage, row order, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters only; Spark's lower() would also change other alphabets.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words are runs of anything but the six ASCII blanks.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Most rows of a table that is sent to all executors.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column) -> F.Column:
    return F.translate(column, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset in a local session, as in tests, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veriloom-checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def joinable(df: DataFrame) -> DataFrame:
    """A checkpointed df, marked for broadcast if it has BROADCAST_ROWS rows or fewer (of ids and digests: some 100 MB); Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root being the smallest node of the component.

    Large-star and small-star rounds: each links the neighbours of a node to the smallest of them, on the larger side and
    then on the smaller, until no edge changes. Every node ends one edge from its root. The number of rounds is about the logarithm of the longest path.
    A node's neighbours are only aggregated (min), never collected, and each round is checkpointed.
    """
    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        links = checkpointed(small)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
