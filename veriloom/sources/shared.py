"""The folder that driver and executors share, and tables that are written there to cut a plan."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where that is unset in a local session, as in tests, a temporary folder. A cluster without one raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veriloom-"))
    return context.getCheckpointDir()


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join in which neither side is sent whole to the driver and to every task. Spark takes a table of exploded rows for as small as the file that
    they come from, so it would broadcast words and lines of any number."""
    return df.hint("merge")


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """df in as many parts as a shuffle has: rows of a small file, of which each becomes many, are else the work of one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df, so that a plan that reads it many times has it computed once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def packed(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of one key that stand beside each other in the table, in one batch of it, as one row: the key, and each other column as an array.

    Rows of words or short lines take many times the bytes of their texts wherever they are shuffled; runs of them don't. A key may have several runs, in any order.
    """
    rest = [c for c in rows.columns if c not in key]
    kind = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([*[T.StructField(c, kind[c]) for c in key], *[T.StructField(c, T.ArrayType(kind[c])) for c in rest]])
    names, keys = [*key, *rest], len(key)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n - 1, bool)
            for c in batch.columns[:keys]:
                new |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            ends = pa.array(np.append(starts, n), pa.int32())
            yield pa.RecordBatch.from_arrays([c.take(pa.array(starts)) for c in batch.columns[:keys]] + [pa.ListArray.from_arrays(ends, c) for c in batch.columns[keys:]], names)

    return rows.select(*names).mapInArrow(runs, schema)


def unpacked(runs: DataFrame, *key: str) -> DataFrame:
    """The rows of packed(): what is between the two keeps the runs whole."""
    return runs.select(*key, F.inline(F.arrays_zip(*[c for c in runs.columns if c not in key])))
