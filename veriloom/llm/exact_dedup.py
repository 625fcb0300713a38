"""Exact de-duplication: static binary-fuse filters of an immutable snapshot screen the digests of an incoming batch."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, checkpointed

#: Digests in one filter; the bound on what a task holds, whatever the size of the snapshot.
FILTER_KEYS = 200_000


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots of each key, in three neighbouring segments."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _mark(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A binary-fuse filter of 8 bits a slot over distinct uint64 keys: (seed, segment length, segments, slots).

    Keys that own a slot alone are peeled together, round by round; slots are then filled in the reverse order.
    """
    n = len(keys)
    segment = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    size = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))) + segment
    segments = max(1, -(-size // segment) - 2)
    length = (segments + 2) * segment
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        slots = _slots(h, segment, segments)
        rest, rounds = np.arange(n), []
        while len(rest):
            at = slots[:, rest].ravel()
            count = np.bincount(at, minlength=length)
            owner = np.bincount(at, weights=np.tile(rest, 3), minlength=length)
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            peeled, first = np.unique(owner[alone].astype(np.int64), return_index=True)
            rounds.append((peeled, alone[first]))
            rest = rest[~np.isin(rest, peeled, assume_unique=True)]
        if not len(rest):
            table, marks = np.zeros(length, np.uint8), _mark(h)
            for peeled, own in reversed(rounds):
                table[own] = marks[peeled] ^ np.bitwise_xor.reduce(table[slots[:, peeled]], axis=0)
            return seed, segment, segments, table.tobytes()
    raise ValueError("keys of a binary-fuse filter must be distinct")


def may_contain(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
    return np.bitwise_xor.reduce(np.frombuffer(table, np.uint8)[_slots(h, segment, segments)], axis=0) == _mark(h)


def _keys(rows: pa.Table) -> np.ndarray:
    return rows["key"].to_numpy().astype(np.int64).view(np.uint64)


def _filter_of_bucket(rows: pa.Table) -> pa.Table:
    seed, segment, segments, slots = build_filter(_keys(rows))
    kinds = {"bucket": pa.int32(), "seed": pa.int64(), "segment": pa.int64(), "segments": pa.int64(), "slots": pa.binary()}
    return pa.table({k: pa.array([v], kind) for (k, kind), v in zip(kinds.items(), (rows["bucket"][0].as_py(), seed, segment, segments, slots))})


def _screen(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    if not filters.num_rows or not incoming.num_rows:
        return incoming.slice(0, 0)
    f = filters.to_pylist()[0]
    return incoming.filter(pa.array(may_contain(_keys(incoming), f["seed"], f["segment"], f["segments"], f["slots"])))


def snapshot_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One filter for each bucket of the distinct digests (column key) of an immutable snapshot."""
    keyed = digests.select("key").distinct().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").applyInArrow(_filter_of_bucket, "bucket int, seed long, segment long, segments long, slots binary")


def screened(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The distinct incoming digests that the filters let through: all that the snapshot holds, and about 0.4 % of the others."""
    keyed = digests.select("key").distinct().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_screen, "key long, bucket int").select("key")


def mark_copies(docs: DataFrame, incoming: F.Column | None = None) -> DataFrame:
    """All rows and columns of docs (doc_id, text, ...), with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
    doc_id is kept; null ids are smallest, and of rows that repeat that id one is kept. incoming tells the rows of the
    new batch from those of the snapshot; by default the upper half of the range of ids is the batch. Where the line falls
    changes no result: a digest that is in both parts is found by the snapshot's filters, one that repeats in one part by
    grouping that part, and only texts of such digests are compared, byte for byte, in groups that are first combined on
    the map side. Columns of docs with the names of the results are replaced. An empty table gives no rows.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256", "_norm", "_key")
    if incoming is None:
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        incoming = F.coalesce(F.col("doc_id") > F.lit((low + high) // 2 if low is not None else 0), F.lit(False))
    norm = ascii_lower(F.coalesce("text", F.lit("")))
    parts = checkpointed(docs.select(F.xxhash64(norm).alias("key"), incoming.alias("new")).groupBy("key", "new").agg(F.count("*").alias("n")))
    snapshot, batch = parts.where("not new"), parts.where("new")
    buckets = max(1, -(-parts.count() // FILTER_KEYS))
    positives = screened(batch, snapshot_filters(snapshot, buckets), buckets)
    shared = positives.join(snapshot.select("key"), "key", "left_semi")
    suspects = shared.union(parts.where("n > 1").select("key")).distinct()

    keyed = docs.withColumn("_norm", norm).withColumn("_key", F.xxhash64("_norm"))
    ids = keyed.join(suspects.select(F.col("key").alias("_key")), "_key", "left_semi").groupBy("_norm", "doc_id").agg(F.count("*").alias("n"))
    groups = checkpointed(
        ids.groupBy("_norm").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("_tops"))
        .where("group_size > 1").select(F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"), "keep_id", "group_size", "_tops")
    )
    found = keyed.withColumn("text_sha256", F.sha2(F.col("_norm").cast("binary"), 256)).drop("_norm", "_key")
    found = found.join(groups, found["text_sha256"] == groups["_sha"], "left").drop("_sha")
    alone = F.col("group_size").isNull()
    found = found.withColumns({"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1)).cast("long")})
    found = found.withColumn("kept", alone | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if groups.where("_tops > 1").isEmpty():
        return found.drop("_tops")
    repeated = F.coalesce(F.col("_tops"), F.lit(1)) > 1
    nth = F.row_number().over(Window.partitionBy("text_sha256", "kept").orderBy("_row"))
    again = found.where(repeated).withColumn("_row", F.monotonically_increasing_id()).withColumn("kept", F.col("kept") & (nth == 1)).drop("_row")
    return found.where(~repeated).unionByName(again).drop("_tops")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs."""
    return mark_copies(docs).where("kept").select(*docs.columns)
