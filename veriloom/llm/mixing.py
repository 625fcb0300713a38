"""Mixing sources to target weights: blocks of tokens are drawn for output shards by source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words in a block, block slots in an output shard, rounds of the index permutation, cells of the draw table.
BLOCK, SHARD, ROUNDS, CELLS = 64, 16384, 8, 4096
#: Slots that a task numbers, on average, and the most tasks for that.
TASK_SLOTS, MOST_TASKS = 32768, 20_000
SEED = 20240101


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_key() -> list[F.Column]:
    """128 bits of a document's id and text."""
    return [F.xxhash64(F.lit(k), "doc_id", F.col("doc_id").isNull(), "text").alias(f"_k{k}") for k in (1, 2)]


def source_targets(sized: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """One row a source (source, source_size, docs, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn and share the words of all. Targets stop at most times the
    source's size; what is over goes to the others by weight. The level that this ends at is found from running sums over the
    sources in the order in which they reach their limit: target = min(level * weight, most * size).
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("w"))
    whole, order = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(whole) - before) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.col("level"))).over(whole))
    return per.select("source", "source_size", "docs", F.least(F.coalesce("level", F.lit(0.0)) * F.col("w"), F.col("limit")).alias("target"))


def permuted(i, n, *key) -> F.Column:
    """A pseudorandom permutation of 0..n-1 for each key: swap-or-not rounds, which need no walk for any n."""

    def swap(x, r):
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - x, n)
        return F.when(F.pmod(F.xxhash64(r, F.greatest(x, other), F.lit(SEED), *key), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(1, ROUNDS + 1)]), i, swap)


def _slots(plan: DataFrame) -> DataFrame:
    """Output slots (shard, src, j): j counts a source's slots from 0 to its n - 1.

    Each slot of a shard draws its source by a hashed uniform number, so a shard's counts are multinomial. The totals of
    the draws are then settled: slots that a source got over its n are handed to the sources that got less; these differences
    grow as the root of the number of slots. Running totals are taken over one row a shard and source; the slots themselves are
    numbered in tasks of their own, dealt by (shard, source), so a source that holds most slots is spread like any other.
    """
    spark = plan.sparkSession
    total = plan.agg(F.sum("n")).first()[0] or 0
    upto = F.sum("n").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    shares = plan.where("n > 0").withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("n"))
    width = -(-total // CELLS) or 1
    cells = shares.select("src", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    draws = spark.range(total).select(F.floor(F.col("id") / SHARD).alias("shard"), F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(total, 1))).alias("u")).withColumn("cell", F.floor(F.col("u") / width))
    counts = draws.join(cells, "cell").where("u >= lo and u < hi").groupBy("shard", "src").agg(F.count("*").alias("c"))
    counts = checkpointed(counts)
    start = F.coalesce(F.sum("c").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = counts.withColumn("start", start).join(plan.select("src", "n"), "src").repartition(min(MOST_TASKS, max(1, total // TASK_SLOTS)), "shard", "src")
    slots = drawn.select("shard", "src", "n", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("c") - 1)).alias("j"))

    totals = plan.select("src", "n").join(counts.groupBy("src").agg(F.sum("c").alias("t")), "src", "left").select("src", "n", F.coalesce("t", F.lit(0)).alias("t"))
    run = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    over, under = F.greatest(F.col("t") - F.col("n"), F.lit(0)), F.greatest(F.col("n") - F.col("t"), F.lit(0))
    totals = totals.withColumn("over", F.coalesce(F.sum(over).over(run), F.lit(0))).withColumn("under", F.coalesce(F.sum(under).over(run), F.lit(0)))
    spare = slots.where("j >= n").join(totals.select("src", "over"), "src").select("shard", (F.col("over") + F.col("j") - F.col("n")).alias("q"))
    wanted = totals.where("n > t").select("src", "t", "under", F.explode(F.sequence(F.col("t"), F.col("n") - 1)).alias("j")).select("src", "j", (F.col("under") + F.col("j") - F.col("t")).alias("q"))
    return slots.where("j < n").select("shard", "src", "j").unionByName(spare.join(wanted, "q").select("shard", "src", "j"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, most=MOST, block=BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their place in their source's stream, sources with their plan, blocks of the mixture).

    The mixture has rows (shard, src, block, take, slot): slot `slot` of a shard repeats block `block` of a source's stream, of which the first
    `take` words count. Each pass over a source uses every block once, in the order of that pass's permutation; the last
    pass is cut where the target is reached. A source's stream is its documents by (chunk, doc_id), chunk being a hash:
    places are running sums in a chunk plus those of the chunks before, so no source is summed in one task.
    """
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), *text_key())
    sized = checkpointed(sized)
    plan = source_targets(sized, weights, most)
    src = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    size, target = F.col("source_size"), F.col("target")
    plan = plan.withColumn("src", src).withColumn("blocks", F.ceil(size / block).cast("long")).withColumn("passes", F.coalesce(F.floor(target * (1 + 1e-12) / F.nullif(size, F.lit(0))), F.lit(0)))
    plan = plan.withColumn("rest", F.greatest(F.round(target - F.col("passes") * size), F.lit(0.0)).cast("long"))
    plan = plan.withColumn("n", F.col("passes") * F.col("blocks") + F.least(F.ceil(F.col("rest") / block), F.col("blocks")))
    plan = checkpointed(plan)

    chunks = max(64, sized.count() // 20_000)
    placed = sized.join(plan.select(F.col("source").alias("s"), "src", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = placed.groupBy("src", "chunk").agg(F.sum("size").alias("words")).select("src", "chunk", before.alias("head"))
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("src", "chunk").orderBy("doc_id", "size", "_k1", "_k2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("inner", inner).join(heads, ["src", "chunk"]).withColumn("place", F.col("head") + F.col("inner")).drop("inner", "head", "chunk")

    mixed = _slots(plan).join(plan.select("src", "blocks", "n", "rest"), "src")
    last = (F.col("j") == F.col("n") - 1) & (F.col("rest") % block > 0)
    slot = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "src", "j"), "src", "j")) - 1
    mixed = mixed.select("shard", "src", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("src"), F.floor(F.col("j") / F.col("blocks"))).alias("block"), F.when(last, F.col("rest") % block).otherwise(block).alias("take"), slot.alias("slot"))
    return placed, plan, mixed


def blocks_of_words(docs: DataFrame, placed: DataFrame, block=BLOCK) -> DataFrame:
    """Rows (src, block, pieces): each block of the sources' streams, as the pieces of documents that it is made of, in order.

    A piece is (a, n, place, words): n words, joined by blanks, from word a of the block on, of the document at that place of the stream.
    """
    # One shuffle of the texts for the join, and one of the pieces. Rows that repeat share a key; only then are texts made distinct first.
    texts = docs.select(*text_key(), "text")
    if not placed.groupBy("_k1", "_k2").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["_k1", "_k2"])
    here = placed.where("size > 0").select("src", "place", "size", "_k1", "_k2").join(texts, ["_k1", "_k2"])

    def pieces(words):
        def piece(i):
            a, b = F.greatest(F.col("place") - i * block, F.lit(0)), F.least(F.col("place") + F.col("size") - i * block, F.lit(block))
            start = (i * block + a - F.col("place") + 1).cast("int")
            return F.struct(i.alias("block"), a.cast("int").alias("a"), (b - a).cast("int").alias("n"), F.array_join(F.slice(words, start, (b - a).cast("int")), " ").alias("words"))

        return F.transform(F.sequence(F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("size") - 1) / block)), piece)

    # The words are a lambda's variable, so that they are split once a document; explode_outer, as explode has Spark test the size by splitting again.
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = here.select("src", "place", F.explode_outer(F.element_at(F.transform(F.array(words), pieces), 1)).alias("p"))
    whole = F.array_sort(F.collect_list(F.struct("p.a", "p.n", "place", "p.words")))
    return cut.groupBy("src", F.col("p.block").alias("block")).agg(whole.alias("pieces"))


def _filled(docs: DataFrame, placed: DataFrame, mixed: DataFrame, block: int) -> DataFrame:
    """Rows (shard, slot, src, pieces): the slots with the blocks that they take, pieces (place, words) cut where the slot ends."""

    def cut(x):
        left = F.col("take").cast("int") - x["a"]
        return F.struct(x["place"].alias("place"), F.when(x["n"] <= left, x["words"]).otherwise(F.array_join(F.slice(F.split(x["words"], " "), 1, left), " ")).alias("words"))

    rows = mixed.join(blocks_of_words(docs, placed, block), ["src", "block"])
    return rows.select("shard", "slot", "src", F.transform(F.filter("pieces", lambda x: x["a"] < F.col("take")), cut).alias("pieces"))


def mixture(docs: DataFrame, weights=WEIGHTS, most=MOST, block=BLOCK) -> DataFrame:
    """The output shards: rows (shard, slot, source, words), one a slot; slots of a shard count from 0, and words are those of one block of the source.

    Words are runs of anything but ASCII blanks, joined by single blanks. Null and blank texts add nothing; a null source is a source of
    its own; repeated rows are documents of their own; other columns are ignored. An empty table gives no rows.
    """
    placed, plan, mixed = mix_plan(docs, weights, most, block)
    named = _filled(docs, placed, mixed, block).join(F.broadcast(plan.select("src", "source")), "src")
    return named.select("shard", "slot", "source", F.array_join("pieces.words", " ").alias("words"))


def mix(docs: DataFrame, weights=WEIGHTS, most=MOST, block=BLOCK) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken.

    taken: words of the document in the output shards (see mixture), counted in the slots' own words, repeats included; at most `most` times
    size. Null and blank texts have size 0 and nothing taken; a null source is a source of its own; repeated rows are documents of their own.
    A source's words taken miss its target by less than a block. Other columns are ignored. An empty table gives no rows.
    """
    placed, _, mixed = mix_plan(docs, weights, most, block)
    words = _filled(docs, placed, mixed, block).select("src", F.explode("pieces").alias("p"))
    used = words.groupBy("src", F.col("p.place").alias("place")).agg(F.sum(F.size(F.split("p.words", " "))).alias("taken"))
    got = placed.where("size > 0").join(used, ["src", "place"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return got.select(*columns).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns))
