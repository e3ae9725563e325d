"""Mix sources to target weights by drawing fixed-length blocks of words.

1. Each source's documents are laid end to end and cut into blocks of
   ``block`` words. Places come from two-level prefix sums, over buckets of a
   source and within a bucket, so a source that holds a third of all rows is
   never one task.
2. Targets share all words by weight and stop at ``cap`` times a source's size;
   the excess is reshared by weight. The result is ``min(cap * size, level *
   weight)`` with one level for all sources, found by prefix sums over sources.
3. Output slots are dealt in shards of ``shard_slots``. In each shard the source
   counts are a multinomial draw with stratified uniforms: slot ``i`` of ``k``
   draws ``(i + noise) / k`` and takes the source whose share holds it. The
   counts follow in closed form, so no slot is searched for.
4. The ``j``-th slot of a source takes block ``(a * i + b) mod n`` with
   ``i = j mod n`` in round ``j div n``; ``a`` is a prime above every possible
   ``n``, thus each round is a permutation. ``a`` and ``b`` depend on source,
   round and seed. Slots beyond round ``cap`` are not filled.
5. Blocks are joined by (source, block) to the documents that they cover.

Only the source table is ordered as a whole; it has one row per source.

Edge cases: null texts and texts without words have size 0 and are never taken.
A null source is a source of its own, last in order. Repeated rows count each.
An empty table gives no rows. ``hash`` decides everything, so reruns agree.
Limits: a source has fewer than 10**12 blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import cut_lineage

WORD = "[^\\x20\\x09-\\x0D]+"
BUCKET_ROWS = 4_000
#: Primes just above 10**12.
STEPS = (1000000000039, 1000000000061, 1000000000063, 1000000000091, 1000000000121, 1000000000163)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size -> with place (from 0), weight and target."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    out = sizes.withColumn("place", F.row_number().over(order) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1))
    ratio = F.col("source_size") * cap / F.col("weight")
    out = out.withColumn("ratio", ratio)
    steps = Window.orderBy("ratio", "place")
    before = steps.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    capped = F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    heavier = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = out.withColumn("level", (F.sum("source_size").over(whole) - capped) / heavier)
    out = out.withColumn("full", F.col("level") >= F.col("ratio"))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct("ratio", "place"))).over(whole)
    target = F.when(F.col("full"), F.col("source_size") * cap).otherwise(level * F.col("weight")).cast("double")
    return out.select("source", "source_size", "place", "weight", target.alias("target"))


def _drawn(sources: DataFrame, block: int, shard_slots: int, cap: int, seed: int) -> DataFrame:
    """place, block_no, times: how often the output takes each block."""
    n = F.ceil(F.col("source_size") / block)
    src = sources.where("source_size > 0").withColumn("blocks", n).withColumn(
        "need", F.col("target") * F.col("blocks") / F.col("source_size")
    )
    whole, order = Window.partitionBy(), Window.orderBy("place")
    src = src.withColumn("upto", F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    src = src.withColumn("all", F.max("upto").over(whole)).withColumn("high", F.col("upto") / F.col("all"))
    src = src.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    src = src.withColumn("slots", F.round("all").cast("long"))
    shards = src.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / shard_slots))))
    k = F.least(F.lit(shard_slots), F.col("slots") - F.col("shard") * shard_slots)

    def below(x: str) -> Column:
        y = F.col(x) * k
        return F.floor(y) + (_uniform(F.lit(seed), F.col("shard"), F.floor(y)) < y - F.floor(y)).cast("long")

    shards = shards.withColumn("count", below("high") - below("low"))
    earlier = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("first", F.coalesce(F.sum("count").over(earlier), F.lit(0))).where("count > 0")
    shards = shards.repartition("place", "shard")  # the slots are made in many tasks
    slots = shards.select(
        "place", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot")
    ).withColumn("round", F.expr("slot div blocks")).where(F.col("round") < cap)
    pick = F.element_at(
        F.array(*map(F.lit, STEPS)),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("step"), "place", "round"), F.lit(len(STEPS))).cast("int") + 1,
    )
    shift = F.pmod(F.xxhash64(F.lit(seed), F.lit("shift"), "place", "round"), F.col("blocks"))
    product = pick.cast("decimal(19,0)") * (F.col("slot") % F.col("blocks")).cast("decimal(18,0)")
    number = ((product + shift.cast("decimal(18,0)")) % F.col("blocks").cast("decimal(18,0)")).cast("long")
    return slots.select("place", number.alias("block_no")).groupBy("place", "block_no").agg(
        F.count(F.lit(1)).alias("times")
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 32,
    shard_slots: int = 8192, seed: int = 20_011,
) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``."""
    sized = cut_lineage(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    buckets = -(-sized.count() // BUCKET_ROWS) or 1
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)))
    parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    sources = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, cap)
    sources = cut_lineage(sources)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("part").over(earlier), F.lit(0)))
    starts = parts.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        "p.source", "bucket", "base", "place", "source_size", "target"
    )
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size")
    placed = sized.withColumn("line", F.row_number().over(within)).withColumn(
        "inner", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    placed = placed.alias("d").join(
        starts.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket"))
    ).select("doc_id", "size", "place", "d.bucket", "line", "source_size", "target", (F.col("base") + F.col("inner")).alias("at"))
    span = F.when(
        F.col("size") > 0, F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))
    )
    pieces = placed.withColumn("block_no", F.explode_outer(span))
    overlap = F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * block) - F.greatest(
        F.col("at"), F.col("block_no") * block
    )
    # the planner takes the exploded slots for as few rows as the sources; they must not be broadcast
    drawn = _drawn(sources, block, shard_slots, cap, seed).hint("merge")
    taken = pieces.join(drawn, ["place", "block_no"], "left")
    keys = ["place", "bucket", "line", "doc_id", "size", "source_size", "target"]
    return taken.groupBy(*keys).agg(
        F.coalesce(F.sum(overlap * F.coalesce("times", F.lit(0))), F.lit(0)).cast("long").alias("taken")
    ).select("doc_id", "size", "source_size", "target", "taken")
