"""Mixing sources to target weights in blocks of a fixed number of words.

The words of a source form one stream, cut into blocks. Every source's number of draws follows from its
target; the draws fall on output shards at random (multinomial counts per shard). A source's slots, in
shard order, go through pseudorandom permutations of its block numbers, one per epoch, and take blocks by
number. No block is used twice before all blocks of its source were used once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismcat.llm.common import numbered
from prismcat.operators.numbering import with_global_index
from prismcat.session import materialise

BLOCK_WORDS = 32
SHARD_SLOTS = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 17
# Rounds of the permutation (swap-or-not), draws dealt out in one row, documents in one running sum.
_ROUNDS, _DEALT, _RUN = 8, 1 << 16, 1 << 11


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (weight, source_size) with ``target``: shares by weight, stopped at ``most`` times the size.

    What a stopped source can't take is shared out again by weight until nothing is above; one small
    sum over the sources a round, and each round stops at least one more of them.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, stopped = 0.0, -1
    while True:
        above = (F.col("source_size") * most <= F.col("weight") * rate) if stopped >= 0 else F.lit(False)
        full, weight, n = sources.agg(
            F.sum(F.when(above, F.col("source_size") * most).otherwise(0.0)),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
            F.count_if(above),
        ).first()
        if n == stopped or not weight:
            break
        rate, stopped = max(0.0, total * share - full) / weight, n
    return sources.withColumn("target", F.least(F.col("source_size") * most, F.col("weight") * rate))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Pseudorandom permutation of 0 .. n-1 at ``index`` (swap-or-not), another one for every key."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(F.lit("swap"), *key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), index, step)


def _pieces(n: Column, size: int) -> Column:
    """Starts of the pieces of 0 .. n-1; none if n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def draw_slots(sources: DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``src_no``, ``shard``, ``block`` of every slot of the mix, for ``sources`` (src_no, blocks, draws)."""
    total = sources.agg(F.sum("draws")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    # numbers of its own, since a few small rows grow into many: Spark would put them into one task
    tasks = max(1, -(-total // (1 << 17)))
    dealt = sources.select("src_no", "draws", F.explode(_pieces(F.col("draws"), _DEALT)).alias("first")).repartition(tasks, "src_no", "first")
    draws = dealt.select("src_no", F.explode(F.sequence("first", F.least(F.col("first") + _DEALT, F.col("draws")) - 1)).alias("k"))
    shard = F.pmod(F.xxhash64(F.lit(seed), "src_no", "k"), F.lit(shards))
    counts = draws.groupBy("src_no", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # dealt out again: the window leaves all counts of a source in one task
    placed = placed.repartition(tasks, "src_no", "shard").join(sources, "src_no")
    slots = placed.select("src_no", "shard", "blocks", F.explode(F.expr("sequence(base, base + n - 1)")).alias("k"))
    epoch = F.expr("k div blocks")
    block = permuted(F.expr("k % blocks"), F.col("blocks"), F.lit(seed), F.col("src_no"), F.col("epoch"))
    return slots.withColumn("epoch", epoch).select("src_no", "shard", block.alias("block"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken`` (words in the mix).

    Sources in code point order, NULL last, get ``weights`` in turn and share ``share`` times all words.
    NULL and empty texts have size 0 and are never taken; NULL is a source of its own. Repeated rows are
    documents of their own. Within a source documents follow each other by a hash of id and text, so the result
    doesn't depend on how the table is stored. Small sources are cut into smaller blocks, about 64 of them.
    """
    sized = numbered(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("_hash")), "mix-docs"
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = with_global_index(per_source, [F.col("source").asc_nulls_last()], "src_no")
    turn = F.array(*map(F.lit, weights))
    ordered = materialise(ordered.withColumn("weight", F.element_at(turn, (F.col("src_no") % len(weights) + 1).cast("int"))), "mix-sources")
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr("source_size div 64"))).cast("long")
    sources = targets(ordered, share, most).withColumn("block_words", block)
    sources = sources.withColumn("blocks", F.expr("(source_size + block_words - 1) div block_words"))
    draws = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    sources = materialise(sources.withColumn("draws", draws), "mix-targets")

    runs = max(1, sized.count() // _RUN)
    known = sources.select("src_no", "source", "block_words")
    keyed = sized.join(known, sized["source"].eqNullSafe(known["source"])).select("_row", "_id", "_hash", "size", "src_no", "block_words")
    # the text counts too, so that rows of one id, or without any, don't share a run
    keyed = materialise(keyed.withColumn("run", F.pmod(F.xxhash64("_id", "_hash"), F.lit(runs))).drop("_hash"), "mix-keyed")
    before = Window.partitionBy("src_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy("src_no", "run").agg(F.sum("size").alias("n")).select("src_no", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src_no", "run").orderBy("_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.filter("size > 0").withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["src_no", "run"])
    placed = placed.withColumn("start", F.col("base") + F.col("inside")).withColumn("end", F.col("start") + F.col("size"))
    pieces = placed.select("_row", "src_no", "block_words", "start", "end", F.explode(F.expr("sequence(start div block_words, (end - 1) div block_words)")).alias("block"))
    words = F.least("end", F.expr("(block + 1) * block_words")) - F.greatest("start", F.expr("block * block_words"))
    times = draw_slots(sources.select("src_no", "blocks", "draws"), seed).groupBy("src_no", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces.select("_row", "src_no", "block", words.alias("words")).join(times.hint("merge"), ["src_no", "block"])
    taken = taken.groupBy("_row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = keyed.join(taken.hint("merge"), "_row", "left").join(sources.select("src_no", "source_size", "target"), "src_no")
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
