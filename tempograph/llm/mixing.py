"""Mixing sources to target weights by a low-discrepancy source schedule, with DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words of all; a target
stops at MAX_EPOCHS times its source's words, and the excess goes to the others by weight until none is above.
The fixed point of that is min(cap, level * weight) for one level, found from a running sum over sources.

Schedule: slot t is the golden-ratio point (t * F44 mod F45) / F45 (consecutive Fibonacci numbers, so integers
only), which falls into one source's interval of the cumulative targets; slots are ranked per source.  There are as many slots
as blocks of BLOCK words in all targets, so a source gets its share of them but for the sequence's discrepancy, a few blocks.  A
source that no point meets gets one slot at the end, cut to its target.

Blocks: each source's documents, shuffled by a seeded hash, form a line of words, run through again and again and cut into
blocks of BLOCK words, the same for all sources; the slot of rank r takes block r.  After MAX_EPOCHS times the line ends, and
so does the block in which that falls.  Block and document intervals meet by a join on (source, rank), so no task sees a
whole source.  What a document gives is the sum over the slots' blocks.

BLOCK (`block_size`): so that the smallest target has BLOCKS blocks, from LEAST_BLOCK to MOST_BLOCK words, but no more than
MOST_SLOTS slots in all.  A few blocks more or less are then within about a hundredth of each target.

A document is thus taken at most MAX_EPOCHS times.  Windows over sources, and over buckets of ROWS_PER_BUCKET rows or slots of a
source, run in one task each: a row per source, and a row per bucket (a source of 10^9 documents has 500,000).
Nulls: a null source is a source of its own (last), a null text has 0 words.  Documents of 0 words are never
taken.  Empty tables give empty results; very long texts are many blocks.  Other columns are ignored; rows equal in id and size
are interchangeable, ties of the shuffle go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets, hash_bucket, hash_order, running, stored, table, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCKS, LEAST_BLOCK, MOST_BLOCK, MOST_SLOTS = 250, 4, 2048, 1 << 22
ROWS_PER_BUCKET = 2_000
#: consecutive Fibonacci numbers; their ratio is the golden ratio to 18 digits
F44, F45 = 701408733, 1134903170


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, words) with weight, target and the bounds lo and hi of cumulative targets.

    One row per source: its windows run over sources, not over documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")))
    s = s.withColumn("_cap", (max_epochs * F.col("words")).cast("long"))
    # by cap per weight: sources before this one are at their caps if the level is above this one's
    by_cap = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy()
    s = s.withColumns({
        "_total": F.sum("words").over(all_rows), "_w": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "_used": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
    })
    s = s.withColumn("_level", (F.col("_total") - F.col("_used")) / F.col("_w"))
    free = F.col("_level") * F.col("weight") <= F.col("_cap")  # this one and all after it are under their caps
    s = s.withColumn("_at", F.max(F.when(free, F.col("_level"))).over(all_rows))
    s = s.withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_at") * F.col("weight"), F.col("_cap").cast("double"))))
    named = by_name.rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumns({"quota": F.floor(F.col("target") + F.lit(1e-6)).cast("long")})
    s = s.withColumns({"hi": F.sum("quota").over(named), "_sum": F.sum("quota").over(all_rows)}).withColumn("lo", F.col("hi") - F.col("quota"))
    return s.drop("_cap", "_w", "_used", "_level", "_at", "_total")


def block_size(total: int, least: int) -> int:
    """Words of a block for targets of so many words together, the smallest positive one of least."""
    return max(total // MOST_SLOTS, min(MOST_BLOCK, max(LEAST_BLOCK, least // BLOCKS)), 1)


def schedule(target: DataFrame, total: int, block_words: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Slots (slot, source, rank, begin, length): words begin to begin + length of the source's line."""
    spark = target.sparkSession
    n = max(1, -(-total // block_words))
    # interval of lattice residues; slots are found from the cumulative targets by a range join on 4,096 cells
    cells = 4096
    point = (F.col("slot") % F45 * F44 % F45).cast("long")
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("_u")).withColumn("_cell", F.expr(f"_u * {cells}L div {F45}L"))
    t = target.where("quota > 0")
    bound = lambda c: F.ceil(F.col(c) / F.col("_sum") * F45).cast("long")
    t = t.select("source", "words", "quota", bound("lo").alias("_lo"), bound("hi").alias("_hi"))
    t = t.withColumn("_cell", F.explode(F.expr(f"sequence(_lo * {cells}L div {F45}L, least(_hi, {F45 - 1}L) * {cells}L div {F45}L)")))
    hit = slots.join(t, "_cell").where("_u >= _lo AND _u < _hi").select("slot", "source", "words", F.lit(block_words).cast("long").alias("_full"))
    missed = target.where("quota > 0").join(hit.select(F.col("source").alias("_s")).distinct(), F.col("source").eqNullSafe(F.col("_s")), "left_anti")
    hit = hit.unionByName(missed.select(F.lit(n).cast("long").alias("slot"), "source", "words", F.least("quota", F.lit(block_words).cast("long")).alias("_full")))
    hit = hit.withColumns({"_one": F.lit(1).cast("long"), "_b": F.expr(f"slot div {ROWS_PER_BUCKET}L")})
    hit = running(hit, ["source"], "_b", ["slot"], "_one", "rank")
    hit = hit.withColumn("begin", F.col("rank") * block_words).withColumn("length", F.least("_full", max_epochs * F.col("words") - F.col("begin")))
    return hit.where("length > 0").select("slot", "source", "rank", "begin", "length")


def pieces(docs: DataFrame, block_words: int | None = None, seed: str = "mix", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, others: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """docs (id, source, size, and others that tell rows apart; the rest is left out) as (documents, pieces).

    documents: with at (place on the source's line), words, target.  pieces: a row for each part of a document
    in a slot's block: source, at, size, epoch, slot, rank, from_word, to_word (words of the document).
    """
    docs = docs.select("id", "source", "size", *others).withColumn("_h", hash_order(seed, "id", "size"))
    n = docs.count()
    target = stored(targets(docs.groupBy("source").agg(F.sum("size").alias("words")), weights, max_epochs), "mix_targets", n)
    total, least = target.where("quota > 0").agg(F.coalesce(F.sum("quota"), F.lit(0)), F.coalesce(F.min("quota"), F.lit(0))).first()
    block = block_words or block_size(total, least)
    df = docs.withColumn("_b", hash_bucket(F.col("_h"), buckets(n, ROWS_PER_BUCKET)))
    df = running(df, ["source"], "_b", ["_h", "id", "size", *others], "size", "at").drop("_b", "_h")
    slots = stored(schedule(target, total, block, max_epochs), "mix_slots", total // block + n)
    ends = slots.groupBy(F.col("source").alias("_c")).agg(F.max(F.col("begin") + F.col("length")).alias("_end"))
    t = target.select(F.col("source").alias("_s"), "words", "target")
    t = t.join(ends, F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_c")
    df = stored(df.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix_documents")
    part = df.where("size > 0 AND _end > 0").select("source", "at", "size", "words", "_end", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    part = part.withColumn("_from", F.col("at") + F.col("epoch") * F.col("words")).withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_end")))
    part = part.where("_from < _to").withColumn("rank", F.explode(F.expr(f"sequence(_from div {block}L, (_to - 1) div {block}L)")))
    s = slots.select(F.col("source").alias("_s"), F.col("rank").alias("_r"), "slot", "begin", "length")
    hit = part.join(s, part["source"].eqNullSafe(F.col("_s")) & (part["rank"] == F.col("_r")))
    lo, hi = F.greatest(F.col("_from"), F.col("begin")), F.least(F.col("_to"), F.col("begin") + F.col("length"))
    hit = hit.withColumns({"from_word": lo - F.col("_from"), "to_word": hi - F.col("_from")}).where("from_word < to_word")
    return df.drop("_end"), hit.select("source", "at", "size", "epoch", "slot", "rank", "from_word", "to_word")


def taken(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """documents with taken (the words that the slots take of each, repeats counted) and first_slot (null if none does)."""
    sums = parts.groupBy(F.col("source").alias("_s"), F.col("at").alias("_a"), F.col("size").alias("_z")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"))
    on = documents["source"].eqNullSafe(F.col("_s")) & (documents["at"] == F.col("_a")) & (documents["size"] == F.col("_z"))
    return documents.join(sums, on, "left").withColumn("taken", F.coalesce(F.col("taken"), F.lit(0)).cast("long")).drop("_s", "_a", "_z")


def op10_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    documents, parts = pieces(stored(docs, "mix_sizes"))
    return taken(documents, parts).select(F.col("id").alias("doc_id"), "size", F.col("words").alias("source_size"), "target", "taken", "source", "first_slot")
