"""Mixing sources to target weights by a low-discrepancy schedule.

The points frac(s * golden ratio) of the slots s = 0, 1, ... fall into the cumulative target shares of the
sources; a source's slots are ranked and take its blocks in turn.  Blocks are equal numbers of words of the
source's documents in shuffled order, so a long document spans several blocks and a block several documents.
A block has the same words whatever the input's size, and the slots grow with the input.  The few slots by
which a source misses its target after the schedule are added or taken away, so that a source comes within a
block of it, however small its share.

Everything is DataFrame operations.  Sums over a source's documents are made in hash buckets first, so a
source with a third of all rows is spread over many tasks.

Defined cases: a null source is a source of its own, last in order; a null or empty text has size 0 and is
never taken; a source without words has target 0; repeated rows are separate documents; the same seed gives
the same mix again; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlens.llm.common import BROADCAST_IDS, WORD, Scratch, documents, fresh, row_key, text_or_empty

GOLDEN = 0.6180339887498949
WEIGHTS = (3, 1, 2)
#: Words of a block.
BLOCK = 32
#: Intervals of [0, 1) by which points find their source, at least.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> + weight, target: shares by weight, none above ``most`` times its size.

    The level at which the excess comes to rest is found in closed form: with the sources in order of
    size / weight, those before the level stop at their limit and the rest share what remains.  One row a
    source goes through these windows, never the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(float(share)),
        "stopped": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = (F.col("total") - F.col("stopped")) / F.col("open")
    fits = level <= F.col("limit") / F.col("weight")
    first = F.min(F.when(fits, F.struct("stopped", level.alias("level")))).over(everything)
    rest = F.coalesce(first["level"], F.max(F.col("limit") / F.col("weight")).over(everything))
    return filled.withColumn("target", F.least(F.col("limit"), rest * F.col("weight"))).select("source", "source_size", "weight", "target")


def schedule(sources: DataFrame, block: int, slots: int) -> DataFrame:
    """source_id, slot, rank, block_id.  ``sources``: source_id, source_size, target.

    Slots from ``slots`` on are those added to sources that the points gave too few.
    """
    cells = max(CELLS, 4 * sources.count())
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    wanted = sources.where("target > 0").withColumn("blocks", blocks).withColumn("quota", F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"))
    in_order = Window.orderBy("source_id")
    up_to = F.sum("target").over(in_order) / F.sum("target").over(Window.partitionBy())
    # An end is the next source's start, so that each point has one source.
    ends = wanted.withColumn("up_to", up_to).withColumn("from", F.lag("up_to", 1, 0.0).over(in_order)).withColumn("up_to", F.when(F.lead("source_id").over(in_order).isNull(), 2.0).otherwise(F.col("up_to")))
    first, last = F.greatest(F.lit(0), F.floor(F.col("from") * cells) - 1), F.least(F.lit(cells), F.floor(F.col("up_to") * cells) + 1)
    split = ends.withColumn("cell", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % 1.0).alias("point")).withColumn("cell", F.floor(F.col("point") * cells).cast("int"))
    hit = points.join(split, "cell").where("point >= `from` AND point < up_to").select("slot", "source_id", "blocks", "quota")
    # Ranks in two steps: within a run of slots, then the run's place among the source's runs.
    run = F.shiftright("slot", max(12, slots.bit_length() // 2))
    runs = hit.groupBy("source_id", run.alias("run")).agg(F.count(F.lit(1)).alias("n"))
    offset = runs.withColumn("offset", F.sum("n").over(Window.partitionBy("source_id").orderBy("run")) - F.col("n"))
    ranked = hit.withColumn("run", run).withColumn("in_run", F.row_number().over(Window.partitionBy("source_id", "run").orderBy("slot")) - 1)
    rank = (F.col("offset") + F.col("in_run")).alias("rank")
    placed = ranked.join(offset.select("source_id", "run", "offset"), ["source_id", "run"]).select("source_id", "slot", rank, "blocks", "quota").where("rank < quota").drop("quota")
    met = wanted.join(runs.groupBy("source_id").agg(F.sum("n").alias("met")), "source_id", "left").withColumn("met", F.coalesce("met", F.lit(0)))
    missed = met.where("met < quota").withColumn("rank", F.explode(F.sequence(F.col("met"), F.col("quota") - 1))).select("source_id", (F.lit(slots) + F.col("rank") - F.col("met")).alias("slot"), "rank", "blocks")
    return placed.unionByName(missed).withColumn("block_id", F.col("rank") % F.col("blocks"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"))


def mix(docs: DataFrame, scratch: Scratch, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes of each row of doc_id, source, size."""
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = scratch.save(docs.select("doc_id", "source", "size", order.alias("order")), "sizes")
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, min(1 << 16, n_rows // 512))
    bucket = F.pmod(F.col("order"), F.lit(buckets)).cast("int")
    sums = scratch.save(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")), "bucket-sums")
    sources = scratch.save(targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), share, most, weights).withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")), "targets")
    block = BLOCK
    plan = scratch.save(schedule(sources, block, int(total * share) // block), "schedule")

    # A document's place in its source: the buckets before its own, then the documents before it in the bucket.
    keyed = sums.join(F.broadcast(sources) if sources.count() < 100_000 else sources, sums["source"].eqNullSafe(sources["source"])).select("source_id", "bucket", sums["source"].alias("source"), "n", "source_size", "target")
    starts = scratch.save(keyed.withColumn("start", F.sum("n").over(Window.partitionBy("source_id").orderBy("bucket")) - F.col("n")).drop("n"), "starts")
    # Positions: one bucket holds about 512 rows of all sources together.
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id")
    inside = rows.withColumn("bucket", bucket).withColumn("inside", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).withColumn("nth", F.row_number().over(within))
    placed = inside.join(starts, inside["source"].eqNullSafe(starts["source"]) & (inside["bucket"] == starts["bucket"])).select("doc_id", "nth", inside["bucket"].alias("bucket"), "size", "source_id", "source_size", "target", (F.col("start") + F.col("inside")).alias("begin"))

    uses = plan.groupBy("source_id", "block_id").agg(F.count(F.lit(1)).alias("times"))
    last = F.floor((F.col("begin") + F.greatest(F.col("size") - 1, F.lit(0))) / block)
    parts = placed.withColumn("block_id", F.explode(F.sequence(F.floor(F.col("begin") / block), last))).join(uses, ["source_id", "block_id"], "left")
    overlap = F.least(F.col("begin") + F.col("size"), (F.col("block_id") + 1) * block) - F.greatest("begin", F.col("block_id") * block)
    taken = F.sum(F.greatest(overlap, F.lit(0)) * F.coalesce("times", F.lit(0)))
    keys = ["source_id", "bucket", "nth", "doc_id", "size", "source_size", "target"]
    return parts.groupBy(*keys).agg(taken.cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def resample(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, **options) -> DataFrame:
    """The rows of ``docs`` in the mix, with all columns, each as often as its taken words make whole texts.

    A part of a text counts as a whole or as none by a hash of the id, in proportion, so that sources still
    come near their targets.  Rows that share an id are repeated alike; those without id are named by their text.
    """
    key, copies = fresh(docs, "key"), fresh(docs, "copies")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    sizes = keyed.select(F.col(key).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"))
    taken = mix(sizes, scratch, seed=seed, **options).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + part)).otherwise(F.lit(0)).cast("int")
    changed = scratch.save(taken.select(F.col("doc_id").alias(key), times.alias(copies)).where(F.col(copies) != 1), "copies")
    joined = keyed.join(F.broadcast(changed) if changed.count() <= BROADCAST_IDS else changed, key, "left")
    repeated = joined.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.coalesce(F.col(copies), F.lit(1)))))
    return repeated.select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(documents(spark, sf_dir)), Scratch(spark, "mixing"))
