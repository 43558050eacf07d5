"""Chat formatting: a dialogue of several parties, rendered once from each party's side.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, the
others as named users and the context roles (system) as they are; the mask names the spans of the rendered
text that the speaker wrote and that a model should learn.

Only DataFrame functions are used.  A render is cut into blocks of a bounded number of turns, so a
conversation with a third of all rows never meets in one task: the parts of the blocks of a side, in order, make
its whole text, and offsets count from a part's start.  Texts are shuffled once; who takes part is found from narrow columns and meets the blocks under the
same partitioning.

Defined cases: a null speaker is ``unknown``, a null text is empty, rows without a turn come last (in the
order of speaker and text), rows without a conversation are one conversation of their own (conv_id null); a
row that is repeated exactly is one turn; turns of one number are ordered by speaker and text; a conversation
without participants is rendered once, with perspective null and nothing to learn; ``<|`` inside a text is
written ``< |`` so that no text can open or close a turn; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlens.llm.common import Scratch

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTEXT = ("system",)
#: Turn numbers of a block are 2 ** BLOCK_BITS; where one has more rows than that, its block is cut to parts of as many rows.
BLOCK_BITS = 6
#: Rows of such blocks in one range of their order.
ROWS_PER_RANGE = 20_000
#: Most such blocks (about 40 bytes each) that are broadcast after their count has been checked.
BROADCAST_TURNS = 500_000
LAST_BLOCK = (1 << 57) + 1


def turn_table(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """key (never null), conv_id, block, turn, speaker, text."""
    turn = F.col(turn_col).cast("long")
    return conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("key"),
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.shiftright(turn, BLOCK_BITS), F.lit(LAST_BLOCK)).alias("block"),
        turn.alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )


def dealt(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``turns``; where a turn number has very many rows, with part: that of each row in its block's order, else 0.

    Rows of such blocks are dealt to ranges of the order, numbered inside each, and the ranges' counts are summed.
    """
    most = 1 << BLOCK_BITS
    counts = turns.groupBy("key", "block", "turn").agg(F.count(F.lit(1)).alias("n"))
    hot = scratch.save(counts.where(F.col("n") > most).groupBy("key", "block").agg(F.sum("n").alias("rows")), "hot-blocks")
    n_hot, n_rows = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if not n_hot:
        return turns
    few = F.broadcast(hot) if n_hot <= BROADCAST_TURNS else hot
    cold = turns.join(few, ["key", "block"], "left_anti").withColumn("part", F.lit(0).cast("long"))
    order = [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text")]
    # Few characters of a text decide on its range, so that the sample of ranges stays small.
    by = ["key", "block", order[0], "speaker", F.substring("text", 1, 256)]
    rows = turns.join(few, ["key", "block"], "left_semi").distinct().repartitionByRange(max(1, -(-n_rows // ROWS_PER_RANGE)), *by)
    rows = scratch.save(rows.withColumn("range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("key", "block", "range").agg(F.count(F.lit(1)).alias("n"))
    starts = scratch.save(sizes.withColumn("start", F.sum("n").over(Window.partitionBy("key", "block").orderBy("range")) - F.col("n")).drop("n"), "starts")
    inside = F.row_number().over(Window.partitionBy("key", "block", "range").orderBy(*order)) - 1
    placed = rows.withColumn("inside", inside).join(starts, ["key", "block", "range"]).withColumn("part", F.shiftright(F.col("start") + F.col("inside"), BLOCK_BITS))
    return cold.unionByName(placed.select(*cold.columns))


def head_of(speaker: Column, perspective: Column, context: tuple[str, ...]) -> Column:
    name = F.regexp_replace(speaker, r"[\x00-\x20<>|]", "_")
    role = F.when(speaker.eqNullSafe(perspective), F.lit("assistant")).when(speaker.isin(*context), name).otherwise(F.concat(F.lit("user name="), name))
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def spans_of(turns: Column, perspective: Column, context: tuple[str, ...]) -> Column:
    """array<struct<start,end>> of what the perspective's speaker wrote, closing marks included, in code points."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        begin = done["at"] + F.length(head_of(t["speaker"], perspective, context))
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(t["speaker"].eqNullSafe(perspective), F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda done: done["spans"])


def rotate(conversations: DataFrame, scratch: Scratch, context: tuple[str, ...] = CONTEXT, **columns: str) -> DataFrame:
    """conv_id, block, part, perspective, n_turns, rendered, mask (spans to learn) for every participant and block."""
    turns = dealt(turn_table(conversations, **columns), scratch)
    # A constant part would be folded out of the grouping, and blocks would be shuffled again for the join.
    place = [c for c in ("key", "block", "part") if c in turns.columns]
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", "speaker", "text")
    # Equal rows are one turn: a set, made in the map tasks, keeps a row that is repeated very often small.
    blocks = turns.groupBy(*place).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_set(turn)).alias("turns"))
    speakers = turns.where(~F.col("speaker").isin(*context)).select("key", F.col("speaker").alias("perspective")).distinct()
    sides = turns.select(*place).distinct().join(speakers, "key", "left")
    both = blocks.join(sides, place)
    perspective = F.col("perspective")
    segment = lambda t: F.concat(head_of(t["speaker"], perspective, context), t["text"], F.lit(CLOSE + "\n"))
    return both.select(
        "conv_id", "block", (F.col("part") if "part" in place else F.lit(0).cast("long")).alias("part"), "perspective",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", segment), "").alias("rendered"),
        spans_of(F.col("turns"), perspective, context).alias("mask"),
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Scratch(spark, "chat"))
    written = F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return found.withColumn("mask", written)


OP4_SQL = """
WITH crowded AS (
  SELECT DISTINCT conv_id, coalesce(turn >> 6, 144115188075855873) AS block FROM conversations GROUP BY conv_id, turn HAVING count(*) > 64),
turns AS (
  SELECT DISTINCT conv_id, coalesce(turn >> 6, 144115188075855873) AS block, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
parted AS (
  SELECT t.*, CASE WHEN c.block IS NULL THEN 0 ELSE (row_number() OVER (
           PARTITION BY t.conv_id, t.block ORDER BY turn NULLS LAST, speaker, text) - 1) >> 6 END AS part
  FROM turns t LEFT JOIN crowded c ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.block = t.block),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
sides AS (
  SELECT b.conv_id, b.block, b.part, s.perspective FROM (SELECT DISTINCT conv_id, block, part FROM parted) b
  LEFT JOIN speakers s ON s.conv_id IS NOT DISTINCT FROM b.conv_id),
segments AS (
  SELECT s.conv_id, s.block, s.part, s.perspective, t.turn, t.speaker, t.text, t.speaker IS NOT DISTINCT FROM s.perspective AS own,
         '<|im_start|>' || CASE WHEN t.speaker IS NOT DISTINCT FROM s.perspective THEN 'assistant'
           WHEN t.speaker = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(t.speaker, '[\\x00-\\x20<>|]', '_', 'g') END || chr(10) AS head
  FROM sides s JOIN parted t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.block = s.block AND t.part = s.part),
placed AS (
  SELECT *, CAST(length(head) + coalesce(sum(length(head) + length(text) + 11) OVER (
           PARTITION BY conv_id, block, part, perspective ORDER BY turn NULLS LAST, speaker, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM segments)
SELECT conv_id, block, CAST(part AS BIGINT) AS part, perspective, count(*) AS n_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, speaker, text) AS rendered,
       coalesce(string_agg(begins || ':' || (begins + length(text) + 10), ',' ORDER BY begins) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, block, part, perspective
"""
