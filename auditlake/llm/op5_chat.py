"""Operator 5, multi-party perspective rotation of chats, in DataFrame operations only.

For every participant of a conversation (every role but `system`) the dialogue is rendered with that
speaker as assistant and the others as named users. A rendered dialogue is the concatenation, in order, of
its segments; each segment's place in it and the part that is trained on (what the assistant says, end
mark included) are given in characters. Segments rather than one string, so a conversation of any length
is spread over tasks: lengths are summed by block of turns first, and only blocks are summed in order.

A null text is empty; turns without a role are said by `unknown`; a null turn comes first; equal turns are
ordered by role and text and repeated rows are each rendered; a conversation with system turns only has no
participant and gives no row; a null conv_id is a conversation of its own; other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.common import table

#: Turns whose lengths are summed together before blocks are put in order.
BLOCK_TURNS = 256
SYSTEM, UNKNOWN = "system", "unknown"
END = "<|end|>\n"


def perspectives(chats: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, speaker, position, role, name, segment, seg_start, seg_end, mask_start, mask_end (null
    where nothing is trained on)."""
    turns = chats.select("conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("said_by"), F.coalesce("text", F.lit("")).alias("said"))
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 40))).cast("long"))
    speakers = turns.filter(F.col("said_by") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("said_by").alias("speaker")).distinct()
    role = F.when(F.col("said_by") == SYSTEM, SYSTEM).when(F.col("said_by") == F.col("speaker"), "assistant").otherwise("user")
    each = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv").withColumn("role", role)
    each = each.withColumn("name", F.when(F.col("role") == "user", F.col("said_by")))
    head = F.concat(F.lit("<|"), "role", F.coalesce(F.concat(F.lit(":"), "name"), F.lit("")), F.lit("|>\n"))
    each = each.withColumn("segment", F.concat(head, "said", F.lit(END))).withColumn("_head", F.char_length(head)).withColumn("_n", F.char_length("segment").cast("long"))
    key = ["conv_id", "speaker"]
    order = W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = each.groupBy(*key, "block").agg(F.sum("_n").alias("_sum"), F.count("*").alias("_turns"))
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("_speaker"), F.col("block").alias("_block"), F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_base"), F.coalesce(F.sum("_turns").over(order), F.lit(0)).alias("_first"))
    within = W.partitionBy(*key, "block").orderBy("turn", "said_by", "said")
    each = each.withColumn("_end", F.sum("_n").over(within.rowsBetween(W.unboundedPreceding, 0))).withColumn("_row", F.row_number().over(within))
    placed = each.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("speaker") == F.col("_speaker")) & (F.col("block") == F.col("_block")))
    end = F.col("_base") + F.col("_end")
    start = end - F.col("_n")
    own = F.col("role") == "assistant"
    return placed.select("conv_id", "speaker", (F.col("_first") + F.col("_row") - 1).alias("position"), "role", "name", "segment", start.alias("seg_start"), end.alias("seg_end"), F.when(own, start + F.col("_head")).alias("mask_start"), F.when(own, end - 1).alias("mask_end"))


def rendered(segments: DataFrame) -> DataFrame:
    """Whole dialogues of conversations that fit a row: conv_id, speaker, text and trained spans."""
    rows = F.array_sort(F.collect_list(F.struct("position", "segment", "mask_start", "mask_end")))
    spans = F.transform(F.filter("_rows", lambda x: x.mask_start.isNotNull()), lambda x: F.struct(x.mask_start.alias("start"), x.mask_end.alias("end")))
    return segments.groupBy("conv_id", "speaker").agg(rows.alias("_rows")).select("conv_id", "speaker", F.array_join("_rows.segment", "").alias("text"), spans.alias("spans"))


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS said_by, coalesce(text, '') AS said FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, said_by AS speaker FROM turns WHERE said_by <> 'system'
), each AS (
  SELECT t.conv_id, s.speaker, t.turn, t.said_by, t.said,
         CASE WHEN t.said_by = 'system' THEN 'system' WHEN t.said_by = s.speaker THEN 'assistant' ELSE 'user' END AS role
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), named AS (
  SELECT *, CASE WHEN role = 'user' THEN said_by END AS name FROM each
), headed AS (
  SELECT *, '<|' || role || coalesce(':' || name, '') || '|>' || chr(10) AS head FROM named
), said AS (
  SELECT *, head || said || '<|end|>' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER w AS seg_end
  FROM said WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, said_by, said ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, speaker, CAST(position AS BIGINT) AS position, role, name, segment,
       CAST(seg_end - length(segment) AS BIGINT) AS seg_start, CAST(seg_end AS BIGINT) AS seg_end,
       CAST(CASE WHEN role = 'assistant' THEN seg_end - length(segment) + length(head) END AS BIGINT) AS mask_start,
       CAST(CASE WHEN role = 'assistant' THEN seg_end - 1 END AS BIGINT) AS mask_end
FROM placed
"""
