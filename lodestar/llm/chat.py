"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the whole dialogue is rendered once more: that speaker's
turns as the assistant's, everyone else's as a named user's, system turns as they are. Each turn of
each view is one row with its character offset in the rendered view and the span that is trained
on, so a conversation of any length is never gathered in one row or task: offsets are running sums
within blocks of turns, carried on by running sums over the blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import read

BLOCK = 1024
END = "<|end|>\n"


def perspectives(conversations: DataFrame) -> DataFrame:
    """(conv_id, speaker, turn, role, segment, start, train_start, train_end), a row per turn and view.

    ``start`` is the segment's offset in the view; train_start and train_end bound the characters
    that count as the assistant's (after its header, with the end mark), null where masked. Null
    roles speak as "unknown", null texts are empty, turns follow turn (null last), then role and
    text; equal rows are equal turns. A system role is no participant; a conversation without any
    participant has no view. "<|" in texts and names is broken up so no turn can open a header. Other
    columns may have any names, texts any length; an empty table gives an empty result.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    people = turns.where(F.col("role") != "system").select(F.col("conv_id").alias("conv"), F.col("role").alias("speaker")).distinct()
    views = turns.join(people, F.col("conv_id").eqNullSafe(F.col("conv")))
    header = F.when(F.col("role") == F.col("speaker"), F.lit("<|assistant|>\n")).when(F.col("role") == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user "), safe(F.col("role")), F.lit("|>\n")))
    rows = views.select("conv_id", "speaker", "turn", "role", header.alias("header"), safe(F.col("text")).alias("said"), "text")
    rows = rows.withColumn("segment", F.concat("header", "said", F.lit(END))).withColumn("width", F.length("segment")).withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit((1 << 62))) / BLOCK))
    upto = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("conv_id", "speaker", "block").agg(F.sum("width").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"), "before")
    met = rows.join(heads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("block") == F.col("b")))
    within = Window.partitionBy("conv_id", "speaker", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("width").over(within), F.lit(0))
    mine = F.col("role") == F.col("speaker")
    return met.withColumn("start", start.cast("long")).select(
        "conv_id", "speaker", "turn", "role", "segment", "start",
        F.when(mine, F.col("start") + F.length("header")).cast("long").alias("train_start"),
        F.when(mine, F.col("start") + F.col("width")).cast("long").alias("train_end"))


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(read(spark, sf_dir, "conversations"))


OP4_SQL = r"""
with turns as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce("text", '') as said from conversations),
people as (select distinct conv_id as conv, role as speaker from turns where role <> 'system'),
views as (
  select conv_id, speaker, turn, role, said,
    case when role = speaker then '<|assistant|>' || chr(10) when role = 'system' then '<|system|>' || chr(10)
         else '<|user ' || replace(role, '<|', '< |') || '|>' || chr(10) end as header
  from turns join people on conv_id is not distinct from conv),
segments as (select *, header || replace(said, '<|', '< |') || '<|end|>' || chr(10) as segment from views),
placed as (
  select *, coalesce(sum(length(segment)) over (partition by conv_id, speaker order by turn nulls last, role, said
    rows between unbounded preceding and 1 preceding), 0)::bigint as start from segments)
select conv_id, speaker, turn, role, segment, start,
  case when role = speaker then start + length(header) end as train_start,
  case when role = speaker then start + length(segment) end as train_end
from placed
"""
