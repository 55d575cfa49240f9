"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation (every role but ``system``) the whole dialogue is rendered once with that speaker as the
assistant, the others as named users, and system turns as system. The mask is the list of character spans [start:end) of the
assistant's contents with their end marks: what a loss may count. Spans and offsets count over the whole dialogue.

A dialogue and perspective is one row, whatever its length. A caller who has very long dialogues can ask for parts: rows of `part_turns` turns each (`part`, by the
place of a turn in its conversation, never by its number), which put together in order are the dialogue and its mask; then no row or group grows with a
conversation. Places and offsets come from running sums within the partitions of a range partitioning by conversation and turn, plus the sums of the
partitions before, so one hot conversation is spread over many tasks until its rows are put together.

In texts and names `<|im_` is written as `<\\|im_`, and line ends in names as blanks, so that no content can forge a turn.

Defined cases: a null text is empty; a null role is the participant ``unknown``; a null turn comes first; a null conv_id
is a conversation; equal turn numbers are ordered by role, then text; repeated rows are rendered as often as they
occur; a conversation of system turns alone has no perspective and no row; an empty table gives none; very long texts are rendered
whole; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

START, END = "<|im_start|>", "<|im_end|>\n"
_ASSISTANT = f"{START}assistant\n"


def _escaped(text: str | Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<\\|im_"))


def _user(role: str | Column) -> Column:
    return F.concat(F.lit(f"{START}user name="), _escaped(F.translate(role, "\r\n", "  ")), F.lit("\n"))


def _placed(turns: DataFrame) -> DataFrame:
    """conv_id, role, head, body of each turn, with its place in the conversation and the characters of the turns before, all speakers as users."""
    own = turns.select(
        turns["conv_id"].alias("conv_id"),
        F.coalesce(turns["turn"].cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(turns["role"].cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"),
    )
    spread = own.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).withColumn("task", F.spark_partition_id())
    head = F.when(F.col("role") == "system", F.lit(f"{START}system\n")).otherwise(_user("role"))
    body = F.concat(_escaped("text"), F.lit(END))
    own = stored(spread, "turns").withColumns({"head": head, "body": body})
    own = own.withColumn("chars", (F.length("head") + F.length("body")).cast("long"))
    within = Window.partitionBy("task", "conv_id").orderBy("turn", "role", "text")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"place": F.row_number().over(within).cast("long") - 1, "at": F.coalesce(F.sum("chars").over(before), F.lit(0))})
    tasks = own.groupBy(F.col("task").alias("t"), F.col("conv_id").alias("c")).agg(F.count("*").alias("n"), F.sum("chars").alias("sum"))
    earlier = Window.partitionBy("c").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    tasks = stored(tasks.select("t", "c", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in ("n", "sum"))), "tasks")
    both = own.join(tasks, (F.col("task") == F.col("t")) & F.col("conv_id").eqNullSafe(F.col("c")))
    return both.select("conv_id", "role", "head", "body", "chars", (F.col("place") + F.col("n_before")).alias("place"), (F.col("at") + F.col("sum_before")).alias("at"))


def rotate(turns: DataFrame, part_turns: int | None = None) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, part, perspective, n_turns, starts_at, n_chars, mask, n_masked, rendered; whole dialogues (part 0) unless part_turns is given."""
    part = F.lit(0).cast("long") if part_turns is None else F.floor(F.col("place") / part_turns)
    own = stored(_placed(turns).withColumn("part", part), "placed")
    parts = own.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", "role", "head", "body", "at"))).alias("turns"), F.sum("chars").alias("chars"), F.min("at").alias("starts_at"))
    # how often each speaker spoke before each part
    spoken = stored(own.filter("role <> 'system'").groupBy("conv_id", "part", "role").agg(F.count("*").alias("n")), "spoken")
    speakers = spoken.select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    grid = own.select("conv_id", "part").distinct().join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    counts = spoken.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("role").alias("r"), "n")
    grid = grid.join(counts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("perspective") == F.col("r")), "left")
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "perspective", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    sides = parts.join(grid, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    # what a turn of the perspective's is longer as the assistant's than as the user's
    more = len(_ASSISTANT) - F.length(_user("perspective"))
    mine = F.filter("turns", lambda t: t["role"] == F.col("perspective"))

    def span(t: Column, i: Column) -> Column:
        start = t["at"] + (F.col("before") + i) * more + len(_ASSISTANT)
        return F.concat_ws(":", start.cast("string"), (start + F.length(t["body"])).cast("string"))

    return sides.select(
        "conv_id", "part", "perspective", F.size("turns").cast("long").alias("n_turns"),
        (F.col("starts_at") + F.col("before") * more).alias("starts_at"), (F.col("chars") + F.col("n") * more).alias("n_chars"),
        F.array_join(F.transform(mine, span), ",").alias("mask"),
        F.aggregate(mine, F.lit(0).cast("long"), lambda a, t: a + F.length(t["body"])).alias("n_masked"),
        F.array_join(F.transform("turns", lambda t: F.concat(F.when(t["role"] == F.col("perspective"), F.lit(_ASSISTANT)).otherwise(t["head"]), t["body"])), "").alias("rendered"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM t),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (
  SELECT k.conv_id, 0::BIGINT AS part, place, perspective, role = perspective AS mine,
    CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
      ELSE '<|im_start|>user name=' || replace(translate(role, chr(13) || chr(10), '  '), '<|im_', '<\|im_') || chr(10) END AS head,
    replace(text, '<|im_', '<\|im_') || '<|im_end|>' || chr(10) AS body
  FROM k JOIN p ON k.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM s)
SELECT conv_id, part, perspective, count(*) AS n_turns, min(pos) AS starts_at, sum(length(head) + length(body))::BIGINT AS n_chars,
  coalesce(string_agg(CASE WHEN mine THEN (pos + length(head))::VARCHAR || ':' || (pos + length(head) + length(body))::VARCHAR END, ',' ORDER BY place), '') AS mask,
  sum(CASE WHEN mine THEN length(body) ELSE 0 END)::BIGINT AS n_masked,
  string_agg(head || body, '' ORDER BY place) AS rendered
FROM o GROUP BY conv_id, part, perspective"""
