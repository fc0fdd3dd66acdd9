"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that speaker as assistant and the others as named users. The
result has one row per rendered message; the segments of one perspective, in order of ``position``, concatenate to its text, and
``start`` and ``stop`` are the segment's characters in it. ``mask_start`` and ``mask_stop`` are those to learn from: what the assistant
says, with the closing mark. As no dialogue is put together in one row or task, a conversation may be of any length.

Defined cases: turns are ordered by turn (null last), role and text; equal turns stay, each in its place; a null text is empty, a null
role is the speaker ``unknown``; turns of a ``context`` role are rendered as such in every perspective and have none of their own; a
conversation of context alone is rendered once, with a null perspective; a null conv_id is one conversation; marks inside texts and
names lose their meaning by a space. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.scratch import Scratch

OPEN, CLOSE = "<|", "|>"
CONTEXT = ("system",)
#: Characters of a text by which turns of one number and role are dealt over ranges.
START = 256


def _safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("< |")), F.lit(CLOSE), F.lit("| >"))


def render(turns: DataFrame, context: Sequence[str] = CONTEXT) -> DataFrame:
    """conv_id, perspective, position, turn, role, name, segment, start, stop, mask_start, mask_stop."""
    scratch = Scratch(turns.sparkSession, "chat")
    text, speaker = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    said = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), speaker.alias("speaker"), text.alias("text"))
    order = [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text")]
    # ranges of turns: a long conversation spans several, and the running sums of each range start from those before it; the start of a
    # text keeps the order of whole texts, and those with an equal start stay in one range
    said = said.repartitionByRange("conv_id", F.col("turn").asc_nulls_last(), "speaker", F.substring("text", 1, START)).withColumn("range", F.spark_partition_id())
    said = scratch.save(said, "turns")
    own = said.where(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = said.join(own, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    role = F.when(F.col("speaker").isin(*context), F.col("speaker")).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    rows = rows.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", _safe(F.col("speaker"))))
    head = F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" "), "name"), F.lit("")), F.lit(CLOSE + "\n"))
    rows = rows.withColumn("head", F.char_length(head)).withColumn("segment", F.concat(head, _safe(F.col("text")), F.lit(f"{OPEN}end{CLOSE}\n")))
    rows = rows.withColumn("length", F.char_length("segment").cast("long"))
    inside = Window.partitionBy("conv_id", "perspective", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "perspective", "range").orderBy(*order)).cast("long")).withColumn("to", F.sum("length").over(inside))
    before = rows.groupBy("conv_id", "perspective", "range").agg(F.count("*").alias("n_range"), F.sum("length").alias("range_length"))
    up = Window.partitionBy("conv_id", "perspective").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("range").alias("r"), F.coalesce(F.sum("n_range").over(up), F.lit(0)).alias("n_before"), F.coalesce(F.sum("range_length").over(up), F.lit(0)).alias("before"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("perspective").eqNullSafe(F.col("p")) & (F.col("range") == F.col("r"))
    stop = F.col("before") + F.col("to")
    start = stop - F.col("length")
    learn = F.col("role") == "assistant"
    return rows.join(before, same).select(
        "conv_id", "perspective", (F.col("n_before") + F.col("n") - 1).alias("position"), "turn", "role", "name", "segment", start.alias("start"), stop.alias("stop"),
        F.when(learn, start + F.col("head")).alias("mask_start"), F.when(learn, stop).alias("mask_stop"),
    )


def oracle(context: Sequence[str] = CONTEXT) -> str:
    """The same as SQL."""
    names = ", ".join(f"'{x}'" for x in context)
    safe = "replace(replace({0}, '<|', '< |'), '|>', '| >')"
    return f"""
    WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
    own AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM said WHERE speaker NOT IN ({names})),
    roles AS (SELECT said.*, perspective, CASE WHEN speaker IN ({names}) THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
              FROM said LEFT JOIN own ON conv_id IS NOT DISTINCT FROM c),
    named AS (SELECT *, CASE WHEN role = 'user' THEN {safe.format('speaker')} END AS name FROM roles),
    headed AS (SELECT *, '<|' || role || coalesce(' ' || name, '') || '|>' || chr(10) AS head FROM named),
    cut AS (SELECT *, head || {safe.format('text')} || '<|end|>' || chr(10) AS segment FROM headed),
    placed AS (SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM cut
               WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text))
    SELECT conv_id, perspective, position, turn, role, name, segment, stop - length(segment) AS start, stop,
           CASE WHEN role = 'assistant' THEN stop - length(segment) + length(head) END AS mask_start, CASE WHEN role = 'assistant' THEN stop END AS mask_stop
    FROM placed"""
