"""Chat formatting after cumulative-snapshot collapse. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def rendered_turn() -> Column:
    return F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))


def maximal_conversations(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, n_turns, n_logged, rendered: the conversations that no longer one begins with.

    A chat that is logged after every turn leaves snapshots, each the beginning of the next. The hash of a turn's
    place, role and text, xor-ed over the turns so far, is a rolling hash (two of 64 bits) of every beginning of a
    conversation; conversations whose last hash is that of a proper beginning of another are dropped. Of conversations
    alike in all turns the one with the smallest conv_id stays, and n_logged says how many there were. rendered is
    each turn's role and text in order, between marks.

    Turns are ordered by (turn, role, text), nulls first; rows that repeat in all four columns are one turn. A null
    role is `unknown`, a null text empty; rows of null conv_id are one conversation, ordered before others. Other
    columns are ignored; an empty table gives an empty result. The common hash of a very common conversation or first
    turn is aggregated before it is shuffled.
    """
    scratch = scratch or Scratch(turns.sparkSession, "chat")
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = said.withColumn("place", F.row_number().over(order))
    each = [F.xxhash64(F.lit(seed), "place", "role", "text") for seed in (1, 2)]
    rolling = [F.expr("bit_xor(one)").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.expr("bit_xor(two)").over(order.rowsBetween(Window.unboundedPreceding, 0))]
    said = said.withColumns({"one": each[0], "two": each[1]}).withColumns({"a": rolling[0], "b": rolling[1]})
    said = scratch.save(said.select("conv_id", "place", "a", "b", rendered_turn().alias("turn")), "turns")
    whole = said.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "place").alias("last"), F.max("place").alias("n_turns"))
    # Place n of a hash says how long the beginning is, so a proper one is any that is not some conversation's last row.
    last = whole.select("conv_id", F.col("last.a").alias("a"), F.col("last.b").alias("b"), "n_turns")
    alike = last.groupBy("a", "b", "n_turns").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("least"), F.count("*").alias("n_logged"))
    proper = (
        said.join(whole.select(F.col("conv_id").alias("id"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("id")))
        .where("place < n_turns")
        .select("a", "b", F.col("place").alias("n_turns"))
        .distinct()
    )
    kept = alike.join(proper, ["a", "b", "n_turns"], "left_anti").select(F.col("least.conv_id").alias("kept_id"), "n_turns", "n_logged")
    texts = said.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).groupBy("conv_id", "n_turns", "n_logged").agg(F.array_sort(F.collect_list(F.struct("place", "turn"))).alias("turns"))
    return texts.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_logged", F.array_join("turns.turn", "").alias("rendered"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP5_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT conv_id, row_number() OVER w AS place, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS said
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT conv_id, place, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY place) AS beginning, count(*) OVER (PARTITION BY conv_id) AS n FROM s),
c AS (SELECT n, beginning, min(conv_id) AS conv_id, count(*) AS n_logged FROM p WHERE place = n GROUP BY ALL)
SELECT conv_id, n AS n_turns, n_logged, beginning AS rendered FROM c
WHERE beginning NOT IN (SELECT beginning FROM p WHERE place < n)
"""
