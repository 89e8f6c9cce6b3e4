"""Operator 3: preference pairs with a common prompt and masked completions.

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns (equal role and text) is rendered once, as the prompt; the turns behind
it make two completions. A completion is a list of segments (text, trained):
of a turn of the trained role its text and end mark are trained, everything
else is masked. A pair is `usable` if both completions train something.

All is done in DataFrame functions with one shuffle, on the pair's number. A
pair is one training example and must fit a row, as in any format of this kind;
nothing else is ever gathered.

Turns are ordered by turn (nulls first), role, text; repeated rows are turns of
their own. Null roles and texts count as empty, also in that order; an empty turn
is rendered with its marks. Turns without a conversation belong to no pair and give no row. A
pair with one side only has no prompt turns and a null for the missing side.
Equal conversations give empty completions. Texts are rendered unchanged, even
if they hold marks: masks follow turns, not marks. An empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, table

START, END, TRAINED_ROLE = "<|im_start|>", "<|im_end|>", "assistant"


def by_neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of tables that name none: conversation 2k is the chosen, 2k + 1 the rejected one of pair k."""
    conv = F.col("conv_id").cast("long")
    return picked(conversations, "conv_id", "turn", "role", "text").where(conv.isNotNull()).select(F.floor(conv / 2).cast("long").alias("pair_id"), (F.pmod(conv, F.lit(2)) == 1).alias("rejected"), "turn", "role", "text")


def _segments(turns: Column) -> Column:
    trained = lambda t: t["role"] == TRAINED_ROLE
    part = lambda text, flag: F.struct(text.alias("text"), flag.alias("trained"))
    return F.flatten(F.transform(turns, lambda t: F.array(part(F.concat(F.lit(START), t["role"], F.lit("\n")), F.lit(False)), part(F.concat(t["text"], F.lit(END)), trained(t)), part(F.lit("\n"), F.lit(False)))))


def text_of(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def format_pairs(turns: DataFrame) -> DataFrame:
    """turns(pair_id, rejected, turn, role, text) -> a row for each pair: n_prompt_turns, n_chosen_turns, n_rejected_turns, prompt, chosen, rejected, usable."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = picked(turns, "pair_id", "rejected", "turn", "role", "text").where(F.col("pair_id").isNotNull() & F.col("rejected").isNotNull()).select("pair_id", "rejected", F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    side = lambda flag: F.sort_array(F.collect_list(F.when(F.col("rejected") == flag, F.col("t"))))
    pairs = rows.groupBy("pair_id").agg(side(False).alias("a"), side(True).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("n", F.when(differs == 0, F.size("a")).otherwise(differs - 1).cast("int"))
    rest = lambda c: F.when(F.size(c) > 0, F.slice(c, F.col("n") + 1, F.size(c)))
    pairs = pairs.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), text_of(_segments(F.slice("a", F.lit(1), F.col("n")))).alias("prompt"), rest("a").alias("a"), rest("b").alias("b"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    trains = lambda c: F.coalesce(F.exists(c, lambda t: t["role"] == TRAINED_ROLE), F.lit(False))
    sizes = [F.when(F.col(c).isNull(), 0).otherwise(count(c)).cast("long").alias(n) for c, n in (("a", "n_chosen_turns"), ("b", "n_rejected_turns"))]
    return pairs.select("pair_id", "n_prompt_turns", *sizes, "prompt", _segments(F.col("a")).alias("chosen"), _segments(F.col("b")).alias("rejected"), (trains("a") & trains("b")).alias("usable"))


def mask_of(segments: Column) -> Column:
    """trained:characters of each segment, comma-joined."""
    return F.array_join(F.transform(segments, lambda s: F.concat_ws(":", s["trained"].cast("int").cast("string"), F.length(s["text"]).cast("string"))), ",")


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    sides = [x for c in ("chosen", "rejected") for x in (digest(text_of(F.col(c))).alias(f"{c}_sha256"), mask_of(F.col(c)).alias(f"{c}_mask"))]
    pairs = format_pairs(by_neighbours(table(spark, sf_dir, "conversations")))
    return pairs.select("pair_id", "n_prompt_turns", "n_chosen_turns", "n_rejected_turns", digest(F.col("prompt")).alias("prompt_sha256"), *sides, "usable")


SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 1 AS rejected, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
j AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k, a.k IS NOT NULL AND b.k IS NOT NULL AND a.role = b.role AND a.text = b.text AS same
  FROM (SELECT * FROM t WHERE NOT rejected) a FULL JOIN (SELECT * FROM t WHERE rejected) b ON a.pair_id = b.pair_id AND a.k = b.k),
n AS (SELECT pair_id, coalesce(min(k) FILTER (WHERE NOT same) - 1, max(k)) AS n FROM j GROUP BY pair_id),
s AS (
  SELECT t.pair_id, n.n, t.rejected, k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS whole, role = 'assistant' AS trained,
    '0:' || (13 + length(role)) || ',' || CASE WHEN role = 'assistant' THEN '1' ELSE '0' END || ':' || (length(text) + 10) || ',0:1' AS mask
  FROM t JOIN n ON t.pair_id = n.pair_id),
g AS (
  SELECT pair_id, any_value(n) AS n, count(*) FILTER (WHERE NOT rejected) AS n_a, count(*) FILTER (WHERE rejected) AS n_b,
    coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE NOT rejected AND k <= n), '') AS prompt,
    coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE NOT rejected AND k > n), '') AS a, coalesce(string_agg(whole, '' ORDER BY k) FILTER (WHERE rejected AND k > n), '') AS b,
    coalesce(string_agg(mask, ',' ORDER BY k) FILTER (WHERE NOT rejected AND k > n), '') AS ma, coalesce(string_agg(mask, ',' ORDER BY k) FILTER (WHERE rejected AND k > n), '') AS mb,
    coalesce(bool_or(trained) FILTER (WHERE NOT rejected AND k > n), false) AND coalesce(bool_or(trained) FILTER (WHERE rejected AND k > n), false) AS usable
  FROM s GROUP BY pair_id)
SELECT pair_id, n AS n_prompt_turns, CASE WHEN n_a = 0 THEN 0 ELSE n_a - n END AS n_chosen_turns, CASE WHEN n_b = 0 THEN 0 ELSE n_b - n END AS n_rejected_turns, sha256(prompt) AS prompt_sha256,
  CASE WHEN n_a > 0 THEN sha256(a) END AS chosen_sha256, CASE WHEN n_a > 0 THEN ma END AS chosen_mask, CASE WHEN n_b > 0 THEN sha256(b) END AS rejected_sha256, CASE WHEN n_b > 0 THEN mb END AS rejected_mask, usable
FROM g"""
