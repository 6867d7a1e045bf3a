"""Preference formatting: a chosen and a rejected conversation become one prompt and two masked completions.

The longest common prefix of turns (equal role and text) is rendered once as the prompt. What follows on either side is
a completion; its mask lists the code-point spans that a trainer learns from: the text and end mark of assistant turns.

Defined cases: a null role is `unknown`, a null text empty; control marks inside texts are broken up, so a text can't
open a turn; equal conversations give a prompt and two empty completions; a null or empty conversation is an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

END = "<|end|>\n"
ASSISTANT = "assistant"


def _clean(turns: Column) -> Column:
    turns = F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>"))
    return F.transform(turns, lambda t: F.struct(
        F.coalesce(t["role"], F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(t["text"], F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """`start:end` of each assistant text with its end mark, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"]) + len(END)
        span = F.concat_ws(":", begin, end)
        return F.struct(end.alias("at"), F.when(t["role"] == ASSISTANT, F.array_append(state["spans"], span)).otherwise(
            state["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ",")


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the start that are equal on both sides."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of `keep` and `(prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask)`.

    `chosen` and `rejected` are arrays of `(role, text)`. Row by row, without a shuffle.
    """
    sides = pairs.select(*keep, _clean(F.col(chosen)).alias("_c"), _clean(F.col(rejected)).alias("_r"))
    cut = sides.withColumn("prompt_turns", common_turns(F.col("_c"), F.col("_r")))
    after = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.size(c))
    cut = cut.select(*keep, "prompt_turns", F.slice("_c", F.lit(1), F.col("prompt_turns")).alias("_p"),
                     after(F.col("_c")).alias("_c"), after(F.col("_r")).alias("_r"))
    return cut.select(*keep, "prompt_turns", _render(F.col("_p")).alias("prompt"), _render(F.col("_c")).alias("chosen"),
                      _mask(F.col("_c")).alias("chosen_mask"), _render(F.col("_r")).alias("rejected"),
                      _mask(F.col("_r")).alias("rejected_mask"))


def conversations(turns: DataFrame) -> DataFrame:
    """`(conv_id, turns)` from one row per turn, in order; repeated rows count once, rows without conversation are left out.

    One row per conversation is the form of the result, so a conversation is held whole, like a document.
    """
    item = F.struct("turn", "role", "text")
    return turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_set(item)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def echo_pairs(turns: DataFrame) -> DataFrame:
    """`(conv_id, chosen, rejected)`: a conversation, and the same with its last answer replaced by the turn before it.

    Stands in for preference data: an answer that repeats what it was asked is the worse one.
    """
    back = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), F.lit(ASSISTANT))
    grouped = conversations(turns).withColumn("at", F.when(back > 0, F.size("turns") - back).otherwise(F.lit(-1)))
    echo = F.transform("turns", lambda t, i: F.when((i == F.col("at")) & (i > 0), F.struct(
        t["role"].alias("role"), F.element_at(F.col("turns"), F.greatest(i, F.lit(1)).cast("int"))["text"].alias("text"))).otherwise(t))
    return grouped.select("conv_id", F.col("turns").alias("chosen"), echo.alias("rejected"))


SQL = """
WITH grouped AS (
  SELECT conv_id, list({'role': coalesce(role, 'unknown'), 'text': replace(coalesce(text, ''), '<|', '< |')}
                       ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS c
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
placed AS (SELECT conv_id, c, coalesce(list_max(list_transform(c, lambda t, i: CASE WHEN t.role = 'assistant' THEN i ELSE 0 END)), 0) AS spot FROM grouped),
sides AS (
  SELECT conv_id, c, list_transform(c, lambda t, i: CASE WHEN i = spot AND i > 1 THEN {'role': t.role, 'text': c[i - 1].text} ELSE t END) AS r
  FROM placed),
cut AS (
  SELECT *, CAST(coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: c[i] <> r[i])), len(c) + 1) - 1 AS INTEGER) AS n FROM sides),
parts AS (
  SELECT conv_id, n, s.side, s.turns FROM cut, unnest([{'side': 'p', 'turns': c[1:n]}, {'side': 'c', 'turns': c[n + 1:]}, {'side': 'r', 'turns': r[n + 1:]}]) AS u(s)),
drawn AS (
  SELECT conv_id, n, side, turns, list_transform(turns, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS texts FROM parts),
made AS (
  SELECT conv_id, n, side, coalesce(array_to_string(texts, ''), '') AS body,
         coalesce(array_to_string(list_filter(list_transform(turns, lambda t, i: CASE WHEN t.role = 'assistant' THEN
           CAST(coalesce(list_sum(list_transform(texts[1:i - 1], lambda x: len(x))), 0) + len(t.role) + 5 AS BIGINT)::VARCHAR || ':' ||
           CAST(list_sum(list_transform(texts[1:i], lambda x: len(x))) AS BIGINT)::VARCHAR END), lambda x: x IS NOT NULL), ','), '') AS mask FROM drawn)
SELECT conv_id, n AS prompt_turns, max(body) FILTER (side = 'p') AS prompt, max(body) FILTER (side = 'c') AS chosen,
       max(mask) FILTER (side = 'c') AS chosen_mask, max(body) FILTER (side = 'r') AS rejected, max(mask) FILTER (side = 'r') AS rejected_mask
FROM made GROUP BY conv_id, n
"""
