"""Preference formatting of chosen and rejected conversations. DataFrame functions only.

The longest common prefix of turns is rendered once as the prompt; what follows in either conversation is rendered as
its completion, with the code-point spans that count for the loss (the assistant's texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroom.tables import staged

OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, array<struct<turn,role,text>> in order.

    Rows without conv_id have no conversation and go; repeated rows count once; a null turn comes first; equal turns
    come by role, then text; a null role or text is empty.
    """
    part = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_set(part)).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(CLOSE), x["text"], F.lit(END))), "")


def _loss_spans(turns: Column) -> Column:
    """start:stop of each assistant text in the rendered turns, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + len(OPEN) + F.length(x["role"]) + len(CLOSE)
        stop = begin + F.length(x["text"])
        own = F.when(x["role"] == "assistant", F.array(F.concat_ws(":", begin, stop))).otherwise(F.array().cast("array<string>"))
        return F.struct((stop + len(END)).alias("at"), F.concat(a["out"], own).alias("out"))

    return F.array_join(F.aggregate(turns, start, step)["out"], ",")


def formatted(pairs: DataFrame) -> DataFrame:
    """pairs: chosen_id, rejected_id, chosen, rejected (arrays of turns as from gathered).

    Returns chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_loss, rejected_loss. Turns are
    equal if role and text are; turn numbers play no part. Equal conversations give two empty completions, and
    conversations without a common turn an empty prompt. Repeated pairs give repeated rows, an empty table none; other
    columns are ignored. Texts are rendered whole; a conversation must fit a row.
    """
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    # zip_with pads the shorter side with null, so the first false is where the prefix ends
    pairs = pairs.withColumn("_same", same)
    pairs = pairs.withColumn("n", F.when(F.array_position("_same", False) > 0, F.array_position("_same", False) - 1).otherwise(F.size("_same")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return pairs.select(
        "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        _rendered(rest("chosen")).alias("chosen"), _rendered(rest("rejected")).alias("rejected"),
        _loss_spans(rest("chosen")).alias("chosen_loss"), _loss_spans(rest("rejected")).alias("rejected_loss"),
    )


def paired_by_opening(turns: DataFrame) -> DataFrame:
    """Pairs for tables that don't name any: of the conversations that open with the same turn, the one with the
    smallest conv_id is chosen and each other is a rejected one; a conversation alone in its opening is paired with
    the empty conversation (rejected_id null). So the rows grow with the conversations, never with their square. An
    opening is told by a digest of its role and text; other columns are ignored, an empty table gives no rows.
    """
    convs = gathered(turns).withColumn("opening", F.sha2(F.concat_ws("\x1f", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256))
    convs = staged(convs, "conversations")
    # partial aggregation meets the common openings; staged, so that the join below can split them
    heads = staged(convs.groupBy("opening").agg(F.min_by(F.struct("conv_id", "turns"), "conv_id").alias("head"), F.count("*").alias("members")), "openings")
    joined = convs.join(heads, "opening").where("conv_id <> head.conv_id OR members = 1")
    alone = F.col("members") == 1
    return joined.select(
        F.col("head.conv_id").alias("chosen_id"), F.when(~alone, F.col("conv_id")).alias("rejected_id"), F.col("head.turns").alias("chosen"),
        F.when(~alone, F.col("turns")).otherwise(F.slice("turns", 1, 0)).alias("rejected"),
    )


ORACLE = """WITH c AS (
  SELECT conv_id, list_sort(list(DISTINCT {'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')})) t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
o AS (SELECT conv_id, t, t[1].role || chr(31) || t[1].text AS opening FROM c),
h AS (SELECT opening, min(conv_id) AS chosen_id, count(*) AS members FROM o GROUP BY opening),
p AS (SELECT h.chosen_id, CASE WHEN members > 1 THEN o.conv_id END AS rejected_id, a.t AS c,
        CASE WHEN members > 1 THEN o.t ELSE o.t[1:0] END AS r
      FROM o JOIN h USING (opening) JOIN c a ON a.conv_id = h.chosen_id WHERE o.conv_id <> h.chosen_id OR members = 1),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1),
        lambda i: coalesce(c[i].role <> r[i].role OR c[i].text <> r[i].text, true))) - 1, len(c)) AS n FROM p),
s AS (SELECT *, c[n + 1:] AS cr, r[n + 1:] AS rr FROM n),
f AS (SELECT *, list_transform(cr, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS cp,
        list_transform(rr, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS rp FROM s)
SELECT chosen_id, rejected_id, CAST(n AS BIGINT) AS n_prompt_turns,
  coalesce(array_to_string(list_transform(c[1:n], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(cp, ''), '') AS chosen, coalesce(array_to_string(rp, ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(cr) + 1), lambda i: cr[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum(list_transform(cp[1:i], lambda y: length(y))), 0) - 8 - length(cr[i].text) AS BIGINT)::VARCHAR || ':' ||
    CAST(coalesce(list_sum(list_transform(cp[1:i], lambda y: length(y))), 0) - 8 AS BIGINT)::VARCHAR), ','), '') AS chosen_loss,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(rr) + 1), lambda i: rr[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum(list_transform(rp[1:i], lambda y: length(y))), 0) - 8 - length(rr[i].text) AS BIGINT)::VARCHAR || ':' ||
    CAST(coalesce(list_sum(list_transform(rp[1:i], lambda y: length(y))), 0) - 8 AS BIGINT)::VARCHAR), ','), '') AS rejected_loss
FROM f"""
