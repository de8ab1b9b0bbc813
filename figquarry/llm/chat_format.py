"""Preference formatting: the common turns of a chosen and a rejected conversation as prompt, what follows as completions.

Turns are rendered as `<|role|>\\n` + text + `<|end|>\\n`. The prompt is the longest common prefix of turns (same role,
same text), rendered once. Each completion is the rest of its conversation, with the code-point ranges of what the
assistant wrote (its text and end mark; ends exclusive) as `start:end,...`: the loss mask.

A group holds the turns of one pair, so it is as large as two conversations.

Defined results: rows without a conversation or turn number belong to no conversation; a null text is empty, a null
role is `user`; turns with the same number stand in order of role and text, repeated rows once each; a conversation
without partner is a pair whose other side has no turns; no conversations give no rows. A conversation's turns stand in
one row, in memory by their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, OPENED, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(OPENED), t["text"], F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _mask(turns: Column) -> Column:
    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]).cast("long") + len(OPEN) + len(OPENED)
        end = start + F.length(t["text"]).cast("long") + len(CLOSE)
        span = F.concat_ws(":", start.cast("string"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns: pair_id, chosen (boolean), turn, role, text. A row for each pair: pair_id, n_prompt_turns, prompt, and of
    either side completion, mask and number of turns in it."""
    entry = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = turns.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), entry))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("chosen"), entry))).alias("r"),
    )
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first_other = F.array_position(same, False)
    cut = sides.withColumn("n", F.when(first_other == 0, F.size("c")).otherwise(first_other - 1).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    cut = cut.select("pair_id", F.col("n").alias("n_prompt_turns"), F.slice("c", 1, F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        "pair_id",
        "n_prompt_turns",
        _text(F.col("p")).alias("prompt"),
        _text(F.col("c")).alias("chosen_completion"),
        _mask(F.col("c")).alias("chosen_mask"),
        F.size("c").alias("n_chosen_turns"),
        _text(F.col("r")).alias("rejected_completion"),
        _mask(F.col("r")).alias("rejected_mask"),
        F.size("r").alias("n_rejected_turns"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs conversation 2k (chosen) with 2k + 1 (rejected): the turns preference_pairs() takes."""
    conv = F.col("conv_id").cast("long")
    return conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.floor(conv / 2).alias("pair_id"), (F.pmod(conv, F.lit(2)) == 0).alias("chosen"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )


SQL = """
WITH t AS (SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS chosen, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
     size AS (SELECT pair_id, count(*) FILTER (chosen) AS nc, count(*) FILTER (NOT chosen) AS nr FROM t GROUP BY pair_id),
     apart AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.i, r.i)) AS i
               FROM (SELECT * FROM t WHERE chosen) c FULL JOIN (SELECT * FROM t WHERE NOT chosen) r ON c.pair_id = r.pair_id AND c.i = r.i
               WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
     n AS (SELECT size.pair_id, nc, nr, coalesce(apart.i - 1, nc) AS n FROM size LEFT JOIN apart USING (pair_id)),
     part AS (SELECT t.pair_id, CASE WHEN i <= n THEN 'p' WHEN chosen THEN 'c' ELSE 'r' END AS side, i, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body, length(role) + 5 AS head
              FROM t JOIN n USING (pair_id) WHERE chosen OR i > n),
     placed AS (SELECT *, sum(length(body)) OVER (PARTITION BY pair_id, side ORDER BY i) - length(body) AS pos FROM part),
     whole AS (SELECT pair_id, side, string_agg(body, '' ORDER BY i) AS body,
                      string_agg(CAST(pos + head AS BIGINT) || ':' || CAST(pos + length(body) - 1 AS BIGINT), ',' ORDER BY i) FILTER (role = 'assistant') AS mask
               FROM placed GROUP BY pair_id, side)
SELECT n.pair_id, CAST(n.n AS INTEGER) AS n_prompt_turns, coalesce(p.body, '') AS prompt,
       coalesce(c.body, '') AS chosen_completion, coalesce(c.mask, '') AS chosen_mask, CAST(nc - n.n AS INTEGER) AS n_chosen_turns,
       coalesce(r.body, '') AS rejected_completion, coalesce(r.mask, '') AS rejected_mask, CAST(nr - n.n AS INTEGER) AS n_rejected_turns
FROM n LEFT JOIN whole p ON p.pair_id = n.pair_id AND p.side = 'p' LEFT JOIN whole c ON c.pair_id = n.pair_id AND c.side = 'c'
       LEFT JOIN whole r ON r.pair_id = n.pair_id AND r.side = 'r'
"""
