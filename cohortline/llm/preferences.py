"""Preference formatting: the common prefix of two conversations is rendered once, what follows twice, with masks.

All of it is DataFrame code. The lengths of the rendered turns are summed up along each
conversation first, so every span is a difference of two sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(c: Column) -> Column:
    """A text in which nothing reads as a mark."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), _plain(role), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_head(turn["role"]), _plain(turn["text"]), F.lit(CLOSE + "\n"))


def _turns(turns: DataFrame, side: str, id_col: str) -> DataFrame:
    """(id, side) with the conversation's turns in order, the lengths of each one's rendering, and the sum of these up to its end."""
    order = Window.partitionBy("id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col(id_col).alias("id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.length(_head(F.col("role")))).withColumn("size", F.col("head") + F.length(_plain(F.col("text"))) + len(CLOSE) + 1)
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "text", "head", "size", "upto"))).alias(side))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, id_col: str = "conv_id", answers: str = "assistant") -> DataFrame:
    """One row for each id: n_common, prompt, chosen, rejected, chosen_mask and rejected_mask.

    Turns come as rows (id, turn, role, text), in the order of turn, then role and text (nulls first); turns
    of equal order and content are turns each. The prompt is the rendering of the longest run of
    first turns that are equal on both sides in role and text, as they are before rendering; the completions are the renderings of the rest,
    empty if nothing is left or one side has no turns. A mask lists the spans (first, end; code points of the completion) that
    are learned from: texts and end marks of the turns of the role `answers`. Null roles and texts count as empty; a
    "<|" in them becomes "< |". Null ids are one conversation. Other columns aren't kept; no turns give no rows.
    """
    both = _turns(chosen, "c", id_col).join(_turns(rejected, "r", id_col).withColumnRenamed("id", "rid"), F.expr("id <=> rid"), "full")
    empty = F.array().cast("array<struct<i:int,role:string,text:string,head:int,size:int,upto:int>>")
    both = both.select(F.coalesce("id", "rid").alias("id"), F.coalesce("c", empty).alias("c"), F.coalesce("r", empty).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    other = lambda i: (F.get("c", i - 1)["role"] != F.get("r", i - 1)["role"]) | (F.get("c", i - 1)["text"] != F.get("r", i - 1)["text"])
    differ = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: (i <= least) & other(i))
    both = both.withColumn("n", F.coalesce(F.array_min(differ) - 1, least)).withColumn("base", F.when(F.col("n") > 0, F.element_at("c", F.greatest("n", F.lit(1)))["upto"]).otherwise(0))

    def joined(a: Column) -> Column:
        return F.array_join(F.transform(a, _body), "")

    def rest(side: str) -> Column:
        return F.filter(F.col(side), lambda x: x["i"] > F.col("n"))

    def mask(side: str) -> Column:
        spans = F.filter(rest(side), lambda x: x["role"] == answers)
        return F.transform(spans, lambda x: F.struct((x["upto"] - x["size"] + x["head"] - F.col("base")).alias("first"), (x["upto"] - 1 - F.col("base")).alias("end")))

    return both.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_common"),
        joined(F.filter("c", lambda x: x["i"] <= F.col("n"))).alias("prompt"),
        joined(rest("c")).alias("chosen"),
        joined(rest("r")).alias("rejected"),
        mask("c").alias("chosen_mask"),
        mask("r").alias("rejected_mask"),
    )


def swapped_answers(turns: DataFrame, id_col: str = "conv_id", answers: str = "assistant") -> DataFrame:
    """Turns of rejected conversations: each up to its last answer, which is that of the neighbour (ids 2n and 2n + 1).

    A conversation without an answer, or whose neighbour has none, has no rejected turns.
    Of answers of the same turn the last by text counts.
    """
    own = turns.select(F.col(id_col).cast("long").alias("id"), "turn", "role", "text")
    last = own.filter(F.col("role") == answers).groupBy("id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("last.text").alias("answer"))
    ends = last.join(other, "id").select("id", F.col("last.turn").alias("at"), "answer")
    before = own.join(ends, "id").filter((F.col("turn") < F.col("at")) | F.col("turn").isNull()).select("id", "turn", "role", "text")
    swapped = ends.select("id", F.col("at").alias("turn"), F.lit(answers).alias("role"), F.col("answer").alias("text"))
    return before.unionByName(swapped).withColumnRenamed("id", id_col)


_PLAIN = "replace(coalesce({}, ''), '<|', '< |')"
_SIDE = f"""SELECT conv_id, row_number() OVER w AS i, coalesce(role, '') AS role, coalesce(text, '') AS text,
  '{OPEN}' || {_PLAIN.format('role')} || chr(10) || {_PLAIN.format('text')} || '{CLOSE}' || chr(10) AS body,
  length('{OPEN}' || {_PLAIN.format('role')} || chr(10)) AS head
  FROM {{}} t WINDOW w AS (PARTITION BY conv_id ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text NULLS FIRST)"""
SQL = f"""
WITH last_ AS (SELECT conv_id, arg_max(text, (turn, text)) AS answer, max(turn) AS last_turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
ends AS (SELECT a.conv_id, a.last_turn, b.answer FROM last_ a JOIN last_ b ON b.conv_id = xor(a.conv_id, 1)),
swapped AS (SELECT conv_id, turn, role, text FROM conversations JOIN ends USING (conv_id) WHERE turn < last_turn OR turn IS NULL
  UNION ALL SELECT conv_id, last_turn, 'assistant', answer FROM ends),
c AS ({_SIDE.format('conversations')}),
r AS ({_SIDE.format('swapped')}),
paired AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.i, r.i) AS i, c.role = r.role AND c.text = r.text AS same FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.i = r.i),
common AS (SELECT conv_id, coalesce(min(i) FILTER (same IS NOT TRUE) - 1, max(i)) AS n FROM paired GROUP BY conv_id),
sides AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
placed AS (SELECT s.*, n, sum(CASE WHEN i > n THEN length(body) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY i) AS upto FROM sides s JOIN common USING (conv_id))
SELECT conv_id, CAST(any_value(n) AS INTEGER) AS n_common,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND i <= n), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND i > n), '') AS chosen,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'r' AND i > n), '') AS rejected,
  coalesce(string_agg(CAST(upto - length(body) + head AS BIGINT) || '-' || CAST(upto - 1 AS BIGINT), ',' ORDER BY i) FILTER (side = 'c' AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(upto - length(body) + head AS BIGINT) || '-' || CAST(upto - 1 AS BIGINT), ',' ORDER BY i) FILTER (side = 'r' AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
