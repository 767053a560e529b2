"""Preference formatting of conversation pairs, by DataFrame functions only.

A pair has a chosen and a rejected conversation.  Their longest common turn prefix is
rendered once as the prompt; what follows on either side is rendered as that side's
completion.  The mask of a completion lists the character ranges, from the
completion's start, of the texts of assistant turns: only these are trained on.

A conversation is one training text, so its turns are gathered in one row.

Defined results
* turns are ordered by turn, then role, then text, nulls first; repeated rows are kept;
* null role or text is rendered as empty; in the comparison null equals null only;
* a row with null conversation id belongs to no pair and is left out;
* a side without turns has an empty completion; the prompt is then empty;
* equal sides: everything is prompt, both completions are empty;
* empty table: no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _head(x: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(x["role"], F.lit("")), F.lit(MIDDLE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x), F.coalesce(x["text"], F.lit("")), F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """Ranges "from-to" of assistant texts, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(_head(x))
        z = a + F.length(F.coalesce(x["text"], F.lit("")))
        span = F.concat(a.cast("string"), F.lit("-"), z.cast("string"))
        return F.struct((z + F.lit(len(CLOSE))).alias("at"), F.when(F.coalesce(x["role"] == "assistant", F.lit(False)), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, add)["spans"], ",")


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per pair: pair_id, turns in prompt and completions, their texts, and their masks.

    pair: the pair that a turn belongs to; chosen: whether it belongs to the chosen side.
    """
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    rows = turns.select(pair.alias("pair_id"), chosen.alias("good"), turn.alias("t")).where("pair_id is not null and good is not null")
    side = lambda good: F.sort_array(F.collect_list(F.when(F.col("good") == good, F.col("t"))))
    both = rows.groupBy("pair_id").agg(side(True).alias("a"), side(False).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.select("pair_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("prompt_turns"), F.size("a").cast("long").alias("chosen_turns"), F.size("b").cast("long").alias("rejected_turns"),
        _rendered(F.col("p")).alias("prompt"), _rendered(F.col("a")).alias("chosen"), _rendered(F.col("b")).alias("rejected"),
        _mask(F.col("a")).alias("chosen_mask"), _mask(F.col("b")).alias("rejected_mask"),
    )


ORACLE = f"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS role0, text AS text0,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i,
         a.i IS NOT NULL AND b.i IS NOT NULL AND a.role0 IS NOT DISTINCT FROM b.role0 AND a.text0 IS NOT DISTINCT FROM b.text0 AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i),
n AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN i END) - 1, max(i)) AS n FROM m GROUP BY pair_id),
r AS (
  SELECT t.pair_id, side, i, n, '{OPEN}' || role || chr(10) || text || '<|im_end|>' || chr(10) AS r, role,
         length('{OPEN}') + length(role) + 1 AS head, length(text) AS body
  FROM t JOIN n USING (pair_id)),
o AS (SELECT *, coalesce(sum(length(r)) FILTER (WHERE i > n) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM r)
SELECT pair_id, n AS prompt_turns,
  count(*) FILTER (WHERE side = 0 AND i > n) AS chosen_turns, count(*) FILTER (WHERE side = 1 AND i > n) AS rejected_turns,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE side = 0 AND i <= n), '') AS prompt,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE side = 0 AND i > n), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE side = 1 AND i > n), '') AS rejected,
  coalesce(string_agg((off + head) || '-' || (off + head + body), ',' ORDER BY i) FILTER (WHERE side = 0 AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((off + head) || '-' || (off + head + body), ',' ORDER BY i) FILTER (WHERE side = 1 AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY pair_id, n
"""
