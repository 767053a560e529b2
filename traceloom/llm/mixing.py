"""Mixing of sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token weights are summed into cells of source, language and topic before anything is
shuffled.  Raking multiplies the cells' weights by target over current sum, margin by
margin, until the margins hold.  A document's weight, its expected epochs, is its cell's
raked weight over the cell's tokens.  A hash of its id draws its copies: the whole part
of the weight, and one more with the rest as probability.  ``sampled`` tells whether
there is a copy at all.  Only copies have the raked margins: one row for each sampled
document clips weights above 1.  Where rows may not repeat, budget None takes the largest
budget that leaves no weight above 1, so that weights are probabilities.

Targets are tempered shares of the margins: tokens to a power, which lifts small
values and lowers large ones.

Defined results
* null source, language or topic: the value "" of that margin;
* null or empty text: no tokens; its cell may have none, then its weight is 0 and it is not sampled;
* null id: hashed as the empty text; rows with one id share one random number;
* repeated rows count each; empty table: no rows;
* margins that no weights can meet at once (cells are missing): raking ends after ``ROUNDS``;
* further columns are kept by ``sample_documents``, whatever their names, and ignored by ``mixing_weights``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.scratch import Scratch

#: Powers of the margins' token shares.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 1.0}
#: Largest relative deviation of a margin from its target at which raking ends, and rounds after which it ends anyway.
TOLERANCE = 1e-9
ROUNDS = 64
#: Rounds between two written tables.
CUT = 4
#: Rounds of the SQL form, which cannot stop by itself.
SQL_ROUNDS = 24
#: Tokens to sample, as a share of all tokens; None for the largest share without a weight above 1.
BUDGET = 1.0
#: Characters of a token, on average.
CHARS_PER_TOKEN = 4
SEED = 11
_MARGINS = ["source", "lang", "topic"]


def topic_of(text: Column) -> Column:
    """A coarse topic from the text's form."""
    has = lambda s: F.instr(text, s) > 0
    return F.when(text.isNull(), F.lit("")).when(has(" | "), F.lit("table")).when(has("***") | has("###") | has("%%%"), F.lit("markup")).when(F.length(text) < 500, F.lit("note")).otherwise(F.lit("prose"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)), F.lit(0)).cast("long")


def raked_cells(cells: DataFrame, scratch: Scratch, powers: dict[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with share: their part of the raked distribution."""
    cells = scratch.keep(cells.withColumn("tokens", F.col("tokens").cast("double")).where("tokens > 0"))
    goals = {}
    for m in _MARGINS:
        sums = cells.groupBy(m).agg(F.pow(F.sum("tokens"), F.lit(powers[m])).alias("p"))
        total = sums.agg(F.sum("p").alias("all"))
        goals[m] = sums.crossJoin(F.broadcast(total)).select(m, (F.col("p") / F.col("all")).alias(f"goal_{m}"))  # total is one row
    out = cells.withColumn("share", F.col("tokens"))
    for m in _MARGINS:
        out = out.join(goals[m], m)
    for k in range(rounds):
        for m in _MARGINS:
            out = out.withColumn("share", F.col("share") * F.col(f"goal_{m}") / F.sum("share").over(Window.partitionBy(m)))
        if (k + 1) % CUT == 0 or k + 1 == rounds:
            out = scratch.keep(out)
            if deviation(out) <= TOLERANCE:
                break
    return out.select(*_MARGINS, "tokens", "share")


def deviation(cells: DataFrame) -> float:
    """The largest relative deviation of a margin from its target."""
    most = [cells.groupBy(m).agg(F.sum("share").alias("s"), F.max(f"goal_{m}").alias("goal")).select(F.abs(F.col("s") / F.col("goal") - 1).alias("d")) for m in _MARGINS]
    return most[0].unionByName(most[1]).unionByName(most[2]).agg(F.max("d")).first()[0] or 0.0


def weighted(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, budget: float | None = BUDGET, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: the row as a struct, source, lang, topic, tokens, weight, sampled and copies."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.col(f"`{text_col}`")
    empty = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), empty("source").alias("source"), empty("lang").alias("lang"), topic_of(text).alias("topic"), tokens_of(text).alias("tokens"))
    cells = rows.groupBy(*_MARGINS).agg(F.sum("tokens").alias("tokens"))
    cells = raked_cells(cells, scratch, powers, rounds)
    total = cells.agg(F.sum("tokens").alias("all"), F.max(F.col("share") / F.col("tokens")).alias("top"))
    weight = F.col("share") / F.col("tokens") / F.col("top") if budget is None else F.col("share") * F.col("all") * F.lit(budget) / F.col("tokens")
    rates = scratch.keep(cells.crossJoin(F.broadcast(total)).select(*_MARGINS, weight.alias("weight")))
    out = rows.join(rates, _MARGINS, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    digest = F.md5(F.concat(F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    whole = F.floor("weight")
    return out.withColumns({"sampled": draw < F.col("weight"), "copies": (whole + (draw < F.col("weight") - whole).cast("long")).cast("int")})


def mixing_weights(docs: DataFrame, **options) -> DataFrame:
    """Each row's id, margins, tokens, weight (expected epochs), and whether it is sampled."""
    id_col = options.get("id_col", "doc_id")
    return weighted(docs, **options).select(F.col(f"row.`{id_col}`").alias(id_col), *_MARGINS, "tokens", F.round("weight", 6).alias("weight"), "sampled")


def sample_documents(docs: DataFrame, repeats: bool = False, **options) -> DataFrame:
    """The sampled rows, with the columns of docs: once each, or with repeats as often as drawn."""
    out = weighted(docs, **options).where("sampled")
    if repeats:
        out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select("row.*")


def oracle(source: str = "documents", powers: dict[str, float] = POWERS, rounds: int = SQL_ROUNDS, budget: float = BUDGET, seed: int = SEED) -> str:
    """The same as DuckDB SQL, one step per margin and round."""
    goal = lambda m: f"g_{m} AS (SELECT {m}, power(sum(tokens), {powers[m]}) / sum(power(sum(tokens), {powers[m]})) OVER () AS goal FROM c GROUP BY {m})"
    steps, last = [], "s0"
    for k in range(rounds):
        for m in _MARGINS:
            now = f"s{3 * k + _MARGINS.index(m) + 1}"
            steps.append(f"{now} AS (SELECT s.source, s.lang, s.topic, s.tokens, s.share * g.goal / sum(s.share) OVER (PARTITION BY s.{m}) AS share FROM {last} s JOIN g_{m} g ON s.{m} = g.{m})")
            last = now
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN text IS NULL THEN '' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '***') OR contains(text, '###') OR contains(text, '%%%') THEN 'markup' WHEN length(text) < 500 THEN 'note' ELSE 'prose' END AS topic,
    coalesce(ceil(length(text) / {CHARS_PER_TOKEN}.0), 0)::BIGINT AS tokens
  FROM {source}),
c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
{", ".join(map(goal, _MARGINS))},
s0 AS (SELECT source, lang, topic, tokens, tokens AS share FROM c),
{", ".join(steps)},
w AS (SELECT source, lang, topic, share * (SELECT sum(tokens) FROM {last}) * {budget} / tokens AS weight FROM {last})
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(coalesce(weight, 0), 6) AS weight,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 8))::UBIGINT / 4294967296.0) < coalesce(weight, 0) AS sampled
FROM d LEFT JOIN w USING (source, lang, topic)
"""
