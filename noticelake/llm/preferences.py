"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The longest common prefix of turns is found without putting conversations side by side: equal turns
of a pair meet in one group, and the smallest turn that only one side has is where the sides part.
What comes before is rendered once as the prompt, the rest of either side as its completion. A
completion's mask lists the stretches that a model learns, the assistant's words with their end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"


def render(role: Column, text: Column) -> Column:
    """A turn between its marks. Marks inside a text are broken up, so that no text can forge a turn."""
    safe = text
    for mark in (OPEN, CLOSE):
        safe = F.replace(safe, F.lit(mark), F.lit(mark.replace("|", "\\|")))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), safe, F.lit(f"{CLOSE}\n"))


def adjacent_pairs(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Pairs every even conversation, as chosen, with the next odd one, as rejected, if both exist."""
    ids = turns.select(F.col(f"`{conv}`").cast("long").alias("c")).where("c is not null").distinct()
    odd = F.pmod("c", F.lit(2)) == 1
    pairs = ids.groupBy((F.col("c") - F.pmod("c", F.lit(2))).alias("chosen")).agg(F.max(F.when(odd, F.col("c"))).alias("rejected"), F.count("*").alias("n"))
    return pairs.where("n = 2").select(F.col("chosen").alias("pair_id"), "chosen", "rejected")


def format_pairs(turns: DataFrame, pairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per pair: ``pair_id``, ``n_common``, ``prompt``, and ``chosen`` and ``rejected`` (text, mask).

    ``pairs`` has ``pair_id``, ``chosen`` and ``rejected``, ids of conversations. Turns are ordered by
    number, then role and text; repeated turns count once; a null number comes first, a null role is
    ``unknown``, a null text empty. A side without turns is an empty completion. Turns without a
    conversation, and conversations without a pair, are left out. A pair's own turns, which make up
    one output row, are gathered in one task; nothing else is.
    """
    rows = turns.select(
        F.col(f"`{conv}`").alias("c"), F.coalesce(F.col(f"`{turn}`").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("unknown")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("chosen").alias("c"), F.lit(1).alias("side")), F.struct(F.col("rejected").alias("c"), F.lit(2).alias("side")))).alias("s")).select("pair_id", "s.c", "s.side")
    met = sides.join(rows, "c", "left").groupBy("pair_id", "turn", "role", "text").agg(F.bit_or("side").alias("sides"))
    pair, apart = W.partitionBy("pair_id"), (F.col("sides") < 3) & F.col("turn").isNotNull()
    placed = met.withColumn("parting", F.min(F.when(apart, F.col("turn"))).over(pair)).withColumn("shown", render(F.col("role"), F.col("text")))
    early = F.col("parting").isNull() | (F.col("turn") < F.col("parting"))
    # part 0 is the prompt, 1 and 2 are the completions; a turn of both sides stands in both
    parts = F.when(F.coalesce(early, F.lit(True)), F.array(F.lit(0))).when(F.col("sides") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col("sides").cast("int")))
    each = placed.withColumn("part", F.explode(parts))
    # a running sum of lengths places every turn, and the texts are joined once
    stop = F.sum(F.length("shown")).over(W.partitionBy("pair_id", "part").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0))
    item = F.struct("turn", "role", "text", "shown", stop.cast("int").alias("stop"))
    whole = each.select("pair_id", "part", F.when(F.col("turn").isNotNull(), item).alias("x")).groupBy("pair_id", "part").agg(F.sort_array(F.collect_list("x")).alias("all"))
    text_of = F.array_join(F.transform("all", lambda x: x["shown"]), "")
    head = lambda x: x["stop"] - F.length(x["shown"]) + F.length(x["role"]) + len(OPEN) + 1
    mask = F.transform(F.filter("all", lambda x: x["role"] == LEARNT), lambda x: F.struct(head(x).alias("start"), (x["stop"] - 1).alias("end")))
    shaped = whole.select("pair_id", "part", F.size("all").cast("long").alias("n"), F.struct(text_of.alias("text"), mask.alias("mask")).alias("side"))
    none = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    of = lambda part, column: F.max_by(column, F.when(F.col("part") == part, 1))
    found = shaped.groupBy("pair_id").agg(of(0, "n").alias("n"), of(0, "side").alias("p"), of(1, "side").alias("x"), of(2, "side").alias("y"))
    return found.select("pair_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_common"), F.coalesce("p.text", F.lit("")).alias("prompt"), F.coalesce("x", none).alias("chosen"), F.coalesce("y", none).alias("rejected"))


def masks(c: Column) -> Column:
    """A mask's stretches as start:end, comma-joined."""
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")


SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id AS c, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT a.c AS chosen, b.c AS rejected FROM t a JOIN t b ON b.c = a.c + 1 WHERE a.c % 2 = 0),
s AS (SELECT chosen AS pair_id, t.*, 1 AS side FROM p JOIN t ON t.c = p.chosen
      UNION ALL SELECT chosen, t.*, 2 FROM p JOIN t ON t.c = p.rejected),
m AS (SELECT pair_id, turn, role, text, sum(side) AS sides FROM s GROUP BY ALL),
d AS (SELECT *, coalesce(min(turn) FILTER (sides < 3) OVER (PARTITION BY pair_id), 9223372036854775807) AS parting,
        '{OPEN}' || role || chr(10) || replace(replace(text, '{OPEN}', '<\\|im_start\\|>'), '{CLOSE}', '<\\|im_end\\|>') || '{CLOSE}' || chr(10) AS shown FROM m),
o AS (SELECT d.*, k.side, sum(length(shown)) OVER (PARTITION BY pair_id, k.side ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop
      FROM d JOIN (VALUES (1), (2)) k(side) ON sides = 3 OR sides = k.side WHERE turn >= parting)
SELECT x.pair_id, x.n_common, x.prompt,
  coalesce(y.text, '') AS chosen, coalesce(y.mask, '') AS chosen_mask, coalesce(z.text, '') AS rejected, coalesce(z.mask, '') AS rejected_mask
FROM (SELECT pair_id, count(*) FILTER (turn < parting) AS n_common,
        coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (turn < parting), '') AS prompt FROM d GROUP BY pair_id) x
LEFT JOIN (SELECT pair_id, string_agg(shown, '' ORDER BY turn, role, text) AS text,
        string_agg((stop - length(shown) + length(role) + {len(OPEN) + 1})::BIGINT || ':' || (stop - 1)::BIGINT, ',' ORDER BY turn, role, text) FILTER (role = '{LEARNT}') AS mask
      FROM o WHERE side = 1 GROUP BY pair_id) y USING (pair_id)
LEFT JOIN (SELECT pair_id, string_agg(shown, '' ORDER BY turn, role, text) AS text,
        string_agg((stop - length(shown) + length(role) + {len(OPEN) + 1})::BIGINT || ':' || (stop - 1)::BIGINT, ',' ORDER BY turn, role, text) FILTER (role = '{LEARNT}') AS mask
      FROM o WHERE side = 2 GROUP BY pair_id) z USING (pair_id)
"""
