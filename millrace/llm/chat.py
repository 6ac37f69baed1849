"""Chat formatting: conversations logged again after every turn collapse into the longest, which is rendered.

Rolling hashes of turn prefixes are running sums of hashes of (position, role, text): the sum over a whole
conversation needs no order, so it is a plain aggregation. A conversation whose sums and length equal those of
a proper prefix of another is dropped by an anti-join; equal conversations keep the smallest conv_id.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rendered form of a turn (fixed, in the manner of ChatML).
TURN = "<|im_start|>%s\n%s<|im_end|>\n"


def _turn_hash(salt: int) -> Column:
    # decimal sums don't overflow: 38 digits hold 10**19 hashes
    return F.xxhash64(F.lit(salt), F.col("pos"), F.col("role"), F.col("text")).cast("decimal(38,0)")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, text`` of each maximal conversation.

    Turns are ordered by (turn, role, text), nulls first, so ties have one order. A null role counts as ``user``,
    a null text as empty. Turns with a null conv_id belong to no conversation and give no row. Repeated rows are
    turns of their own. n_copies counts the conversations equal to this one. Empty table: no rows. Other columns
    are not read.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter(F.col("conv_id").isNotNull())
    w = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("pos", F.row_number().over(w).cast("long"))
    hashed = placed.select("*", _turn_hash(11).alias("t1"), _turn_hash(12).alias("t2"))
    rolled = hashed.select(
        "conv_id", "pos", "role", "text", F.sum("t1").over(running).alias("h1"), F.sum("t2").over(running).alias("h2"),
        F.lead("pos").over(w).isNull().alias("last"),
    )
    prefixes = rolled.filter(~F.col("last")).select("h1", "h2", "pos").distinct()
    whole = rolled.filter("last").groupBy("h1", "h2", "pos").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    kept = whole.join(prefixes, ["h1", "h2", "pos"], "left_anti").select("conv_id", "n_copies")
    rendered = hashed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("pos", F.format_string(TURN, "role", "text").alias("r")))).alias("rs"),
    )
    return rendered.join(kept, "conv_id").select(
        "conv_id", "n_turns", "n_copies", F.array_join(F.transform("rs", lambda x: x["r"]), "").alias("text")
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
           OVER (PARTITION BY conv_id ORDER BY pos) AS s FROM t),
whole AS (SELECT s, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM r WHERE pos = n GROUP BY s, n)
SELECT conv_id, n AS n_turns, n_copies, s AS text FROM whole
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pos < r.n AND r.pos = whole.n AND r.s = whole.s)
"""


def op2(conversations: DataFrame) -> DataFrame:
    return format_chats(conversations)
