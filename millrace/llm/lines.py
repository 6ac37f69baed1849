"""Line dedup by distinct-site spread, in DataFrame expressions only.

Each line's hash carries a HyperLogLog sketch of the sites that it occurs on; sketches merge in one aggregation.
Where the estimate is near the threshold the sites are counted exactly. A line found on at least ``min_sites``
sites is boilerplate: its first occurrence in the corpus stays, the others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Sites from which a line counts as boilerplate.
MIN_SITES = 6
#: log2 of the sketch's buckets: a relative error of 1.04 / 2**6 at most.
LG_K = 12
#: Estimates within this share of the threshold (and at least 1) are counted exactly.
NEAR = 0.15


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    """96 bits of the line without blanks at its ends; null for a blank line, which is never boilerplate."""
    bare = F.trim(F.regexp_replace(line, "[\\t\\r]", " "))
    return F.when(F.length(bare) > 0, F.struct(F.xxhash64(bare).alias("x"), F.hash(bare).alias("y")))


def _doc_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text", "source").alias("th")]


def spread(docs: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """All lines (h, doc_id, th, pos, source), and the boilerplate (h, n_sites, n_lines, first)."""
    lines = docs.select(
        *_doc_key(), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.posexplode(F.transform(lines_of(F.col("text")), _hash)).alias("pos", "h"),
    ).filter(F.col("h").isNotNull())
    lines = materialize(lines, "lines")
    place = F.struct("doc_id", "th", "pos")
    per_line = lines.groupBy("h").agg(
        F.count("*").alias("n_lines"), F.min(place).alias("first"), F.hll_sketch_agg("source", LG_K).alias("sites")
    )
    judged = per_line.filter(F.col("n_lines") >= min_sites).select("h", "n_lines", "first", F.hll_sketch_estimate("sites").alias("est"))
    judged = materialize(judged, "line-sites")
    slack = max(1.0, NEAR * min_sites)
    sure = judged.filter(F.col("est") > min_sites + slack).select("h", F.col("est").alias("n_sites"), "n_lines", "first")
    near = judged.filter(F.abs(F.col("est") - min_sites) <= slack)
    exact = (
        lines.join(near.select("h"), "h", "left_semi").groupBy("h", "source").agg(F.lit(1).alias("one"))
        .groupBy("h").agg(F.count("*").alias("n_sites")).filter(F.col("n_sites") >= min_sites)
    )
    found = sure.unionByName(near.join(exact, "h").select("h", "n_sites", "n_lines", "first"))
    return lines, found


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, plus ``n_lines`` and ``n_cut``; one row for each row.

    The first occurrence is that of the smallest (doc_id, hash of the text, position). Blank lines always stay.
    A null text stays null and has no lines; a null source is a site of its own; null doc_ids sort first. Rows
    that repeat a doc_id and a text are treated alike. Other columns of ``docs`` pass through (but for columns
    named n_lines or n_cut, which are replaced). Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    base = docs.drop("n_lines", "n_cut")
    lines, found = spread(base, min_sites)
    found = materialize(found, "line-boilerplate")
    cut = (
        lines.join(found.select("h", "first"), "h").filter(F.struct("doc_id", "th", "pos") != F.col("first"))
        .groupBy("doc_id", "th").agg(F.collect_set("pos").alias("__millrace_cut")).withColumnsRenamed({"doc_id": "__millrace_id", "th": "__millrace_th"})
    )
    th = F.xxhash64("text", "source")
    joined = base.join(cut, F.col("doc_id").eqNullSafe(F.col("__millrace_id")) & (th == F.col("__millrace_th")), "left")
    parts = lines_of(F.col("text"))
    kept = F.filter(parts, lambda _, i: ~F.array_contains("__millrace_cut", i))
    return joined.select(
        *(F.when(F.col("__millrace_cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(c) for c in base.columns),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__millrace_cut"), F.lit(0)).cast("long").alias("n_cut"),
    )


#: The same rows in SQL, with exact counts throughout.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT *, trim(replace(replace(line, chr(9), ' '), chr(13), ' ')) AS bare FROM l),
b AS (SELECT bare, min((doc_id, pos)) AS first FROM k WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}),
d AS (SELECT k.doc_id, string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE b.bare IS NULL OR (k.doc_id, k.pos) = b.first) AS text,
             count(*) AS n_lines, count(*) FILTER (WHERE b.bare IS NOT NULL AND (k.doc_id, k.pos) <> b.first) AS n_cut
      FROM k LEFT JOIN b ON k.bare = b.bare GROUP BY k.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_cut FROM d
"""


def op10(documents: DataFrame) -> DataFrame:
    return dedup_lines(documents).select("doc_id", "text", "n_lines", "n_cut")
