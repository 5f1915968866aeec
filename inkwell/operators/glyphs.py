"""Unicode glyph tells: one row per occurrence, counts, and totals of all categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import tables as T
from inkwell.functions import text as X
from inkwell.operators.segment import lines

PATTERN = "[" + "".join(T.GLYPHS) + "]"


def glyph_rows(docs: DataFrame) -> DataFrame:
    """line, col (both from 1), glyph, context.  Only lines that have a glyph are split into characters."""
    kept = [c for c in docs.columns if c != "text"]
    rows = lines(docs.where(F.col("text").rlike(PATTERN)), universal=True).where(F.col("text").rlike(PATTERN))
    names = F.create_map(*[F.lit(x) for pair in T.GLYPHS.items() for x in pair])
    rows = rows.select(*kept, "line", X.context(F.col("text")).alias("context"), F.posexplode(F.split("text", "")).alias("col", "ch"))
    return rows.select(*kept, "line", (F.col("col") + 1).alias("col"), F.element_at(names, F.col("ch")).alias("glyph"), "context").where("glyph is not null")


def glyph_counts(docs: DataFrame, *by: str) -> DataFrame:
    """Occurrences per glyph and value of ``by``, counted by pattern in whole texts: nothing is split."""
    found = docs.where(F.col("text").rlike(PATTERN))
    names = {name: "[" + "".join(c for c, n in T.GLYPHS.items() if n == name) + "]" for name in T.GLYPH_CODES}
    sums = found.groupBy(*by).agg(*[F.sum(F.regexp_count("text", F.lit(p)).cast("long")).alias(n) for n, p in names.items()])
    each = F.array(*[F.struct(F.lit(n).alias("glyph"), F.col(f"`{n}`").alias("n")) for n in names])
    return sums.select(*by, F.inline(each)).where("n > 0")


def glyph_totals(counts: DataFrame) -> DataFrame:
    """:func:`glyph_counts` of all texts with the categories that don't occur, as zeros."""
    every = counts.sparkSession.createDataFrame([(g,) for g in T.GLYPH_CODES], "glyph string")
    return every.join(counts, "glyph", "left").select("glyph", F.coalesce("n", F.lit(0)).alias("n"))
