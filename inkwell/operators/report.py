"""Findings in one schema, and what is made of them: lines, tables, a document, metrics, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.lint import LABELS, REPORT_TITLE

SCHEMA = "source string, path string, line int, col int, rule_id string, layer string, tier string, quote string, suggestion string, context string, detail string"


def as_findings(rows: DataFrame, **columns) -> DataFrame:
    """``rows`` in the schema of findings; columns that are not given are null."""
    fields = [f.split() for f in SCHEMA.split(", ")]
    value = lambda c: c if not isinstance(c, str) else F.lit(c)
    return rows.select(*[(value(columns[n]) if n in columns else F.lit(None)).cast(k).alias(n) for n, k in fields])


def union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def grep_lines(rows: DataFrame) -> DataFrame:
    """``path:line:text`` of prose lines, files by path, then commits (with ``ord``) newest first."""
    return rows.orderBy("section", "path", "line").select(F.concat_ws(":", "path", "line", "text").alias("value"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", escapeQuotes=False)


def metrics(findings: DataFrame) -> DataFrame:
    """Findings by rule, and how many texts have them."""
    return findings.groupBy("layer", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("texts"))


def status(scanned: int, found: int) -> int:
    """0: nothing found; 1: findings; 2: nothing was scanned."""
    return 2 if scanned == 0 else int(found > 0)


def by_place(findings: DataFrame) -> DataFrame:
    """Raw counts for each file, then each commit (path null), as a review of a whole repository has them."""
    place = F.coalesce("path", F.col("source"))
    return findings.groupBy(F.when(F.col("path").isNull(), "commit").otherwise("file").alias("section"), place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule_id").alias("rules"))


def empty_suggestions(findings: DataFrame) -> DataFrame:
    """Findings whose suggestion deletes the text: the policy is to reformulate."""
    return findings.where(F.trim("suggestion") == "")


def as_json(sites: DataFrame, by_key: DataFrame, meta: DataFrame) -> DataFrame:
    """One row of JSON per part: sites, keys and metadata; distributed, for collections of any size."""
    part = lambda df, n: df.select(F.lit(n).alias("part"), F.to_json(F.struct("*")).alias("value"))
    return union(part(sites, "site"), part(by_key, "key"), part(meta, "meta"))


def json_document(root: str, sites: DataFrame, by_key: DataFrame, meta: DataFrame, order: list[str]) -> DataFrame:
    """One nested document of one project: root, sites (by ``order``), by_key and meta (by key).  One row: for a project, not a corpus."""
    rows = lambda df, *by: F.array_sort(F.collect_list(F.struct(*by, *[c for c in df.columns if c not in by])))
    keyed = lambda df, key: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_k"), F.struct("*"))))).alias("v")).scalar()
    parts = F.struct(F.lit(root).alias("root"), sites.agg(rows(sites, *order).alias("v")).scalar().alias("sites"), keyed(by_key, "cite_key").alias("by_key"), keyed(meta, "key").alias("meta"))
    return sites.sparkSession.range(1).select(F.to_json(parts).alias("value"))


def header(scope: str, *, base: str | None = None, files: int = 0, lines: int | None = None, commits: int | None = None) -> str:
    """The line under a report's title that says what was looked at."""
    counts = [f"{files} files"] + [f"{n} {name}" for n, name in ((lines, "changed lines"), (commits, "commits")) if n is not None]
    return f"Scope: {scope}" + (f" against {base}" if base else "") + f" ({', '.join(counts)})"


def markdown_blocks(findings: DataFrame) -> DataFrame:
    """section (the layer), n, path, line and value: a numbered block of the four labels for each finding.

    Numbers run within a section, in the order of path and line; blocks are
    written in the order of section and n, below :func:`markdown_heads`.
    """
    text = [F.col("rule_id"), F.concat_ws(":", "path", "line"), F.coalesce("quote", F.lit("")), F.coalesce("suggestion", F.lit(""))]
    parts = [x for label, v in zip(LABELS, text, strict=True) for x in (F.lit(f"{label} "), v, F.lit("\n"))]
    n = F.row_number().over(Window.partitionBy("layer").orderBy("path", "line", "rule_id", "quote"))
    return findings.select(F.col("layer").alias("section"), n.alias("n"), "path", "line", F.concat(F.lit("#### Finding "), n.cast("string"), F.lit("\n\n"), *parts).alias("value"))


def markdown_heads(sections: list[str], scope: str, title: str = REPORT_TITLE) -> list[tuple[str, str]]:
    """(section, text) of the title with the scope line and of each section's heading, in order."""
    return [("", f"# {title}\n\n{scope}\n"), *((s, f"## {s[:1].upper()}{s[1:]} layer\n") for s in sections)]


def compose_rules(layers: DataFrame) -> DataFrame:
    """Rule files (ord, text) as one: each from its first ``##`` heading on; catalogs (is_catalog) one level lower, but for lines in fences."""
    body = F.regexp_extract("text", r"(?s)(?:^|\n)(## .*)$", 1)
    parts = F.split(body, r"(?m)(?=^(?:```|~~~))")  # every second part is inside a fence
    lower = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, r"(?m)^(#+)", "$1#")).otherwise(x)), "")
    return layers.select("ord", F.when(F.col("is_catalog"), lower).otherwise(body).alias("text"))


def append_once(text: Column, entry: str) -> Column:
    """The text with a line ``entry`` at its end, unless it has that line."""
    has = F.array_contains(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rtrim(x)), entry)
    gap = F.when(F.coalesce(text, F.lit("")).rlike(r"(?s)[^\n]$"), F.lit("\n")).otherwise(F.lit(""))
    return F.when(has, text).otherwise(F.concat(F.coalesce(text, F.lit("")), gap, F.lit(entry + "\n")))
