"""Markdown lint: line ends, unclosed fences and front matter, report and rules structure, six line rules and their fixes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.functions import text as X
from inkwell.operators.segment import lines

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
LABELS = ("**Rule:**", "**Location:**", "**Quote:**", "**Suggested revision:**")
#: First-level titles that mark a report and a rules document, and a catalog's second-level one; callers give their own.
REPORT_TITLE, RULES_TITLE, CATALOG_TITLE = "Prose Review", "Writing Rules", "Tropes to Avoid"


def block_findings(text: str, blanks: bool = False, is_yaml=None) -> Iterator[tuple[int, str, str]]:
    """Unclosed front matter and fences of a text with normal line ends; ``is_yaml`` judges a closed block."""
    rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    rows = rows[:-1] if rows[-1] == "" else rows
    skip = 0
    if rows and rows[0].rstrip() == "---":
        content = False
        for i, row in enumerate(rows[1:], 1):
            if row.rstrip() == "---":
                skip = i + 1 if is_yaml is None or is_yaml(rows[1:i]) else 0
                content = False
                break
            if not row.strip():
                if not blanks:
                    break
                continue
            content = True
        if content:
            yield 1, "unclosed-frontmatter", "the block that begins on the first line is not closed"
    opened = None
    for i, row in enumerate(rows[skip:], skip + 1):
        if not (m := FENCE.match(row)):
            continue
        mark, rest = m[1], m[2]
        if opened is None:
            opened = None if mark[0] == "`" and "`" in rest else (i, mark)
        elif mark[0] == opened[1][0] and len(mark) >= len(opened[1]) and not rest.strip():
            opened = None
    if opened:
        yield opened[0], "unclosed-fence", f"{len(opened[1])}-{'backtick' if opened[1][0] == '`' else 'tilde'} fence is not closed"


def yaml_like(rows: list[str]) -> bool:
    """A simple test of a mapping or list; the parser library is not a dependency."""
    body = [r for r in rows if r.strip() and not r.lstrip().startswith("#")]
    return bool(body) and (all(re.match(r"^\s*(?:-\s|[^\s:][^:]*:(?:\s|$))|^\s+\S", r) for r in body))


def blocks(docs: DataFrame, blanks: bool = False) -> DataFrame:
    """Findings of :func:`block_findings` for each text that has a fence marker or begins with a block; by Arrow batch."""
    kept = [c for c in docs.columns if c != "text"]
    schema = StructType([*(docs.schema[c] for c in kept), *StructType.fromDDL("line int, rule string, message string").fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [list(block_findings(x, blanks, yaml_like)) for x in batch.column(len(kept)).to_pylist()]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            columns = list(zip(*(r for rows in found for r in rows), strict=True)) or [(), (), ()]
            types = (pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(kept))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return docs.where(F.col("text").rlike(r"(?m)^ {0,3}(?:`{3}|~{3})|\A---")).select(*kept, "text").mapInArrow(run, schema)


def carriage_returns(docs: DataFrame) -> DataFrame:
    """The first line with a carriage return, once per text."""
    line = F.length(F.regexp_replace(F.split_part("text", F.lit("\r"), F.lit(1)), "[^\n]", "")) + 1
    return docs.where(F.col("text").contains("\r")).select(*[c for c in docs.columns if c != "text"], line.cast("int").alias("line"), F.lit("crlf-line-endings").alias("rule"), F.lit("carriage return").alias("message"))


def line_rules(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """md001 heading levels rise by one; md009 trailing space; md012 blank runs; md022 blank lines around headings; md025 one H1; md047 one final newline."""
    own = Window.partitionBy(key).orderBy("line")
    rows = lines(docs)
    last = F.max("line").over(Window.partitionBy(key))
    fence = F.sum(F.col("text").rlike(r"^ {0,3}(?:`{3,}|~{3,})").cast("int")).over(own)
    rows = rows.withColumns({"last": last, "inside": fence % 2 == 1, "level": F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1)), "blank": F.col("text").rlike(r"^\s*$")})
    rows = rows.withColumn("level", F.when(F.col("inside"), 0).otherwise(F.col("level")))
    heads = F.when(F.col("level") > 0, F.col("level"))
    before = F.last(heads, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    firsts = F.count(F.when(F.col("level") == 1, 1)).over(own)
    tail = (F.col("line") == F.col("last")) & (F.col("text") == "")
    found = F.array(
        F.struct(F.lit("md001").alias("rule"), (F.col("level") > F.coalesce(before + 1, F.lit(6))).alias("hit")),
        F.struct(F.lit("md009").alias("rule"), (F.col("text").rlike(r"\S[ \t]+$") & ~F.col("text").rlike(r"\S  $")).alias("hit")),
        F.struct(F.lit("md012").alias("rule"), (F.col("blank") & F.coalesce(F.lag("blank").over(own), F.lit(False)) & ~F.col("inside") & ~tail).alias("hit")),
        F.struct(F.lit("md022").alias("rule"), ((F.col("level") > 0) & (~F.coalesce(F.lag("blank").over(own), F.lit(True)) | ~F.coalesce(F.lead("blank").over(own), F.lit(True)))).alias("hit")),
        F.struct(F.lit("md025").alias("rule"), ((F.col("level") == 1) & (firsts > 1)).alias("hit")),
        F.struct(F.lit("md047").alias("rule"), ((F.col("line") == F.col("last")) & (F.col("text") != "")).alias("hit")),
    )
    rows = rows.withColumn("f", found)
    return rows.select(*[c for c in docs.columns if c != "text"], "line", F.inline(F.filter("f", lambda x: x["hit"]))).drop("hit")


def fixed(docs: DataFrame) -> DataFrame:
    """Texts after the fixes of md009, md012 and md047; lines in fences, hard breaks of two spaces and structure are left alone."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?m)^[ \t]+$", ""), r"(?m)(\S)(?:[ \t]*\t[ \t]*| | {3,})$", "$1")
    single = lambda x: F.regexp_replace(F.regexp_replace(clean(x), r"\n{3,}", "\n\n"), r"^\n{2,}", "\n")
    parts = F.split("text", r"(?m)(?=^ {0,3}(?:`{3,}|~{3,}))")  # every second part is inside a fence
    t = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, single(x)).otherwise(x)), "")
    return docs.withColumn("text", F.when(t != "", F.concat(F.regexp_replace(t, r"\n+$", ""), F.lit("\n"))).otherwise(t))


def structure(docs: DataFrame, key: str = "doc_id", report: str = REPORT_TITLE, rules: str = RULES_TITLE, catalog: str = CATALOG_TITLE) -> DataFrame:
    """Finding blocks of reports that lack a label; rules documents without exactly one catalog section, or with an H1 in it.

    Lines in fences and front matter are left out.  The titles are parameters.
    """
    own = Window.partitionBy(key).orderBy("line")
    rows = lines(docs)
    front = (F.first("text").over(own) == "---") & (F.count(F.when(F.col("text").rlike(r"^---\s*$"), 1)).over(own.rowsBetween(Window.unboundedPreceding, -1)) < 2)
    fence = F.sum(F.col("text").rlike(r"^`{3,}").cast("int")).over(own)
    rows = rows.withColumn("live", ~front & (fence % 2 == 0) & ~F.col("text").rlike(r"^`{3,}")).where("live")
    rows = rows.withColumn("level", F.length(F.regexp_extract("text", r"^(#{1,6})\s+", 1))).withColumn("title", F.regexp_replace(F.regexp_extract("text", r"^#{1,6}\s+(.*)$", 1), r"\s*#*\s*$", ""))
    kind = F.first(F.when((F.col("level") == 1) & F.col("title").isin(report, rules), F.col("title")), ignorenulls=True).over(Window.partitionBy(key))
    block = F.sum((F.col("level") > 0).cast("int")).over(own)
    section = F.last(F.when((F.col("level") > 0) & (F.col("level") <= 2), F.when((F.col("level") == 2) & (F.col("title") == catalog), 1).otherwise(0)), ignorenulls=True)
    rows = rows.withColumns({"kind": kind, "block": block, "in_catalog": section.over(own.rowsBetween(Window.unboundedPreceding, -1))})
    texts = rows.where(F.col("kind") == report).groupBy(key, "block").agg(F.min("line").alias("line"), F.min_by("text", "line").alias("head"), F.array_join(F.collect_list("text"), "\n").alias("body"))
    lacks = texts.where(F.col("head").rlike(r"^####\s+Finding\s+\d+")).select(key, "line", F.explode(F.array(*map(F.lit, LABELS))).alias("label"), "body").where(~F.contains("body", "label"))
    out = lacks.select(key, "line", F.lit("finding-block-missing-label").alias("rule"), F.col("label").alias("message"))
    mine = rows.where(F.col("kind") == rules)
    is_catalog = (F.col("level") == 2) & (F.col("title") == catalog)
    again = mine.where(is_catalog).withColumn("_r", F.row_number().over(own)).where("_r > 1").select(key, "line", F.lit("writing-md-structure").alias("rule"), F.lit("second catalog section").alias("message"))
    none = mine.groupBy(key).agg(F.bool_or(is_catalog).alias("has")).where("not has").select(key, F.lit(1).alias("line"), F.lit("writing-md-structure").alias("rule"), F.lit("no catalog section").alias("message"))
    inner = mine.where((F.col("level") == 1) & (F.col("in_catalog") == 1)).select(key, "line", F.lit("writing-md-structure").alias("rule"), F.lit("H1 in the catalog section").alias("message"))
    return out.unionByName(again).unionByName(none).unionByName(inner)


def lint_rows(output: DataFrame) -> DataFrame:
    """line, rule, message from a linter's printed lines (text)."""
    pattern = r"^.+?:(\d+):\d+:\s+([A-Za-z0-9_]+):\s+(.+?)(?:\s+\([^)]+\))?\s*$"
    part = lambda i: F.regexp_extract("text", pattern, i)
    return output.where(F.col("text").rlike(pattern)).select(part(1).cast("int").alias("line"), F.lower(part(2)).alias("rule"), part(3).alias("message"))
