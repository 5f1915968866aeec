"""Grounding edits as tables: plan, apply, counters; quotes are never made up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import tables as T
from inkwell.functions import text as X
from inkwell.operators.citations import marked_lines


def comment_body(key: Column, quote: Column, todo: Column) -> Column:
    """The comment for one key: its quote on one line, else a note of what is owed (``not-found`` by default)."""
    quote, reason = X.collapse(X.empty(quote)), X.collapse(X.empty(todo))
    owed = F.when(reason == "", F.lit("not-found")).otherwise(reason)
    return F.when(quote != "", F.concat(F.lit("% GROUNDING: "), key, F.lit(' -- "'), quote, F.lit('"'))).otherwise(F.concat(F.lit("% GROUNDING: "), key, F.lit(" -- TODO verify -- "), owed))


def names_key(comment: Column, key: Column) -> Column:
    """A grounding comment whose header, before quote and separator, names the key between non-key characters."""
    header = F.regexp_replace(F.split_part(F.split_part(comment, F.lit(" -- "), F.lit(1)), F.lit('"'), F.lit(1)), r"[\s:]+$", "")
    return X.is_grounding(comment) & F.array_contains(F.split(header, f"[^{T.KEY_CHARS}]+"), key)


def verified_quotes(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """Quotes (key, quote, todo) that any of the key's source texts (key, text) contains; the others lose the quote."""
    pairs = quotes.where("quote is not null").select("key", "quote").distinct().join(sources.select("key", F.col("text").alias("_s")), "key")
    held = pairs.groupBy("key", "quote").agg(F.bool_or(F.contains(X.collapse(F.col("_s")), X.collapse(F.col("quote")))).alias("_h"))
    rows = quotes.join(held, ["key", "quote"], "left")
    sure = F.coalesce("_h", F.lit(False))
    return rows.select("key", F.when(sure, F.col("quote")).alias("quote"), F.when(sure | F.col("quote").isNull(), F.col("todo")).otherwise(F.coalesce("todo", F.lit("source-does-not-support"))).alias("todo"))


def plan_edits(docs: DataFrame, sites: DataFrame, quotes: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per groundable site and distinct key: status, target line, new text.

    status: no_quote (no result for the key), moved (the line no longer cites
    it), existing (a quote is there, or the stub already says this), replace (a
    stub is rewritten) or insert (after the cite's line).
    """
    rows = marked_lines(docs.join(sites.select(key).distinct(), key, "left_semi"), key).select(key, "line", "block", F.col("text").alias("raw"), "code", "comment")
    asked = sites.where("groundable").select(key, "line", "ord", F.posexplode(F.array_distinct("keys")).alias("k", "cite_key"))
    here = asked.join(rows, [key, "line"], "left")
    here = here.join(quotes.select(F.col("key").alias("cite_key"), "quote", "todo", F.lit(True).alias("_q")), "cite_key", "left")
    cites = F.exists(X.cite_calls(F.col("code")), lambda c: F.array_contains(c["keys"], F.col("cite_key")))
    block = rows.where(X.is_grounding(F.col("comment"))).select(key, "block", F.col("line").alias("at"), F.col("comment").alias("note"), F.col("raw").alias("old"))
    near = here.select(key, "block", "line", "cite_key").distinct().join(block, [key, "block"]).where((F.col("at") >= F.col("line")) & names_key(F.col("note"), F.col("cite_key")))
    sums = near.groupBy(key, "line", "cite_key").agg(
        F.bool_or(X.has_quote(F.col("note"))).alias("quoted"), F.min(F.when((F.col("at") > F.col("line")) & ~X.has_quote(F.col("note")), F.struct("at", "old"))).alias("stub")
    )
    here = here.join(sums, [key, "line", "cite_key"], "left")
    indent = F.regexp_extract(F.coalesce("stub.old", "raw"), r"^\s*", 0)
    text = F.concat(indent, comment_body(F.col("cite_key"), F.col("quote"), F.col("todo")))
    status = (
        F.when(F.col("_q").isNull(), "no_quote")
        .when(F.col("code").isNull() | ~F.coalesce(cites, F.lit(False)), "moved")
        .when(F.coalesce("quoted", F.lit(False)) | (F.col("stub.old") == text), "existing")
        .when(F.col("stub").isNotNull(), "replace")
        .otherwise("insert")
    )
    changed = status.isin("replace", "insert")
    return here.select(
        key, "line", "ord", "k", "cite_key", status.alias("status"), F.when(status == "replace", F.col("stub.at")).otherwise(F.col("line")).alias("target"), F.when(changed, text).alias("text"),
        F.when(changed, F.when(X.collapse(X.empty(F.col("quote"))) != "", "quote").otherwise("todo")).alias("kind"),
    )


def edit_counters(plan: DataFrame) -> DataFrame:
    """Counts by status and kind."""
    return plan.groupBy("status", "kind").agg(F.count(F.lit(1)).alias("n"))


def apply_edits(docs: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts after the plan: replaced lines first, then insertions below their lines, in order; line ends stay as they are.

    A document's lines come together again in one group; a document is at most
    a file, so groups are bounded by file size.
    """
    changed = docs.join(plan.where("text is not null").select(key).distinct(), key, "left_semi")
    raw = changed.select(key, F.posexplode(F.split("text", "\n")).alias("p", "t")).select(key, (F.col("p") + 1).alias("line"), F.lit(0).alias("r"), F.lit(0).alias("k"), F.col("t"))
    cr = F.when(F.col("t").endswith("\r"), F.lit("\r")).otherwise(F.lit(""))
    new = plan.where("status = 'replace'").groupBy(key, F.col("target").alias("line")).agg(F.max_by("text", F.struct("line", "ord", "k")).alias("new"))
    raw = raw.join(new, [key, "line"], "left").withColumn("t", F.coalesce(F.concat("new", cr), "t")).drop("new")
    more = plan.where("status = 'insert'").select(key, F.col("target").alias("line"), (F.col("ord") + 1).alias("r"), "k", F.col("text").alias("t"))
    order = F.array_sort(F.collect_list(F.struct("line", "r", "k", "t")))
    ends = changed.select(key, F.col("text").contains("\r\n").alias("crlf"))
    lines = raw.unionByName(more).join(ends, key).withColumn("t", F.when((F.col("r") > 0) & F.col("crlf"), F.concat("t", F.lit("\r"))).otherwise(F.col("t")))
    edited = lines.groupBy(key).agg(F.array_join(F.transform(order, lambda x: x["t"]), "\n").alias("edited"))
    return docs.join(edited, key, "left").withColumn("text", F.coalesce("edited", "text")).drop("edited")


def apply_findings(docs: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings (key, line, quote, suggestion) with the line of the exact quote nearest to theirs, or status ``absent``; never fuzzy."""
    from inkwell.operators.segment import lines

    found = findings.withColumn("_f", F.xxhash64(key, "line", "quote"))
    hits = lines(docs).select(key, F.col("line").alias("at"), "text").join(found, key).where(F.contains("text", "quote"))
    near = Window.partitionBy("_f").orderBy(F.abs(F.col("at") - F.col("line")), "at")
    best = hits.withColumn("_r", F.row_number().over(near)).where("_r = 1").select("_f", "at")
    return found.join(best, "_f", "left").withColumn("status", F.when(F.col("at").isNull(), "absent").otherwise("found")).drop("_f")


def within_ranges(findings: DataFrame, ranges: DataFrame, key: str = "path") -> DataFrame:
    """Findings (key, line, last_line) that touch a changed range (key, first, last), each once."""
    r = ranges.select(key, "first", F.col("last").alias("until"))
    return findings.alias("f").join(r.alias("r"), (F.col(f"f.{key}") == F.col(f"r.{key}")) & (F.col("f.line") <= F.col("r.until")) & (F.col("r.first") <= F.col("f.last_line")), "left_semi")


def input_bundle(found: DataFrame, meta: DataFrame) -> DataFrame:
    """What a reader of sources needs for each open key: cite_key, claims in order and the entry's metadata (null where there is none), as JSON."""
    from inkwell.operators.citations import claim_rows, keys_to_ground

    claims = claim_rows(found).groupBy("cite_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "claim"))), lambda x: x["claim"]).alias("claims"))
    rows = keys_to_ground(found).select("cite_key").join(claims, "cite_key", "left").join(meta.withColumnRenamed("key", "cite_key"), "cite_key", "left")
    return rows.select("cite_key", F.to_json(F.struct("cite_key", "claims", *[c for c in meta.columns if c != "key"])).alias("value"))
