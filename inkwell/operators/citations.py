"""Citations in LaTeX lines: calls, clusters, grounding state, sites with claims, aggregates by key."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.functions import tables as T
from inkwell.functions import text as X
from inkwell.operators.segment import lines


def marked_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with code, comment and the grounding state of their block.

    A line of code begins a block; the comment on it and the blank and comment
    lines below belong to it, so a running count of code lines names blocks.
    """
    rows = lines(docs, universal=True).withColumn("code", X.code_part(F.col("text"))).withColumn("comment", X.comment_part(F.col("text")))
    only = X.blank(F.col("text")) | F.col("text").rlike(r"(?U)^\s*%")
    rows = rows.withColumn("block", F.sum((~only).cast("int")).over(Window.partitionBy(key).orderBy("line")))
    rank = F.when(X.has_quote(F.col("comment")), 2).when(X.is_grounding(F.col("comment")), 1).otherwise(0)
    state = F.max(rank).over(Window.partitionBy(key, "block"))
    return rows.withColumn("state", F.element_at(F.array(F.lit("none"), F.lit("todo"), F.lit("quote")), state + 1))


def cite_calls(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Calls that need grounding: line, ord, command, keys, state, context."""
    kept = [c for c in docs.columns if c != "text"]
    rows = marked_lines(docs, key).where(F.col("code").contains("\\"))
    rows = rows.select(*kept, "line", "state", "text", F.posexplode(X.cite_calls(F.col("code"))).alias("ord", "call"))
    rows = rows.where(F.col("call.command").isin(T.GROUNDED_COMMANDS) & (F.size("call.keys") > 0))
    return rows.select(*kept, "line", "ord", F.col("call.command").alias("command"), F.col("call.keys").alias("keys"), "state", X.context(F.col("text")).alias("context"))


def clusters(calls: DataFrame) -> DataFrame:
    return calls.where(F.size("keys") >= T.CLUSTER_KEYS)


def missing_grounding(calls: DataFrame) -> DataFrame:
    """A stub counts as attached, so only calls in state ``none``."""
    return calls.where("state = 'none'")


MARK = re.compile(r"([.!?])")
TAIL = re.compile(r"[^\W\d_]*$")
BREAK = re.compile(r"\n[ \t]*\n|\\par\b|\\(?:" + "|".join(T.STRUCTURAL) + r")\*?\s*(?:\[[^\]]*\])?(?:\{[^}]*\})*")
PARAGRAPH = re.compile(r"\n[ \t]*\n|\\par\b")
CITE = re.compile(T.CITE)


def boundaries(text: str) -> list[int]:
    """Offsets at which claims begin.

    The text is cut at its closing marks; a cut counts where the text ends
    there, or what follows begins like a sentence (T.OPENING), unless the mark
    is a point between digits or the last one of an abbreviation.  Paragraph
    breaks and structural macros with their arguments end a claim as well.
    """
    found = {m.end() for pattern in (PARAGRAPH, BREAK) for m in pattern.finditer(text)}
    pieces = MARK.split(text)
    at, run = 0, ""
    for piece, mark, follow in zip(pieces[::2], pieces[1::2], pieces[2::2], strict=False):
        tail = TAIL.search(piece)[0]
        run = run + tail if run.endswith(".") and tail == piece else tail
        at += len(piece) + 1
        body = follow.lstrip(" \t\n\r")
        begins = (body[0].isupper() or body[0].isdigit() or body[0] in T.OPENING) if body else at + len(follow) == len(text)
        decimal = mark == "." and piece[-1:].isdigit() and follow[:1].isdigit()
        short = mark == "." and run.strip(".").lower() in T.ABBREVIATIONS
        if begins and not decimal and not short:
            found.add(at + len(follow) - len(body))
        run = run + "." if mark == "." else ""
    return sorted(found)


def _sites_of(code: str) -> list[tuple]:
    """(line, ord, command, keys, sentence) of all citations in a text's code."""
    bounds = boundaries(code)
    breaks = [m.start() for m in re.finditer("\n", code)]
    out = []
    for m in CITE.finditer(code):
        keys = [k.strip() for k in m[2].split(",") if k.strip()]
        if keys:
            k = bisect_right(bounds, m.start())
            span = code[bounds[k - 1] if k else 0 : bounds[k] if k < len(bounds) else len(code)]
            out.append((bisect_right(breaks, m.start()) + 1, len(out), m[1].lower(), keys, span))
    return out


def sites(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every citation of a key, also over several lines: line, command, keys, claim, groundable, grounded.  By Arrow batch."""
    kept = [c for c in docs.columns if c != "text"]
    schema = StructType([*(docs.schema[c] for c in kept), *StructType.fromDDL("line int, ord int, command string, keys array<string>, sentence string").fields])

    def run(batches):
        import pyarrow as pa

        types = (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string())
        for batch in batches:
            found = [_sites_of(x) for x in batch.column(len(kept)).to_pylist()]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            columns = list(zip(*(r for rows in found for r in rows), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(kept))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    cited = docs.where(F.col("text").rlike(r"\\[A-Za-z]*[Cc]it"))
    code = F.array_join(F.transform(X.universal_lines(F.col("text")), X.code_part), "\n").alias("code")
    found = cited.select(*kept, code).mapInArrow(run, schema).where(F.col("command").isin(T.GROUNDED_COMMANDS + T.STYLE_COMMANDS))
    state = marked_lines(cited, key).select(key, "line", (F.col("state") == "quote").alias("grounded"))
    found = found.join(state, [key, "line"])
    return found.select(*kept, "line", "ord", "command", "keys", X.clean_claim(F.col("sentence")).alias("claim"), F.col("command").isin(T.GROUNDED_COMMANDS).alias("groundable"), "grounded")


def by_cited_key(found: DataFrame) -> DataFrame:
    return found.withColumn("cite_key", F.explode("keys")).drop("keys")


def claim_rows(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """cite_key, claim, n (sites), rank: the distinct claims of each key, by the order first seen.  No key's sites are gathered in one value."""
    order = F.struct(key, "ord")
    one = by_cited_key(found).where("claim <> ''").groupBy("cite_key", "claim").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    return one.select("cite_key", "claim", "n", F.row_number().over(Window.partitionBy("cite_key").orderBy("o", "claim")).alias("rank"))


def by_key(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per cited key: distinct claims in the order first seen, and all sites, as nested values: for the export of one project."""
    rows = by_cited_key(found)
    claims = claim_rows(found, key).groupBy("cite_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "claim"))), lambda o: o["claim"]).alias("claims"))
    every = F.array_sort(F.collect_list(F.struct(key, "line", "ord", "command", "groundable", "grounded"))).alias("sites")
    return rows.groupBy("cite_key").agg(every).join(claims, "cite_key", "left").select("cite_key", F.coalesce("claims", F.array()).alias("claims"), "sites")


def keys_to_ground(found: DataFrame) -> DataFrame:
    """Keys with a site that can be grounded and is not."""
    rows = found.select(F.explode("keys").alias("cite_key"), (F.col("groundable") & ~F.col("grounded")).alias("open"))
    return rows.groupBy("cite_key").agg(F.count(F.lit(1)).alias("sites"), F.count(F.when(F.col("open"), 1)).alias("open")).where("open > 0")
