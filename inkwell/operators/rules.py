"""Lexicon, density and pattern rules: candidates, in one schema per unit of text.

These are heuristic: rows are candidates for a reader, not verdicts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import tables as T
from inkwell.functions import text as X
from inkwell.operators.segment import keep, lines, pages_of, paragraph_rows, sentence_rows


FIRSTS = 10_000
PHRASE_WORD = re.compile("[a-z]+(?:'[a-z]+)?")


def lexicon(spark, entries: list[tuple]) -> DataFrame:
    """A lexicon table (class, phrase, suggestion, exception) with the phrase's words; of fixed size."""
    rows = [(*e, *[None] * (4 - len(e)), PHRASE_WORD.findall(e[1].lower())) for e in entries]
    return spark.createDataFrame(rows, "class string, phrase string, suggestion string, exception string, parts array<string>")


def default_lexicon() -> list[tuple[str, str, str | None, str | None]]:
    """Entries (class, phrase, suggestion, exception): the exception says when the phrase is acceptable, and drops nothing."""
    out = [("restricted", w, *more) for w, more in T.RESTRICTED.items()]
    plain = {"hedge": T.HEDGES, "transition": T.TRANSITIONS, "research": T.RESEARCH, "opener": T.OPENINGS, "closer": T.CLOSINGS, "aside": T.ASIDES, "compliment": T.COMPLIMENTS}
    paired = {"british": T.BRITISH, "padding": T.PADDING | T.MORE_PADDING, "avoid": T.AVOIDED, "plain": T.PLAIN}
    out += [(c, w, None, None) for c, ws in plain.items() for w in ws] + [(c, w, x, None) for c, ws in paired.items() for w, x in ws.items()]
    return out + [(f"trope-{k}", w, None, None) for k, ws in T.TROPE_WORDS.items() for w in ws]


def lexicon_hits(units: DataFrame, entries: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """One row per occurrence of a phrase in ``units`` (text): pos (word index, from 0), class, phrase, suggestion, exception.

    Only words that begin a phrase leave their text, each with as many of the
    next ones as the longest phrase has, and meet phrases by an equi-join on
    the first word; then the rest is compared.  A lexicon with more than
    ``FIRSTS`` first words sends all words to the join instead.  ``allow``
    (phrase) names phrases that a rule layer permits.
    """
    kept = keep(units, "pos")
    if allow is not None:
        entries = entries.join(allow.select("phrase").distinct(), "phrase", "left_anti")
    entries = entries.where(F.size("parts") > 0).withColumn("_first", F.get("parts", F.lit(0)))
    longest = entries.agg(F.coalesce(F.max(F.size("parts")), F.lit(1))).first()[0]
    firsts = [r[0] for r in entries.select("_first").distinct().limit(FIRSTS + 1).collect()]
    place = lambda own: F.transform(own, lambda w, i: F.struct(i.alias("pos"), w.alias("_first")))
    some = place if len(firsts) > FIRSTS else lambda own: F.filter(place(own), lambda x: x["_first"].isin(firsts))
    runs = lambda own: F.transform(some(own), lambda x: F.struct(x["pos"].alias("pos"), x["_first"].alias("_first"), F.slice(own, x["pos"] + 1, F.lit(longest)).alias("_w")))
    rows = units.select(*kept, F.inline(F.get(F.transform(F.array(X.words(F.col("text"))), runs), F.lit(0))))
    found = rows.join(entries, "_first").where(F.slice("_w", F.lit(1), F.size("parts")) == F.col("parts"))
    return found.select(*kept, "pos", "class", "phrase", "suggestion", "exception")


def dense_units(hits: DataFrame, more_than: int, *by: str) -> DataFrame:
    """Units with more than so many hits of a class."""
    return hits.groupBy(*by, "class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


#: Headings, and labels of one or two words, at the start of a line.
EXEMPT = r"(?m)^(?:#{1,6} .*|[ \t]*(?:[-*] )?\*{0,2}[A-Z]\w*(?: \w+)?:)"


def pause_density(docs: DataFrame) -> DataFrame:
    """Em-dashes, colons before space and semicolons per page of 350 words, and whether their sum passes 5; no-word texts out.

    Colons of headings and of labels at the start of a line are exempt.
    """
    count = lambda p, t=X.empty(F.col("text")): F.regexp_count(t, F.lit(p))
    rows = pages_of(docs).where("n_words > 0").select(*keep(docs), "n_words", "pages", count("\u2014").alias("dashes"), count(r":\s", F.regexp_replace(X.empty(F.col("text")), EXEMPT, "")).alias("colons"), count(";").alias("semicolons"))
    total = F.col("dashes") + F.col("colons") + F.col("semicolons")
    per = F.round(total / F.col("pages"), 6)
    return rows.select(*keep(docs), "n_words", "dashes", "colons", "semicolons", per.alias("per_page"), (per > 5).alias("flagged"))


def sentence_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences that end three in a row whose lengths differ by at most five words."""
    frame = Window.partitionBy(key).orderBy("ord").rowsBetween(1 - T.RUN_LENGTH, 0)
    rows = sentence_rows(docs).withColumns({"low": F.min("n_words").over(frame), "high": F.max("n_words").over(frame), "k": F.count(F.lit(1)).over(frame)})
    return rows.where((F.col("k") == T.RUN_LENGTH) & (F.col("high") - F.col("low") <= T.RUN_TOLERANCE)).drop("k")


def single_sentence_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of three or more paragraphs of one sentence: start, length."""
    rows = paragraph_rows(docs).withColumn("one", F.size(X.sentences(F.col("text"))) == 1)
    island = F.col("para") - F.row_number().over(Window.partitionBy(key, "one").orderBy("para"))
    rows = rows.withColumn("island", island).where("one")
    return rows.groupBy(key, "island").agg(F.min("para").alias("start"), F.count(F.lit(1)).alias("length")).where("length >= 3").drop("island")


def anaphora_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Three or more sentences in a row that begin with the same two words: start, length, opening."""
    first = F.array_join(F.slice(X.words(F.col("text")), 1, 2), " ")
    rows = sentence_rows(docs).withColumn("opening", first).where("opening like '% %'")
    island = F.col("ord") - F.row_number().over(Window.partitionBy(key, "opening").orderBy("ord"))
    rows = rows.withColumn("island", island)
    return rows.groupBy(key, "opening", "island").agg(F.min("ord").alias("start"), F.count(F.lit(1)).alias("length")).where("length >= 3").drop("island")


@dataclass(frozen=True)
class Pattern:
    """A rule that counts matches of a regular expression in a unit (line, sentence or paragraph), less those of ``minus``; on code alone in the LaTeX layer."""

    rule: str
    layer: str
    unit: str
    regex: str
    least: int = 1
    minus: str | None = None


#: Own patterns, in the syntax that Java and RE2 share (no lookaround, no possessives).
PATTERNS = (
    Pattern("introducer-period", "general", "sentence", r"(?i)\b(?:the following|as follows)\.$"),
    Pattern("lower-after-colon", "general", "sentence", r":\s+[a-z][a-z]*(?:\s+[a-z]+){5}"),
    Pattern("semicolon-pronoun", "general", "line", r"(?i);\s+(?:we|it|this|they|these)\b"),
    Pattern("semicolon-chain", "general", "sentence", r";", 2),
    Pattern("participial-opening", "general", "sentence", r"^[A-Z][a-z]+ing\b[^.]*,"),
    Pattern("passive", "general", "sentence", r"(?i)\b(?:is|are|was|were|be|been|being)\s+[a-z]+(?:ed|en)\b"),
    Pattern("noun-stack", "general", "line", r"(?i)\b[a-z]+-[a-z]+ [a-z]+s?\b", 1, r"(?i)\b[a-z]+-(?:[a-z]+(?:ing|ed|en)|based|like|free|level|wide) [a-z]+s?\b"),
    Pattern("parenthetical-list", "general", "line", r"\([^()]*,[^()]*\)", 1, r"\((?:e\.g\.|i\.e\.)[^()]*,[^()]*\)"),
    Pattern("example-etc", "general", "sentence", r"(?i)\be\.g\.[^()]*\betc\b"),
    Pattern("data-plural", "general", "line", r"(?i)\bdata (?:are|were|have|show|suggest|indicate|reveal)\b"),
    Pattern("like-for-examples", "general", "line", r"(?i)\b(?:scenarios|examples|tools|tasks|languages|models|systems|topics|fields|methods|cases) like\b"),
    Pattern("topic-opening", "general", "sentence", r"(?i)^[a-z]+(?: [a-z]+){0,3} (?:has|have) become increasingly\b"),
    Pattern("clause-chain", "general", "sentence", r"(?::|\x{2014}| - )[^;]*;[^;]*;"),
    Pattern("enumeration", "general", "sentence", r"(?i)\b(?:such as|including|e\.g\.,?) [^.;:,]+,[^.;:,]+,[^.;:,]+,"),
    Pattern("bold", "general", "paragraph", r"\*\*[^*]+\*\*", 2),
    Pattern("bold-bullet", "trope", "line", r"^\s*[-*] \*\*"),
    Pattern("aside", "general", "line", r"(?i)\b(?:reader beware|the reader is warned|we shall see|spoiler alert|more on this below)\b"),
    Pattern("author-aside", "latex", "line", r"(?i)\b(?:reader beware|we shall see|spoiler alert|note to self)\b"),
    Pattern("self-answer", "trope", "line", r"(?:^|[.!?] )(?:[A-Z]\w*\s?){1,4}\?\s+[A-Z][^.?!]{0,40}\."),
    Pattern("countdown", "trope", "line", r"(?i)\bnot (?:an? )?\w+\. not (?:an? )?\w+\."),
    Pattern("tricolon", "trope", "sentence", r"(?i)\b\w+, \w+, and \w+[.!?]?$"),
    Pattern("effect-size-missing", "scientific", "paragraph", r"(?i)\bp\s*[<=>]\s*0?\.\d+", 1, r"(?i)\b(?:cohen's d|eta|odds ratio|effect size|[rd]\s*=)"),
    Pattern("interval-brackets", "scientific", "line", r"(?i)\d+% CI\s*(?:\(|:|of)"),
    Pattern("small-numeral", "scientific", "sentence", r" [1-9] (?:[a-z]{4,}s)\b", 1, r" [1-9] (?:percent|minutes|seconds|hours|days|weeks|months|years|bytes|points)\b"),
    Pattern("negative-parallel", "trope", "sentence", r"(?i)\bnot (?:just|only|merely)\b[^.]*\bbut\b"),
    Pattern("false-range", "trope", "sentence", r"(?i)\bfrom [a-z]+ to [a-z]+, and everything\b"),
    Pattern("invented-label", "trope", "line", r"(?i)\bthe [a-z]+ (?:paradox|trap|creep|fallacy)\b"),
    Pattern("despite-challenges", "trope", "sentence", r"(?i)^despite (?:these|its|the) challenges\b"),
    Pattern("trailing-participle", "trope", "sentence", r", [a-z]+ing [^,.]*\.$"),
    Pattern("p-threshold", "scientific", "line", r"\bp\s*<\s*0?\.0[15]\b"),
    Pattern("no-leading-zero", "scientific", "line", r"[=<>]\s*\.\d"),
    Pattern("sentence-numeral", "scientific", "sentence", r"^\d+ [a-z]"),
    Pattern("thousands", "scientific", "line", r"\b\d{5,}\b"),
    Pattern("lower-reference", "scientific", "line", r"\b(?:section|figure|table) \d"),
    Pattern("typed-reference", "latex", "line", r"\b(?:[Ss]ection|[Ff]igure|[Tt]able)[ ~]\d"),
    Pattern("vague-caption", "scientific", "line", r"(?i)\\caption\{(?:overview of our approach|experimental results|results|overview|architecture|example)\.?\}"),
    Pattern("straight-quote", "latex", "line", r"\""),
    Pattern("typed-author", "latex", "line", r"\b[A-Z][a-z]+ et al\."),
    Pattern("run-in-heading", "latex", "line", r"\\paragraph\{[^}]*[^}.:]\}"),
)


def pattern_candidates(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """rule, layer, unit, at (line from 1, else ordinal from 0), n for each unit that reaches a pattern's least count.

    Each unit is split once and all of its patterns are counted in one projection; nothing is joined.
    """
    out = None
    for unit, rows, at in (("line", lines(docs), "line"), ("sentence", sentence_rows(docs), "ord"), ("paragraph", paragraph_rows(docs), "para")):
        own = [p for p in patterns if p.unit == unit]
        if not own:
            continue
        part = lambda p: X.code_part(F.col("text")) if p.layer == "latex" else F.col("text")
        count = lambda p: F.regexp_count(part(p), F.lit(X.edged(p.regex))) - (F.regexp_count(part(p), F.lit(X.edged(p.minus))) if p.minus else 0)
        hits = F.array(*[F.struct(F.lit(p.rule).alias("rule"), F.lit(p.layer).alias("layer"), count(p).alias("n"), F.lit(p.least).alias("least")) for p in own])
        found = rows.select(*keep(docs), F.lit(unit).alias("unit"), F.col(at).cast("int").alias("at"), F.inline(F.filter(hits, lambda h: h["n"] >= h["least"]))).drop("least")
        out = found if out is None else out.unionByName(found)
    return out


def significant_audit(docs: DataFrame) -> DataFrame:
    """Sentences with "significant" or "significantly" and no statistics in them."""
    rows = sentence_rows(docs).where(F.col("text").rlike(X.edged(r"(?i)\bsignificant(?:ly)?\b")))
    return rows.where(~F.col("text").rlike(X.edged(r"(?i)\bp\s*[<=>]|\btest\b|\bconfidence\b|\bCI\b")))


def signposted_closing(docs: DataFrame) -> DataFrame:
    """Texts whose last paragraph begins with a closing formula."""
    last = F.element_at(X.paragraphs(F.col("text")), -1)
    formula = r"(?i)^\s*(?:" + "|".join(T.CLOSINGS) + r")\b"
    return docs.where(F.size(X.paragraphs(F.col("text"))) > 0).withColumn("closing", X.context(last)).where(last.rlike(X.edged(formula))).drop("text")


def passive_share(docs: DataFrame) -> DataFrame:
    """Paragraphs in which more than a third of the sentences look passive: para, sentences, passive."""
    pattern = X.edged(next(p.regex for p in PATTERNS if p.rule == "passive"))
    s = X.sentences(F.col("text"))
    rows = paragraph_rows(docs).select(*keep(docs), "para", F.size(s).alias("sentences"), F.size(F.filter(s, lambda x: x.rlike(pattern))).alias("passive"))
    return rows.where(F.col("passive") * 3 > F.col("sentences"))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """Line values (not blank) that occur more than once, with texts and occurrences; counted by hash-free group, pre-aggregated."""
    rows = lines(docs).where(~F.col("text").rlike(r"^\s*$"))
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def duplicate_docs(docs: DataFrame) -> DataFrame:
    """Groups of equal texts: the least id, the size and a digest of the text."""
    return docs.where("text is not null").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1")


def normal_sentence(text: Column) -> Column:
    return F.array_join(X.words(text), " ")


def duplicate_sentences(docs: DataFrame, least_words: int = 4, key: str = "doc_id") -> DataFrame:
    """Sentences that one text states more than once: normalised words and times."""
    rows = sentence_rows(docs).where(F.col("n_words") >= least_words).select(key, normal_sentence(F.col("text")).alias("said")).where("said <> ''")
    return rows.groupBy(key, "said").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def passage_containment(docs: DataFrame, passages: DataFrame, anchor: int = 4) -> DataFrame:
    """(doc_id, item_id) where a passage's text is contained in a document's.

    The inner words of a passage (those that no cut at its ends can change), at
    most ``anchor`` of them, are an equi-join key for the document's runs of as
    many words; the pair is then verified.  Passages of two words or fewer have
    none: their texts are looked for in each document, a thousand at a time.
    """
    tokens = lambda c: F.filter(F.split(c, r"[ \n]"), lambda w: w != "")
    inner = F.slice(tokens(F.col("passage")), 2, F.least(F.lit(anchor), F.greatest(F.size(tokens(F.col("passage"))) - 2, F.lit(0))))
    items = passages.select("item_id", F.col("text").alias("passage")).where("passage <> ''").withColumn("_a", inner)
    keyed = items.where(F.size("_a") > 0).withColumn("key", F.xxhash64("_a"))
    out = None
    for size in sorted(r[0] for r in keyed.select(F.size("_a")).distinct().collect()):
        runs = lambda a, n=size: F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.xxhash64(F.slice(a, i + 1, F.lit(n))))
        w = F.get(F.transform(F.array(tokens(F.col("text"))), lambda a: F.when(F.size(a) >= size, F.array_distinct(runs(a)))), F.lit(0))  # noqa: B023
        pairs = docs.select("doc_id", F.explode(w).alias("key")).join(keyed.where(F.size("_a") == size).select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
        out = pairs if out is None else out.unionByName(pairs)
    few = items.where(F.size("_a") == 0).select("item_id", "passage").toLocalIterator()
    found = [] if out is None else [out.join(items.select("item_id", "passage"), "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id")]
    while part := list(islice(few, 1000)):
        hits = F.array(*[F.when(F.contains("text", F.lit(r["passage"])), F.lit(r["item_id"])) for r in part])
        found.append(docs.select("doc_id", F.explode(F.array_compact(hits)).alias("item_id")))
    return reduce(DataFrame.unionByName, found) if found else docs.where("false").select("doc_id", F.lit(None).cast(passages.schema["item_id"].dataType).alias("item_id"))
