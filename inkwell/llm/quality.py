"""Quality rules as a short-circuit cascade; DataFrame functions only.

Each rule is a boolean column over a metric.  On a bounded sample the cascade
measures every rule's cost with that of its metric (the least of several timed
runs over held texts after one that compiles the plan, less that of a rule that
reads nothing) and selectivity (share of the sample it rejects), orders the
rules by rejection per cost, and evaluates them in that order: a row that one
rule rejects isn't given to the next (nested ``CASE``).  :func:`verdicts` keeps
each metric behind its rule, so that one behind a later rule isn't computed;
:func:`metrics` computes all, for callers that want them.  The order changes the
cost alone; a row is kept where no rule rejects it.

The sample is drawn by row from at most ``SAMPLE_FILES`` files, chosen by a hash
of their names, so that a large table isn't read for it.

Defined results: null text has no words and fails; a metric of an empty text is
0 or, for ratios, 0.0; rules of equal rejection per cost stay in their order;
rows that repeat an id, and rows with a null one, are rows of their own.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from hashlib import md5
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
SAMPLE_ROWS, SAMPLE_FILES, RUNS = 1000, 32, 2
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none of null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_chars(text: Column) -> Column:
    """Code points that are in words."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")).cast("long")


def symbol_count(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda that names a column expression computes it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """64-bit hashes of all windows of ``size`` words, in order, from those of the words."""
    window = lambda h: lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])
    every = lambda h: F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0))), window(h)))
    return F.coalesce(bound(F.transform(words, lambda w: F.xxhash64(w)), every), F.array().cast("array<bigint>"))


def repeated_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words that are in a window found twice or more, given all windows' hashes.

    Sorted (hash, place) pairs put equal windows together; the places of those
    are sorted again and each adds the words that the one before doesn't cover.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    equal = lambda own, p, k: F.get(own, k)["h"].eqNullSafe(p["h"])
    twice = bound(pairs, lambda own: F.filter(own, lambda p, k: ((k > 0) & equal(own, p, k - 1)) | equal(own, p, k + 1)))
    places = F.array_sort(F.transform(twice, lambda p: p["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
    return F.aggregate(
        places,
        start,
        lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(size))).cast("long").alias("n"), i.cast("int").alias("last")),
        lambda acc: acc["n"],
    )


def repeats_of(hashes: Column) -> Column:
    """Words in repeated windows; the places of the repeats are looked for only where two hashes are equal."""
    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated_words(h)))


def metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns METRICS (long)."""
    text = F.col("text")
    own = [c for c in docs.columns if c not in METRICS]
    words = F.transform(F.array(words_of(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeats_of(window_hashes(w)).alias("r")))
    base = docs.select(*own, word_chars(text).alias("word_chars"), symbol_count(text).alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"), F.explode(words).alias("_w"))
    return base.select(*own, F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.r").alias("n_repeat_words"))


def metrics_of(text: Column) -> dict[str, Column]:
    """Each metric as a column over a text."""
    count = F.size(words_of(text)).cast("long")
    return {"n_words": count, "word_chars": word_chars(text), "n_symbols": symbol_count(text), "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeats_of(window_hashes(words_of(text)))}


@dataclass(frozen=True)
class Rule:
    """Rejects rows where ``reject`` is true; null counts as false."""

    name: str
    reject: Column


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def default_rules(given: dict[str, Column] | None = None) -> list[Rule]:
    """Rules over metrics (the columns of :func:`metrics`, or those ``given``) and ``text``; bounds on ratios are inclusive of clean text.

    Bounds: word length of 2 to 15 characters; at most 0.25 symbols a word and
    0.5 of lines a repeat of an earlier one; at most 0.5 of letters upper case;
    a repeated passage of at most 0.3 of the words; 20 words at least.
    """
    m = given or {c: F.col(c) for c in METRICS}
    text = F.coalesce(F.col("text"), F.lit(""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    lines = F.size(F.split(text, "\n"))
    return [
        Rule("few_words", m["n_words"] < 20),
        Rule("repeats", 100 * m["n_repeat_words"] > 30 * m["n_words"]),
        Rule("word_length", ~ratio(m["word_chars"], m["n_words"]).between(2.0, 15.0)),
        Rule("symbols", ratio(m["n_symbols"], m["n_words"]) > 0.25),
        Rule("duplicate_lines", ratio(m["n_dup_lines"], lines) > 0.5),
        Rule("capitals", ratio(upper, letters) > 0.5),
    ]


@dataclass(frozen=True)
class Measured:
    name: str
    cost: float
    rejected: float


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows of ``docs``, ``rows`` at most."""
    files = {unquote(f).rsplit("/", 1)[-1] for f in docs.inputFiles()}
    some = sorted(files, key=lambda f: md5(f.encode()).digest())[:SAMPLE_FILES]
    if len(some) < len(files):
        try:
            docs = docs.where(F.col("_metadata.file_name").isin(some))
        except AnalysisException:  # not a table of files itself
            pass
    share = max(1.2 * rows / max(docs.count(), 1), 1 / 64)
    return (docs.sample(share, seed=7) if share < 1 else docs).limit(rows)


def measure(sample: DataFrame, rules: list[Rule]) -> list[Measured]:
    """Seconds for each rule over the sample, above those of a rule that reads nothing, and the share it rejects."""
    sample = sample.cache()
    try:
        total = max(sample.count(), 1)

        def seconds(reject: Column) -> tuple[float, int]:
            found = sample.agg(F.count(F.when(reject, 1)))
            hit, taken = found.first()[0], []
            for _ in range(RUNS):
                start = time.perf_counter()
                found.first()
                taken.append(time.perf_counter() - start)
            return min(taken), hit

        idle, _ = seconds(F.lit(False))
        out = []
        for rule in rules:
            taken, hit = seconds(rule.reject)
            out.append(Measured(rule.name, max(taken - idle, 1e-4), hit / total))
        return out
    finally:
        sample.unpersist()


def order(rules: list[Rule], found: list[Measured]) -> list[Rule]:
    """By rejection per cost, greatest first; equal ones stay in order."""
    gain = {m.name: m.rejected / m.cost for m in found}
    return sorted(rules, key=lambda r: -gain[r.name])


def verdict(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects a row, in this order; null where none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.reject, F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Column, list[Measured]]:
    """(verdict column over ``metrics(docs)``, measurements): the default rules in the order that a sample suggests."""
    found = measure(sampled(docs, sample_rows), default_rules(metrics_of(F.col("text"))))
    return verdict(order(default_rules(), found)), found


def verdicts(docs: DataFrame, found: list[Measured] | None = None) -> DataFrame:
    """``docs`` with ``rejected_by``, the rule that rejects a row first, or null; no metric is computed that the cascade doesn't reach."""
    rules = default_rules(metrics_of(F.col("text")))
    found = measure(sampled(docs), rules) if found is None else found
    return docs.withColumn("rejected_by", verdict(order(rules, found)))
