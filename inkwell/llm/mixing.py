"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are dealt, in hash order, into blocks of ``block_rows``.  One
block is emitted per slot.  With weight ``w`` the ``j``-th block of a source is
released at ``floor(j / w)`` and due at ``ceil((j + 1) / w)``; in each slot the
released block with the earliest deadline is emitted, so after any number of
slots of a phase every source has had its weight's share to within less than
one block.  Weights are exact: integers over a common denominator, not rounded
to a period.

Sources of one weight and one number of blocks are a *kind*.  A kind is
scheduled as one source of all their weight, and its blocks go to its sources
in turn, which keeps each within its own releases and deadlines.  There can be
any number of sources; kinds are fewer than the square root of twice the number
of blocks (and the given weights), and only they reach the driver.  When a kind
runs out, a new phase begins with the others' weights scaled up; no row is
dropped or repeated.  Sources without a target weight come last, by their sizes.

The slots of blocks follow from each other, so one task works them out: it
reads the kinds and writes a row for each block, none for a row of ``docs``; a
million blocks take it about three seconds, so ``block_rows`` is to grow with
the corpus (with 8,192, ten billion rows are a million blocks).  Places within a source come from counts by hash bucket and a window within a
bucket of about ``BUCKET_ROWS`` rows, so a hot source is never in one task; a
bucket brings the slots of its blocks along.  Where a key repeats so often that
a bucket of it gets too large, rows are dealt by key and row number instead.

Defined results: a null source is a source of its own; repeated rows, repeated
ids and null ids are rows of their own; an empty table gives an empty schedule; equal deadlines go to the
kind of less weight, then of fewer blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm._spill import discard, numbered, written

BLOCK_ROWS = 8
BUCKET_ROWS = 4096
NO_SOURCE = "\x00"
SLOT = "kind int, i long, phase int, slot long, release long, due long"


def slots(kinds: list[tuple[float, int, int]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(kind, i, phase, slot, release, due) of every block, slot by slot, for kinds of (weight, blocks, sources).

    The ``i``-th block of a kind is block ``i // sources`` of its source ``i % sources``; release and due are that
    source's own.
    """
    exact = [Fraction(w) * m for w, _, m in kinds]
    scale = lcm(*(x.denominator for x in exact))
    given = [int(x * scale) for x in exact]
    left, done = [n * m for _, n, m in kinds], [0] * len(kinds)
    base = phase = 0
    while active := [k for k, n in enumerate(left) if n]:
        share = {k: given[k] for k in active if given[k] > 0} or {k: left[k] for k in active}
        total, first = sum(share.values()), list(done)
        ready = [(-(-total // w), k) for k, w in share.items()]
        heapq.heapify(ready)
        later: list[tuple[int, int, int]] = []
        t = 0
        while True:
            while later and later[0][0] <= t:
                heapq.heappush(ready, heapq.heappop(later)[1:])
            due, k = heapq.heappop(ready)
            if t >= due:
                raise AssertionError("a block missed its deadline")
            w, m, p = share[k], kinds[k][2], done[k] - first[k]
            q = p // m * m
            yield k, done[k], phase, base + t, base + q * total // w, base - (-(q + m) * total // w)
            done[k] += 1
            left[k] -= 1
            t += 1
            if not left[k]:
                break
            at, due = (p + 1) * total // w, -(-(p + 2) * total // w)
            if at <= t:
                heapq.heappush(ready, (due, k))
            else:
                heapq.heappush(later, (at, due, k))
        base += t
        phase += 1


def _slot_table(spark, kinds: list[tuple[float, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import batched

        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in SLOT.split(", ")]
        for _ in batches:
            for rows in batched(slots(kinds), 1 << 15):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return written(spark.range(0, 1 if kinds else 0, 1, 1).mapInArrow(run, SLOT), "slots")


def _sources(spark, rows: DataFrame, weights: dict[str, float] | None, block_rows: int) -> tuple[DataFrame, list[tuple[float, int, int]], int]:
    """(_s, kind, _m sources of the kind, _c place among them) of every source; the kinds; rows of the largest source."""
    sizes = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / block_rows))
    if weights is None:
        sizes = sizes.withColumn("_w", F.sqrt(F.col("_blocks").cast("double")))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "_s string, _w double")
        sizes = sizes.join(given, "_s", "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    sizes = written(sizes, "sources")
    found = sorted((r["_w"], r["_blocks"], r["m"], r["n"]) for r in sizes.groupBy("_w", "_blocks").agg(F.count(F.lit(1)).alias("m"), F.max("_n").alias("n")).collect())
    table = spark.createDataFrame([(k, *f[:3]) for k, f in enumerate(found)], "kind int, _w double, _blocks long, _m long")
    hashed, spots = F.xxhash64("_s"), max(1, ceil(max((f[2] for f in found), default=0) / BUCKET_ROWS))
    sizes = sizes.join(F.broadcast(table), ["_w", "_blocks"]).withColumn("_b", F.pmod(hashed, F.lit(spots)))
    before = F.coalesce(F.sum("_x").over(Window.partitionBy("kind").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = sizes.groupBy("kind", "_b").agg(F.count(F.lit(1)).alias("_x")).select("kind", "_b", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("kind", "_b").orderBy(hashed, "_s"))
    placed = sizes.withColumn("_r", within).join(counts, ["kind", "_b"]).select("_s", "kind", "_m", (F.col("_before") + F.col("_r") - 1).alias("_c"))
    return placed, [f[:3] for f in found], max((f[3] for f in found), default=0)


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with phase, block, slot, release, due (of the block) and place (within it).

    ``(slot, place)`` is the mixed order.  Columns of those names in ``docs``
    are replaced.  Weights default to the square roots of the sources' blocks.
    """
    spark = docs.sparkSession
    new = ["phase", "block", "slot", "release", "due", "place"]
    kept = docs.drop(*new)
    ties = F.xxhash64(*[f.name for f in kept.schema if "map<" not in f.dataType.simpleString()])  # so that a task run again deals equal keys alike
    name, order = F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)), [F.xxhash64(F.col(key)), F.col(key), ties]
    sources, kinds, largest = _sources(spark, docs.select(name.alias("_s")), weights, block_rows)
    spots = F.lit(max(1, ceil(largest / bucket_rows)))

    def dealt(rows: DataFrame, hashed: Column) -> DataFrame:
        return written(rows.groupBy(name.alias("_s"), F.pmod(hashed, spots).alias("_b")).agg(F.count(F.lit(1)).alias("_n")), "buckets")

    counts = dealt(docs, order[0])
    if (counts.agg(F.max("_n")).first()[0] or 0) > 4 * bucket_rows:  # a key that repeats
        kept = numbered(kept, "_row")
        order = [F.xxhash64(F.col(key), "_row"), F.col("_row")]
        discard(counts)
        counts = dealt(kept, order[0])
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = lambda k: F.floor(k / block_rows)
    spans = counts.withColumn("_before", offset).withColumn("block", F.explode(F.sequence(block(F.col("_before")), block(F.col("_before") + F.col("_n") - 1))))
    spans = spans.join(sources, "_s").withColumn("i", F.col("block") * F.col("_m") + F.col("_c")).join(_slot_table(spark, kinds), ["kind", "i"])
    found = F.array_sort(F.collect_list(F.struct("block", "phase", "slot", "release", "due")))
    spans = spans.groupBy("_s", "_b").agg(F.first("_before").alias("_before"), found.alias("_slots"))
    within = F.row_number().over(Window.partitionBy("_s", "_b").orderBy(*order))
    ranked = kept.withColumns({"_s": name, "_b": F.pmod(order[0], spots)}).withColumn("_r", within).join(spans, ["_s", "_b"])
    k = F.col("_before") + F.col("_r") - 1
    at = F.get("_slots", (block(k) - block(F.col("_before"))).cast("int"))
    return ranked.withColumns({c: at[c] for c in new[:-1]} | {"place": (k % block_rows).cast("int")}).select(*[c for c in docs.columns if c not in new], *new)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, order: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` in mixed order: range-partitioned and sorted by slot and place, which ``order`` keeps as columns."""
    found = schedule(docs.withColumnsRenamed({c: c for c in docs.columns}), weights, **options)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartitionByRange(width, "slot", "place").sortWithinPartitions("slot", "place").select(*dict.fromkeys([*docs.columns, *(["slot", "place"] if order else [])]))
