from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from inkwell.llm.mixing import BLOCK_ROWS, mixed, schedule, slots


def test_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 50 == 0, None).otherwise(F.col("source"))).withColumn("slot", F.lit("mine"))
    out = schedule(docs).collect()
    assert len(out) == docs.count() and "slot" in out[0]
    sizes = Counter(r.source for r in out)
    by_slot = {}
    for r in out:
        by_slot.setdefault(r.slot, []).append(r)
        assert r.release <= r.slot < r.due
    assert sorted(by_slot) == list(range(len(by_slot)))
    for rows in by_slot.values():
        assert len({(r.source, r.block) for r in rows}) == 1
        assert sorted(r.place for r in rows) == list(range(len(rows))) and len(rows) <= BLOCK_ROWS
    assert len(by_slot) == sum(-(-n // BLOCK_ROWS) for n in sizes.values())
    again = {(r.doc_id, r.slot, r.place) for r in schedule(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.slot, r.place) for r in out}
    ids = [r.doc_id for r in mixed(docs).collect()]
    assert ids == [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.place))]
    assert schedule(docs.limit(0)).count() == 0


def test_target_weights_over_many_periods():
    for weights in ([0.7, 0.0002, 0.2998], [0.5, 0.2001, 0.2999], [0.5] + [0.5 / 19] * 19, [0.9999, 0.0001], [1 / 3, 2 / 3], [n**0.5 for n in (7, 90, 2000)]):
        exact = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
        had = Counter()
        for (k, i, phase, slot, release, due), _ in zip(slots([(w, 10**6, 1) for w in weights]), range(20000)):
            assert (i, phase) == (had[k], 0) and release == i // exact[k] and due == -(-(i + 1) // exact[k])
            had[k] += 1
            if slot % 97 == 0 or slot == 19999:
                assert all(abs(had[s] - w * (slot + 1)) < 1 for s, w in enumerate(exact))


def test_sources_of_one_kind_keep_their_own_windows():
    kinds = [(0.25, 40, 30), (1.0, 300, 2), (0.0, 3, 5)]
    exact = {k: Fraction(w) / Fraction(sum(x * m for x, _, m in kinds)) for k, (w, _, _) in enumerate(kinds)}
    had, seen = Counter(), []
    for k, i, phase, slot, release, due in slots(kinds):
        assert release <= slot < due and i == had[k]
        had[k] += 1
        seen.append((k, i % kinds[k][2]))
        if phase == 0 and slot % 50 == 0:
            each = Counter(seen)
            assert all(abs(each[j, c] - exact[j] * (slot + 1)) < 1 for j, (_, _, m) in enumerate(kinds) for c in range(m))
    assert dict(had) == {k: n * m for k, (_, n, m) in enumerate(kinds)}


def test_many_sources(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "big").otherwise(F.concat(F.lit("www"), F.col("id") % 1500)).alias("source"))
    for weights in (None, {"big": 0.7, "www3": 0.2, "www4": 0.1}):
        out = schedule(docs, weights).collect()
        assert sorted(r.doc_id for r in out) == list(range(9000))
        blocks = {(r.source, r.block): r.slot for r in out}
        assert sorted(blocks.values()) == list(range(len(blocks))) and all(r.release <= r.slot < r.due for r in out)
        if weights:
            start = [r for r in out if r.phase == 0]
            had = Counter(s for s, _ in {(r.source, r.block) for r in start})
            assert all(abs(had[s] - w * len({r.slot for r in start})) < 1 for s, w in weights.items())


def test_a_million_slots():
    exact = [Fraction(w) / sum(map(Fraction, (0.7, 0.0002, 0.2998))) for w in (0.7, 0.0002, 0.2998)]
    had = [0, 0, 0]
    for (k, *_), t in zip(slots([(w, 10**7, 1) for w in (0.7, 0.0002, 0.2998)]), range(1, 10**6 + 1)):
        had[k] += 1
        if t % 501 == 0:
            assert all(abs(n - w * t) < 1 for n, w in zip(had, exact))


def brute_slots(blocks, weights):
    """Slot of each (source, block): earliest deadline first in every phase, slot by slot; ties to the lesser weight."""
    left, done, out, t = dict(blocks), Counter(), {}, 0
    while any(left.values()):
        active = {s: Fraction(weights[s]) for s, n in left.items() if n and weights[s]} or {s: Fraction(n) for s, n in left.items() if n}
        total, first, base = sum(active.values()), dict(done), t
        while all(left[s] for s in active):
            ready = []
            for s, w in active.items():
                j = done[s] - first.get(s, 0)
                if j * total // w <= t - base:
                    ready.append((-(-(j + 1) * total // w), weights[s], blocks[s], s))
            s = min(ready)[-1]
            out[s, done[s]] = t
            done[s] += 1
            left[s] -= 1
            t += 1
    return out


def test_slots_against_brute_force():
    blocks = {"a": 300, "b": 90, "c": 13, "d": 200, "e": 1}
    for weights in ({s: n**0.5 for s, n in blocks.items()}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0, "e": 0}):
        names = sorted(blocks, key=lambda s: (weights[s], blocks[s]))
        got = {(names[k], i): slot for k, i, _, slot, *_ in slots([(weights[s], blocks[s], 1) for s in names])}
        assert got == brute_slots(blocks, weights)


def test_repeated_and_null_keys(spark):
    rows = [(None if i % 3 else 7, "s") for i in range(3000)] + [(i, "t") for i in range(100)]
    out = schedule(spark.createDataFrame(rows, "doc_id long, source string").repartition(3), bucket_rows=64)
    assert out.columns == ["doc_id", "source", "phase", "block", "slot", "release", "due", "place"]
    got = out.collect()
    assert len(got) == 3100 and len({(r.slot, r.place) for r in got}) == 3100
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
