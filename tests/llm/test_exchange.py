from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import inkwell.llm._exchange as exchange
from inkwell.llm._text import unpack


@pytest.mark.parametrize("flat", [4096, 1])
def test_counts_come_back(spark, monkeypatch, flat):
    monkeypatch.setattr(exchange, "FLAT", flat)
    monkeypatch.setattr(exchange, "KEYS_PER_PART", 50)
    rng = np.random.Generator(np.random.PCG64(1))
    pool = rng.integers(0, 2**64, 700, dtype=np.uint64)
    chunks = {}
    for c in range(20):
        keys = np.unique(rng.choice(pool, rng.integers(1, 200)))
        chunks[c << 32] = keys, [rng.integers(0, 9, len(keys)) for _ in range(2)]
    at = exchange.levels(sum(len(k) for k, _ in chunks.values()))
    assert (at.fine > 1) == (flat == 1)
    rows = [r for c, (keys, counts) in chunks.items() for r in exchange.request(c, keys, counts, at.parts)]
    asked = spark.createDataFrame([tuple(r.values()) for r in rows], exchange.REQUEST)
    out = exchange.counted(asked, at).collect()
    want = [Counter(), Counter()]
    for keys, counts in chunks.values():
        for total, n in zip(want, counts):
            for k, x in zip(keys.tolist(), n.tolist()):
                total[k] += x
    for c, (keys, _) in chunks.items():
        mine = [r for r in out if r.chunk == c]
        got = exchange.read_answer(pa.table({"part": [r.part for r in mine], "counts": pa.array([bytes(r.counts) for r in mine], pa.binary())}), 2)
        for g, total in zip(got, want):
            assert g.tolist() == [total[k] for k in keys.tolist()]
    every = {k for keys, _ in chunks.values() for k in keys.tolist() if k % 2 == 0 and want[0][k] + want[1][k]}
    assert sum(r.distinct for r in out) == len(every) and len(unpack(out[0].counts, np.uint64)) > 0
