import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from inkwell.llm.suffix_dedup import insert_columns, remove_repeats, repeated_windows


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_columns():
    rng = random.Random(3)
    for _ in range(60):
        strings = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        data, offs = np.frombuffer("".join(strings).encode(), np.uint8).astype(np.uint16), np.cumsum([0] + [len(s) for s in strings])
        before, prefix = insert_columns(data, offs, 200)
        suffixes = sorted((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        assert [chr(b) if b != 65535 else "" for b in before] == [strings[k][i - 1] if i else "" for _, k, i in suffixes]
        common = [0] + [next((n for n in range(min(len(a), len(b)), -1, -1) if a[:n] == b[:n])) for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:])]
        assert prefix.tolist() == common
        twice = repeated_windows(data, offs, 3)
        seen = Counter(s[i : i + 3] for s in strings for i in range(len(s) - 2))
        want = [len(s) - i >= 3 and seen[s[i : i + 3]] > 1 for s in strings for i in range(len(s))]
        assert twice.tolist() == want


def passages(seed=1, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randint(30, 120)) for _ in range(8)]
    texts = [None, "", "a", "ab" * 400, "x" * 199, "x" * 200, "x" * 201, "y" * 200, prose(40000 // 5), "z" * 5000]
    for _ in range(n):
        parts = [prose(rng.randint(1, 100))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : rng.randint(a, len(s))] if rng.random() < 0.5 else s, prose(rng.randint(0, 60))]
        texts.append(" ".join(parts))
    return texts + texts[20:60] + [t[: rng.randint(100, 400)] for t in texts[60:90]]


@pytest.mark.parametrize("hot, flat", [(20_000, 4096), (5, 4096), (20, 1)])
def test_passages(spark, monkeypatch, hot, flat):
    import inkwell.llm._exchange as exchange
    import inkwell.llm.suffix_dedup as module

    texts = passages()
    if flat == 1:  # many small chunks and two levels of parts
        monkeypatch.setattr(exchange, "FLAT", 1)
        monkeypatch.setattr(exchange, "KEYS_PER_PART", 300)
        monkeypatch.setattr(module, "BUCKET_BYTES", 1 << 12)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(5)
    got = {r.doc_id: r for r in remove_repeats(df, hot=hot).collect()}
    want = brute(texts, 200)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w, i
        assert sum(s.end - s.begin for s in r.removed) == w[1] and len(r.removed) == w[2]
    assert remove_repeats(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "n" * 300), (None, None), (1, "n" * 300)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(none).collect()) == [(0, 0), (0, 300), (1, 300)]


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, text=False, spans=False).collect()}
    assert got == dict(zip(t["doc_id"].to_pylist(), brute(t["text"].to_pylist(), 200)))
