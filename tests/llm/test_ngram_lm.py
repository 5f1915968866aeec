import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkwell.llm.ngram_lm import LEVELS, learn, score
from inkwell.llm.queries import op1_deleted_interpolation
from inkwell.llm.langid import fold

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    raw = (text or "").encode()
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return [*WORD.findall(raw), None]


def check(rows, got):
    train = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    for i, x in rows:
        t = tokens(x)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(train[w] > 0 for w in t), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t), rel=1e-9, abs=1e-9)
        assert r.score < 0 or n == 0


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in op1_deleted_interpolation(spark, sf).collect()}
    check(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())), got)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # mixing beats add-one


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A b A b"), (4, "a B a b"), (5, "z " * 30000), (6, "a b"), (7, "\t \n"), (8, "ÀÉ a")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in score(df, fold(parts=7) == 2).collect()}
    check(rows, got)
    none = spark.createDataFrame([(None, "a b"), (2, "a"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in score(none, fold(parts=7) == 2).collect()) == [(0, 1), (0, 3), (2, 2)]
    assert score(df.limit(0), fold(parts=7) == 2).count() == 0


def test_em_prefers_what_predicts():
    cells = np.array([(3 * LEVELS + 55) * LEVELS + 42, 3 * LEVELS * LEVELS + 42])
    w = learn(cells, np.array([90.0, 10.0]), np.array([[14.5, 1.0], [0.0, 0.5]]))
    assert w[3][0] > 0.7 and np.allclose(w.sum(1), 1) and np.allclose(w[9], w[20])


def brute_scores(rows, role):
    """Every count in a dictionary, EM over each deleted token, one by one."""
    bucket = lambda c: min(int(c).bit_length(), 40)
    begin = object()

    def counts(kinds):
        one, two, n = Counter(), Counter(), Counter()
        for i, x in rows:
            if role[i] in kinds:
                before = begin
                n["texts"] += 1
                for t in tokens(x):
                    one[t] += 1
                    two[before, t] += 1
                    before = t
        one[begin] = n["texts"]
        return one, two

    one, two = counts({0})
    every, pairs = counts({0, 1})
    total, rest = sum(every.values()) - every[begin], sum(one.values()) - one[begin]
    uniform = 1 / (sum(c > 0 for t, c in every.items() if t is not begin) + 1)
    seen = []
    for i, x in rows:
        before = begin
        for t in tokens(x) if role[i] == 1 else []:
            seen.append((bucket(one[before]), two[before, t] / max(one[before], 1), one[t] / rest))
            before = t

    def em(parts, weights):
        for _ in range(60):
            share = parts * weights
            share /= share.sum(1, keepdims=True)
            weights = np.maximum(share.sum(0), 1e-9)
            weights = weights / weights.sum()
        return weights

    parts = np.array([(a, b, uniform) for _, a, b in seen])
    pooled = em(parts, np.full(3, 1 / 3))
    lambdas = {}
    for b in {x[0] for x in seen}:
        lambdas[b] = em(parts[[x[0] == b for x in seen]], pooled)
    for b in range(41):
        w = np.maximum(lambdas.get(b, pooled), 1e-6)
        lambdas[b] = w / w.sum()
    out = {}
    for i, x in rows:
        before, out[i] = begin, 0.0
        for t in tokens(x):
            w = lambdas[bucket(every[before])]
            out[i] += math.log10(w[0] * pairs[before, t] / max(every[before], 1) + w[1] * every[t] / total + w[2] * uniform)
            before = t
    return out


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    role = F.when(fold(parts=7) == 2, 2).when(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0, 1).otherwise(0)
    rows = docs.select("doc_id", "text", role.alias("role")).collect()
    want = brute_scores([(r.doc_id, r.text) for r in rows], {r.doc_id: r.role for r in rows})
    got = {r.doc_id: r.score for r in score(docs, fold(parts=7) == 2).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=5e-3) for i in got)
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=1e-3)


def test_patterned_words_are_different_tokens(spark):
    word = ["".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(2048)) for k in (0, 1)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(30)}
    df = spark.createDataFrame([(i, word[h]) for i, h in held.items()], "doc_id long, text string")
    got = score(df, fold(parts=7) == 2).where("held_out").collect()
    assert got and all(r.n_known == 1 for r in got)  # the end alone


def test_repeated_ids(spark):
    df = spark.createDataFrame([(2, "a b"), (2, "a b"), (2, "c")], "doc_id long, text string")
    got = sorted((r.n_tokens, r.train_tokens) for r in score(df, fold(parts=7) == 2).collect())
    assert [n for n, _ in got] == [2, 3, 3] and {t for _, t in got} == {8}
