import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from inkwell.llm.signature_join import Tree, dual, link, linked

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = WORD.findall(raw)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by: dict = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        c = len(sets[a] & sets[b])
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [None, "", " \n", "one", "One", "one two", "one two three four", "A b c d e", "a b c d e"]
    for _ in range(40):
        base = prose(rng.randint(5, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w[: rng.randint(len(w) * 4 // 5, len(w))]))
    common = prose(40)
    texts += [" ".join(prose(rng.randint(1, 30)) + common + prose(rng.randint(1, 30))) for _ in range(60)]
    hub = prose(200)
    for _ in range(90):  # a large group of near copies
        w = list(hub)
        w[rng.randrange(200)] = rng.choice(vocab)
        w[rng.randrange(200)] = rng.choice(vocab)
        texts.append(" ".join(w))
    chain = prose(150)
    for k in range(40):  # a chain: neighbours link, the ends don't
        chain = chain[3:] + prose(3)
        texts.append(" ".join(chain))
    texts.append(" ".join(prose(30000)))
    rng.shuffle(texts)
    return [(7 * i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options, shingles", [({"tile": 8, "rare": 2}, 1 << 20), ({"tile": 64, "rare": 10**6, "name_bits": 3}, 500)])
def test_links(spark, monkeypatch, options, shingles):
    import inkwell.llm.signature_join as module

    monkeypatch.setattr(module, "TILE_SHINGLES", shingles)  # long texts fill tiles
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link(df, **options).collect()}
    assert got == brute(rows)


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in link(df).collect()} == brute(rows)
    assert link(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B c d e f"), (2, "other words")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in link(odd).collect())
    assert got == [(0, 0, 2), (0, 0, 2), (2, 2, 1), (2, 2, 2), (3, 2, 2), (3, 2, 2)]


@pytest.mark.parametrize("n", [150, 300])
def test_near_copies_that_link_with_none_meet_few(spark, monkeypatch, n):
    import inkwell.llm.signature_join as module

    rng = random.Random(n)
    hub = ["h%d" % i for i in range(120)]
    texts = [" ".join(hub)]
    for i in range(n):  # half of them differ too much from the hub, and from each other
        w = list(hub)
        for k in range(rng.randint(1, 2) if i % 2 else rng.randint(4, 7)):
            w[rng.randrange(120)] = "v%d" % rng.randrange(20) if k % 4 == 3 else "x%d.%d" % (i, k)
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    made = {}

    def written(df, name, *more):
        made[name] = held(df, name, *more)
        return made[name]

    held = module.written
    monkeypatch.setattr(module, "written", written)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link(spark.createDataFrame(rows, "doc_id long, text string"), tile=16, rare=4).collect()}
    want = brute(rows)
    assert got == want
    assert sum(c == i for i, (_, c) in want.items()) > n // 4
    one, two, pairs = (made[x] for x in ("one", "two", "pairs"))
    left = one.withColumnsRenamed({"kind": "kind_a", "tile": "tile_a"}).join(pairs, ["hot", "by", "kind_a", "tile_a"]).count()
    right = two.join(pairs, ["hot", "by", "kind", "tile"]).count()
    assert left + right < 20 * n, (left, right)  # rows that join the sets


def test_tree_keeps_every_link():
    rng = np.random.Generator(np.random.PCG64(1))
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(1, 290), replace=False), rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)))) for _ in range(150)]
    tree = Tree(sets)
    kept = set(zip(*(x.tolist() for x in dual(tree, tree))))
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if linked(tree.sets[i], tree.sets[j])}
    assert want and want <= kept and len(kept) < 150 * 149 // 2
    a, b = Tree(sets[:70]), Tree(sets[70:] + [np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))])
    kept = set(zip(*(x.tolist() for x in dual(a, b))))
    assert {(i, j) for i in range(70) for j in range(81) if linked(a.sets[i], b.sets[j])} <= kept


def test_patterned_words_do_not_link(spark):
    rows = [(i, "".join("ab"[bin(k).count("1") % 2 ^ i % 2] for k in range(1024 << i // 2))) for i in range(6)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (1, i) for i, _ in rows}


def test_components(spark):
    from inkwell.llm._graph import components

    rng = random.Random(2)
    for n, m in ((1, 0), (60, 50)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1000 + n)] + [(5000, 5000 + k) for k in range(n)]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: find(x) for x in list(root) if find(x) != x}
