import re
from collections import Counter

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from inkwell.llm.quality import Measured, Rule, cascade, default_rules, metrics, order, sampled, verdicts
from inkwell.llm.queries import ORACLES, op7_quality_cascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f g h " * 3), (5, "x " * 5000), (6, "é🙂 # *\na\n\na\n a\na"), (7, " ".join(map(str, range(60000)))), (8, "A" * 100000), (9, "a\x0bb\x0cc\x1cd"), (10, " ".join(["q"] * 9 + ["z"] + ["q"] * 8))]


def test_metrics(spark):
    df = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in metrics(df).collect()}
    assert got == {i: brute(t) for i, t in ROWS}
    assert metrics(df.limit(0)).count() == 0


def test_cascade(spark):
    raw = spark.createDataFrame(ROWS, "doc_id long, text string")
    df = metrics(raw)
    column, found = cascade(raw)
    assert {m.name for m in found} == {r.name for r in default_rules()}
    got = {r.doc_id: r.v for r in df.select("doc_id", column.alias("v")).collect()}
    assert got[1] == "few_words" or got[1] == "word_length"
    assert got[7] is None and got[5] is not None and len(found) == len(default_rules())
    rules = [Rule("a", F.lit(True)), Rule("b", F.lit(True)), Rule("c", F.lit(True))]
    m = [Measured("a", 1.0, 0.1), Measured("b", 0.1, 0.1), Measured("c", 0.1, 0.5)]
    assert [r.name for r in order(rules, m)] == ["c", "b", "a"]
    assert cascade(raw.limit(0))[1]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    df = op7_quality_cascade(spark, sf)
    got = {r.doc_id: r for r in df.collect()}
    for r in t:
        g = got[r["doc_id"]]
        b = brute(r["text"])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == b
        assert g.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
    good = [got[i].kept for i, q in labels.items() if q == 1 and i in got and not got[i].base_failed]
    bad = [got[i].kept for i, q in labels.items() if q == 0 and i in got]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.execute(ORACLES["op7_quality_cascade"])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in rel.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in got.values()) == want


def test_metrics_stay_behind_their_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    column, found = cascade(docs)
    eager = {(r.doc_id, r.v is None) for r in metrics(docs).select("doc_id", column.alias("v")).collect()}
    assert {(r.doc_id, r.rejected_by is None) for r in verdicts(docs, found).collect()} == eager
    turned = [Measured(m.name, m.rejected + 0.01, m.cost) for m in found]
    assert {(r.doc_id, r.rejected_by is None) for r in verdicts(docs, turned).collect()} == eager
    cost = {m.name: m.cost for m in found}
    assert min(cost.values()) > 0 and all(0 <= m.rejected <= 1 for m in found)


def test_sample(spark, monkeypatch, tmp_path):
    import inkwell.llm.quality as module

    monkeypatch.setattr(module, "SAMPLE_FILES", 3)
    spark.range(5000).selectExpr("id doc_id", "cast(id as string) text").repartition(8).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = sampled(docs, 100).collect()
    assert 20 < len(got) <= 100 and len({r.doc_id for r in got}) == len(got)
    assert sampled(docs.limit(0), 10).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words) for r in metrics(df).collect()) == [(0, 0), (0, 2), (1, 2), (1, 2)]
