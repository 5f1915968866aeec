import duckdb
import pytest
from pyspark.sql import functions as F

from inkwell.llm.queries import ORACLES, QUERIES, op2_quotation_linking
from inkwell.llm.quotes import conversations, in_order, link

M = [
    (1, 0, "a", "How do I sort a list?\n\nIt is  long.", 1),
    (1, 1, "b", "> How do I sort a list?\nUse sort.", 1),
    (1, 2, "c", "A wrote:\n> > how do i SORT a list?\n> Use sort.\nThanks!", 1),
    (1, 3, "d", ">it is long.\n>\nSo what\n> unknown words", 1),
    (1, 4, "e", "New topic", 1),
    (1, 5, "f", "> Thanks!\nok", 1),
    (2, 0, "a", "> Use sort.\nsaw this elsewhere", 1),
    (2, 1, "b", None, 1),
    (2, 2, "b", "", 1),
    (2, 3, "b", "> saw this elsewhere\n> and more\nhm", 1),
    (2, 3, "b", "> saw this elsewhere\n> and more\nhm", 1),
    (3, 0, "a", "> self quote\nself quote", 1),
    (3, 1, "a", "word " * 30000, 1),
    (3, 2, "a", "> " + "word " * 30000 + "\nyes", 1),
]


def test_threads(spark):
    df = spark.createDataFrame(M, "conv_id long, turn long, role string, text string, thread int")
    out = conversations(df)
    got = {}
    for r in out.collect():
        got.setdefault((r.conv_id, r.turn), []).append(r)
    assert sum(map(len, got.values())) == len(M)
    see = {k: (v[0].text[:30], v[0].quote_levels, v[0].n_passages, v[0].n_linked, v[0].n_cross, v[0].parent, v[0].thread, v[0].depth) for k, v in got.items()}
    assert see[1, 0] == ("How do I sort a list?\n\nIt is  ", 0, 0, 0, 0, None, 0, 0)
    assert see[1, 1] == ("Use sort.", 1, 1, 1, 0, 0, 0, 1)
    assert see[1, 2] == ("Thanks!", 2, 2, 2, 0, 1, 0, 2)
    assert see[1, 3] == ("So what", 1, 2, 1, 0, 0, 0, 1)
    assert see[1, 4] == ("New topic", 0, 0, 0, 0, None, 4, 0)
    assert see[1, 5] == ("ok", 1, 1, 1, 0, 2, 0, 3)
    assert see[2, 0] == ("saw this elsewhere", 1, 1, 1, 1, None, 0, 0)
    assert see[2, 1][0] == "" and see[2, 2][0] == ""
    assert see[2, 3] == ("hm", 1, 1, 1, 0, 0, 0, 1)  # of two lines one is known; repeated rows quote once
    assert len(got[2, 3]) == 2 and see[3, 0][5] is None and see[3, 2][5] == 1
    order = [(r.conv_id, r.thread, r.turn) for r in in_order(out).collect()]
    assert order == sorted(order)
    assert conversations(df.limit(0)).count() == 0
    assert link(df).where("to_conv is null").count() >= 1


def test_long_chain(spark):
    rows = [(9, t, "u", (f"> message number {t - 1} here\n" if t else "") + f"message number {t} here") for t in range(70)]
    out = conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.turn, r.depth, r.thread) for r in out.collect()) == [(t, t, 0) for t in range(70)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    out = op2_quotation_linking(spark, sf)
    want = spark.read.parquet(f"{sf}/conversations.parquet")
    assert out.count() == want.count() and out.where(F.col("text_md5").isNull()).count() == 0


@pytest.mark.parametrize("name", ["op2_quotation_linking", "quotation_linking_seeded"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    df = QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(repr(r[c]) for c in sorted(names))
    got = df.collect()
    assert sorted(map(key, got)) == sorted(key(dict(zip(names, r))) for r in rel.fetchall())
    if name.endswith("seeded"):
        assert sum(r.n_linked for r in got) > 200 and sum(r.n_cross for r in got) > 10 and max(r.quote_levels for r in got) >= 2 and max(r.depth for r in got) >= 2


def test_null_keys_and_repeats(spark):
    rows = [(None, 0, "a", "x y"), (None, 1, "b", "> x y\nz"), (1, None, "a", "q"), (1, 1, "b", "> q\nw"), (1, 1, "b", "> q\nw"), (1, 1, "c", "other"), (None, None, None, None)]
    out = conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r.conv_id), str(r.turn), r.role or "", r.text) for r in out) == sorted((str(c), str(t), r or "", {"> x y\nz": "z", "> q\nw": "w"}.get(x, x or "")) for c, t, r, x in rows)


def test_cross_link_past_the_own_conversation(spark):
    for asker, other in ((1, 2), (2, 1)):
        rows = [(asker, 0, "a", "> the shared words\nyes"), (asker, 1, "b", "the shared words"), (other, 0, "a", "the shared words"), (3, 0, "a", "> own words\nown words"), (9, 0, "a", "the shared words")]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {(r.conv_id, r.turn): (r.to_conv, r.to_turn, r.cross) for r in link(df).collect()}
        assert got == {(asker, 0): (other, 0, True), (3, 0): (None, None, False)}
        assert {(r.conv_id, r.turn): (r.n_linked, r.n_cross) for r in conversations(df).collect()}[asker, 0] == (1, 1)
