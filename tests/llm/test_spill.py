import pytest

from inkwell.llm import _spill


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def __getattr__(self, name):
            return getattr(spark.sparkContext, name)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})()

    _spill.workdir(spark)  # a local session gets one
    monkeypatch.setattr(Session.sparkContext.__class__, "getConf", lambda self: type("C", (), {"get": staticmethod(lambda key: None)})(), raising=False)
    unset = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()
    monkeypatch.setattr(Session.sparkContext.__class__, "_jsc", unset, raising=False)
    with pytest.raises(ValueError):
        _spill.workdir(Session())


def test_what_was_written_on_the_way_goes(spark):
    before = {t.name for t in spark.catalog.listTables()}
    made = []

    def make():
        inner = _spill.written(spark.range(10).toDF("x"), "inner")
        held = _spill.bucketed(inner, "held", "x", 2)
        made.extend([inner, held])
        return held.where("x > 4")

    out = _spill.settled(spark, make, "out")
    assert sorted(r.x for r in out.collect()) == [5, 6, 7, 8, 9]
    assert {t.name for t in spark.catalog.listTables()} == before
    with pytest.raises(Exception):
        made[0].count()


def test_source_bytes(spark):
    assert _spill.source_bytes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")) > 10_000
    assert _spill.source_bytes(spark.range(5)) >= 0
