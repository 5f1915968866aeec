import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import langid
from inkwell.llm.langid import codebook, fit, fold, predict
from inkwell.llm.queries import op4_output_codes

SF = "/root/testdata/sf0.01"


def test_codebook():
    for n in (2, 3, 4, 7, 12):
        c = codebook(n)
        assert len({tuple(r) for r in c}) == n and set(np.unique(c)) == {-1.0, 1.0}
    assert codebook(1).shape == (1, 0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op4_output_codes(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    n, right, unsure = got.agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("ambiguous").cast("int"))).first()
    assert n > 100 and right > 0.97 and unsure < 0.05


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "der hund und die katze", "de", 1), (3, None, "en", 1), (4, "", "de", 1), (5, "123 !?", None, 1), (6, "the " * 90000, None, 1), (7, "a", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in predict(df, fit(df)).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[3].score == 0
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de" and got[6].lang_pred == "en" and 0 <= got[7].score <= 1
    none = predict(df, fit(df.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    one = predict(df, fit(df.where("lang = 'de'"))).where("doc_id = 1").first()
    assert one.lang_pred == "de" and one.score == 1
    assert predict(df.limit(0), fit(df)).count() == 0
    assert df.where(fold() == 0).count() < 7


def brute_features(text):
    """Counts of hashed n-grams of 1 to 4 bytes, one by one."""
    raw = [b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0x20 for b in text.encode()]
    count = np.zeros(langid.DIM)
    for n in range(1, langid.ORDERS + 1):
        for i in range(len(raw) - n + 1):
            h = 0
            for b in raw[i : i + n]:
                h = (h * int(langid.BASE) + int(langid.BYTE_VALUES[b])) % 2**64
            count[(h * 0xD6E8FEB86659FD93 + n) % 2**64 >> 64 - langid.BITS] += 1
    x = np.sqrt(count)
    return x / max(np.linalg.norm(x), 1e-9)


def brute_decode(model, text):
    """The language whose codeword has the least trust-weighted logistic loss, and its share."""
    x = brute_features(text)
    loss = []
    for code in model.codes:
        loss.append(sum(t * np.log1p(np.exp(-bit * (x @ w + b))) for bit, t, w, b in zip(code, model.trust, model.weights.T, model.bias)))
    share = np.exp(-(np.array(loss) - min(loss)))
    share /= share.sum()
    return model.languages[int(np.argmin(loss))], share.max()


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit(docs)
    got = predict(docs.where(F.length("text") < 3000).limit(60), model).collect()
    for r in got:
        if r.lang_pred == "und":
            continue
        lang, share = brute_decode(model, r.text)
        assert r.lang_pred == lang and abs(r.score - share) < 1e-3


def test_many_languages(spark, monkeypatch):
    words = {f"l{k:02d}": f"{chr(97 + k % 26)}{chr(97 + (k * 7 + k // 26 * 5) % 26)}q" for k in range(40)}
    rows = [(i, (words[lang] + " ") * 12, lang) for i in range(20) for lang in words]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 400)
    model = fit(df)
    assert len(model.languages) == 40
    right = predict(df.dropDuplicates(["lang"]), model).where("lang = lang_pred").count()
    assert right >= 38
    monkeypatch.setattr(langid, "LANGUAGES", 39)
    with pytest.raises(ValueError):
        fit(df)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "the cat", "en"), (None, None, "en"), (1, "der hund", "de"), (1, "der hund", "de"), (1, "le chat", "fr")], "doc_id long, text string, lang string")
    got = predict(df, fit(df)).withColumn("held_out", fold() == 0).collect()
    assert len(got) == 5 and all(r.held_out is not None for r in got) and [r.held_out for r in got if r.doc_id is None] == [False, False]


def test_ties_go_to_the_first_name():
    model = langid.train(["a", "b", "c"], np.zeros((0, langid.DIM), np.float32), np.zeros(0, int))
    share = model.probabilities(np.zeros((1, langid.DIM), np.float32))
    assert np.allclose(share, 1 / 3) and int(np.argsort(-share, 1, kind="stable")[0, 0]) == 0
