import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from inkwell.llm.bpe import Encoder, encode

PATH = P.path("word_bpe_49k.json")
ODD = [
    "", None, "a", "It's we'll 'sun ''s !!'t x'd'd O'REILLY 're", "ΣΑΣ ς İstanbul ǅ", "é ﬁ Å", "12 3½ ² ٣",
    "a\x1cb\x85c\xa0d​e　f\x00g", "<|endoftext|>hi<|startoftext|><|endoftext|> there<|endoftext|>", "🙂🙂 \U0001f468‍\U0001f469", "x" * 5000, "ab" * 3000 + " " + "!?" * 999,
    "中文字符 हिन्दी ไทย", "'", "'s", "s's's", " \n\t ", "don'tt'rev'v'vex",
]


def brute(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def same(texts):
    e = Encoder(PATH)
    ids, offs = e.encode([x or "" for x in texts])
    data, ends = e.decode(ids, offs)
    data = data.tobytes()
    want, text = brute(texts)
    for i, x in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == want[i], repr(x)[:200]
        assert data[ends[i] : max(ends[i], ends[i + 1] - 1)].decode() == text[i]


def test_odd_texts():
    same(ODD)


def test_documents():
    same(pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist())


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in encode(df, PATH).collect()}
    want, text = brute(ODD)
    for i in range(len(ODD)):
        assert got[i].token_ids == want[i] and got[i].decoded == text[i] and got[i].n_tokens == len(want[i])
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want[i], "<u4").tobytes()).hexdigest()
    assert encode(df.limit(0), PATH).count() == 0


def test_every_code_point():
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    e = Encoder(PATH)
    for i in range(0, len(every), 1 << 15):  # alone, between letters, with a combining mark, after a number, twice
        part = [" ".join(f"{c} a{c}b A{c}́ 1{c}{c}" for c in every[k : k + 64]) for k in range(i, min(i + (1 << 15), len(every)), 64)]
        ids, offs = e.encode(part)
        for k, want in enumerate(t.encode_batch(part, add_special_tokens=False)):
            assert ids[offs[k] : offs[k + 1]].tolist() == want.ids, hex(ord(part[k][0]))


def test_words_of_one_hash(monkeypatch):
    from inkwell.llm import bpe

    strong = bpe.span_hashes
    monkeypatch.setattr(bpe, "span_hashes", lambda *a: strong(*a) & np.uint64(3))
    same([*ODD, *ODD, "some other words of one hash", "even more of them here"])


def test_long_patterned_words():
    words = ["".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(2048)) for k in (0, 1)]
    same([" ".join(words), " ".join(words[::-1])])


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in encode(df, PATH).collect())
    assert got == [(0, 0), (0, 2), (1, 1), (1, 2), (1, 2)]
