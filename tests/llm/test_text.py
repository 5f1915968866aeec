import numpy as np

from inkwell.llm._text import flat, span_hashes, word_hashes, words


def thue_morse(n, first):
    return bytes(97 + (bin(i).count("1") + first) % 2 for i in range(n))


def test_patterned_words_stay_apart():
    for n in (1024, 2048, 4096, 16384, 65536):
        pair = [thue_morse(n, 0), thue_morse(n, 1)]
        data = np.frombuffer(b" ".join(pair), np.uint8)
        start, end, _ = words(data, np.array([0, len(data)]))
        assert len(set(word_hashes(data, start, end).tolist())) == 2


def test_spans():
    rng = np.random.Generator(np.random.PCG64(3))
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 3000)
    ends = starts + rng.integers(1, 40, 3000)
    hashes = span_hashes(data, starts, ends)
    seen = {}
    for a, b, h in zip(starts.tolist(), ends.tolist(), hashes.tolist()):
        assert seen.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
    zeros = np.zeros(64, np.uint8)  # zero bytes count: lengths differ
    at = np.arange(1, 33)
    assert len(set(span_hashes(zeros, np.zeros(32, np.int64), at).tolist())) == 32
    assert len(span_hashes(data, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
    assert len(flat(__import__("pyarrow").array([None, "a"]))[0]) == 1
