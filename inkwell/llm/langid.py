"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  One binary logistic classifier over
hashed character n-grams predicts each bit; decoding weighs each bit's logistic
loss by that bit's accuracy on a part of the sample held back from fitting, and
chooses the codeword with the smallest weighted loss.  A small margin to the
second codeword flags the text as ambiguous.

Fitting uses a bounded sample of labelled rows: about ``per_language`` rows of
each language and ``SAMPLE_ROWS`` in all, chosen by a hash of id and text, so that of
very many languages each has fewer.  Only hashed feature vectors of the sample
reach the driver: ``DIM`` half floats a row, 160 MB at most.  More than
``LANGUAGES`` languages are an error, never left out.  Prediction is map-only.

Defined results: equal losses go to the language that comes first by name; rows
that repeat an id are rows of their own; a null id is in no held-out fold; null text, or text without a letter (Unicode category L), is
``und`` with score 0; with no labelled row everything is ``und``; with one
language its score is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.llm._text import BYTE_VALUES, BASE, flat, slabs

BITS = 12
DIM = 1 << BITS
ORDERS = 4
ROWS = 512
PER_LANGUAGE, SAMPLE_ROWS, LANGUAGES = 600, 20_000, 1000
AMBIGUOUS = 0.1
UNDETERMINED = "und"
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER = regex.compile(r"\p{L}")


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Unit-length rows of square-rooted counts of hashed n-grams of 1 to ORDERS bytes, letters folded."""
    rows = len(offs) - 1
    out = np.zeros(rows * DIM, np.float32)
    value = BYTE_VALUES[_FOLD[data]]
    row = np.repeat(np.arange(rows, dtype=np.int64) * DIM, np.diff(offs))
    end = np.repeat(offs[1:], np.diff(offs))
    rolled = np.zeros(len(data), np.uint64)
    for n in range(1, ORDERS + 1):
        size = len(data) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * BASE + value[n - 1 :]
        inside = np.arange(n, len(data) + 1) <= end[:size]
        cell = row[:size] + ((rolled * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
        out += np.bincount(cell[inside], minlength=rows * DIM)
    out = np.sqrt(out).reshape(rows, DIM)
    out /= np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)
    return out


def codebook(count: int) -> np.ndarray:
    """Codewords of +1 and -1: all distinct splits up to seven languages, else the best of random codes."""
    if count <= 1:
        return np.ones((count, 0), np.float32)
    if count <= 7:
        cells = np.arange(1, 1 << (count - 1))
        rows = [np.zeros(len(cells), int)] + [cells >> k & 1 for k in range(count - 1)]
        return (np.array(rows) * 2 - 1).astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(7))
    bits = 10 * int(np.ceil(np.log2(count)))
    codes = (rng.integers(0, 2, (count, bits)) * 2 - 1 for _ in range(20))
    return max(codes, key=lambda c: -np.max(c @ c.T - 2 * bits * np.eye(count))).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A row of each text's shares over the languages: from loss-weighted distances to the codewords."""
        margin = x @ self.weights + self.bias
        agree = np.logaddexp(0, -margin) * self.trust
        differ = np.logaddexp(0, margin) * self.trust
        one = (self.codes > 0).astype(np.float32)
        distance = agree @ one.T + differ @ (1 - one).T
        share = np.exp(distance.min(1, keepdims=True) - distance)
        return share / share.sum(1, keepdims=True)


def train(languages: list[str], x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 30.0, decay: float = 1e-5) -> Model:
    """One logistic classifier per bit by gradient descent with momentum; every fifth row only weighs the bits."""
    codes = codebook(len(languages))
    bits = codes.shape[1]
    w, b = np.zeros((DIM, bits), np.float32), np.zeros(bits, np.float32)
    trust = np.ones(bits, np.float32)
    if bits and len(x):
        back = np.arange(len(x)) % 5 == 4
        back &= len(x) >= 20
        xt, target = x[~back], codes[y[~back]]
        speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
        share = np.bincount(y[~back], minlength=len(languages)).astype(np.float32)
        weight = (1 / np.maximum(share, 1))[y[~back], None] / len(languages)
        for _ in range(steps):
            slope = -target * weight / (1 + np.exp(np.clip(target * (xt @ w + b), -30, 30)))
            speed_w = 0.9 * speed_w - rate * (xt.T @ slope + decay * w)
            speed_b = 0.9 * speed_b - rate * 0.1 * slope.sum(0)
            w, b = w + speed_w, b + speed_b
        if back.any():
            right = ((x[back] @ w + b) * codes[y[back]] > 0).mean(0)
            trust = np.log((right * back.sum() + 1) / ((1 - right) * back.sum() + 1)).clip(0.05)
        trust = (trust / trust.mean()).astype(np.float32)
    return Model(languages, codes, w, b, trust)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for slab in slabs(batches):
        for i in range(0, slab.num_rows, ROWS):
            part = slab.slice(i, ROWS)
            x = features(*flat(part.column(part.schema.get_field_index("text")))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "vector"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from rows (doc_id, text, lang); rows with null text or lang are left out."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return train([], np.zeros((0, DIM), np.float32), np.zeros(0, int))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, per_language / counts[k], SAMPLE_ROWS / len(counts) / counts[k]))]), F.col("lang"))
    table = rows.where(part < share).mapInArrow(_vectors, "doc_id long, lang string, vector binary").toArrow()
    if not table.num_rows:
        return train(languages, np.zeros((0, DIM), np.float32), np.zeros(0, int))
    ids, vectors = table.column("doc_id").fill_null(-1).to_pylist(), table.column("vector").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], vectors[i]))  # the same whatever order tasks end in
    x = np.frombuffer(b"".join(vectors), np.float16).reshape(-1, DIM)[order].astype(np.float32)
    place = {k: i for i, k in enumerate(languages)}
    return train(languages, x, np.array([place[k] for k in table.column("lang").to_pylist()])[order])


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, margin: float = AMBIGUOUS) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (share of the chosen codeword), ``ambiguous`` and ``runner_up``; input columns of those names are replaced."""
    new = ("lang_pred", "score", "ambiguous", "runner_up")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL("lang_pred string, score double, ambiguous boolean, runner_up string").fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DIM x bits of the codebook

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for slab in slabs(batches):
            for i in range(0, slab.num_rows, ROWS):
                part = slab.slice(i, ROWS)
                column = part.column(part.schema.get_field_index("text"))
                known = np.array([bool(t and _LETTER.search(t)) for t in column.to_pylist()]) & bool(m.languages)
                best = np.full(part.num_rows, len(m.languages))
                second, score, gap = best.copy(), np.zeros(part.num_rows), np.zeros(part.num_rows)
                if known.any():
                    share = m.probabilities(features(*flat(column)))
                    order = np.argsort(-share, 1, kind="stable")
                    every = np.arange(part.num_rows)
                    best = np.where(known, order[:, 0], best)
                    score = np.where(known, share[every, order[:, 0]], 0.0)
                    if share.shape[1] > 1:
                        second = np.where(known, order[:, 1], second)
                        gap = np.where(known, score - share[every, order[:, 1]], 0.0)
                    else:
                        gap = score
                out = [part.column(part.schema.get_field_index(c)) for c in keep]
                out += [pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1).astype(float)), pa.array(gap < margin), pa.array(names[second], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def fold(doc_id: Column | str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; 1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id), F.lit(parts)), F.lit(1))
