"""LM scoring by deleted interpolation.

A bigram model whose estimate mixes three maximum-likelihood parts::

    P(w | h) = l2[b] * c(h, w) / c(h) + l1[b] * c(w) / N + l0[b] / (V + 1)

``b`` is the bucket of the context's frequency (the bit length of c(h)).  The
weights of each bucket are learned by expectation-maximisation: a tenth of the
training documents, chosen by a hash of the id, is deleted from the counts and
the weights maximise the likelihood of its tokens under the counts of the rest.
Then all training documents give the counts.

Counts cover the whole corpus and travel as distinct keys of each chunk (see
``_exchange``).  EM runs over a histogram of the deleted tokens: a cell is a
bucket and the octaves of the two parts relative to the uniform one, and keeps
the mean logarithm of each part.  There are at most 41 * 82 * 82 cells (9 MB),
whatever the size of the corpus; nothing else reaches the driver.

Tokens are told apart by 64-bit hashes.  Defined results: null or empty text is
one token, the end; a null id stays null and its text is for training; rows that
repeat an id are texts of their own, each learned from or held out as the id
says; a first word has the text's beginning as its context; with nothing to
learn from the weights are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm._exchange import ANSWER, REQUEST, chunk_ids, counted, levels, read_answer, request
from inkwell.llm._spill import discard, null_ids, with_ids, written
from inkwell.llm._text import flat, lower, mix, pack, pack_sorted, slabs, unpack, unpack_sorted, word_hashes, words

EVEN = np.uint64(2**64 - 2)
END = np.uint64(0x5851F42D4C957F2C)
BEGIN = np.uint64(0x14057B7EF767814F)
KEPT, DELETED, HELD_OUT = 0, 1, 2
SHIFT, LEVELS = 41, 82
CHUNK_BYTES = 4 << 20
CHUNK = "chunk long, doc_ids binary, lengths binary, roles binary, vocabulary binary, tokens binary, n_keys long, n_kept long, n_deleted long, d_kept long, d_deleted long"


def token_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all tokens in order, number of tokens of each row): the words and an end for each row; even numbers."""
    data = lower(data)
    start, end, before = words(data, offs)
    lengths = np.diff(before) + 1
    keys = np.full(lengths.sum(), END & EVEN, np.uint64)
    is_word = np.ones(len(keys), bool)
    is_word[np.cumsum(lengths) - 1] = False
    keys[is_word] = word_hashes(data, start, end) & EVEN
    return keys, lengths


def pair_keys(vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Odd keys of (previous token, token); BEGIN comes before each row."""
    keys = vocabulary[tokens]
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[np.cumsum(lengths) - lengths] = BEGIN
    return mix(mix(before) + keys * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = chunk_ids()
    for slab in slabs(batches, limit=CHUNK_BYTES):
        doc_ids, roles = np.asarray(slab.column(0)), np.asarray(slab.column(2)).astype(np.uint8)
        keys, lengths = token_keys(*flat(slab.column(1)))
        vocabulary, tokens = np.unique(keys, return_inverse=True)
        pairs = len(np.unique(pair_keys(vocabulary, tokens, lengths)))
        row = {"chunk": next(ids), "doc_ids": pack(doc_ids), "lengths": pack(lengths.astype(np.uint32)), "roles": pack(roles), "vocabulary": pack_sorted(vocabulary), "tokens": pack(tokens.astype(np.uint32)), "n_keys": len(vocabulary) + pairs}
        for role, name in ((KEPT, "kept"), (DELETED, "deleted")):
            row[f"n_{name}"], row[f"d_{name}"] = int(lengths[roles == role].sum()), int((roles == role).sum())
        order = [c.split()[0] for c in CHUNK.split(", ")]
        yield pa.RecordBatch.from_pylist([{c: row[c] for c in order}])


class Chunk:
    """A row of the chunk table, unpacked, with the distinct pairs of its tokens."""

    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.doc_ids = unpack(row["doc_ids"], np.int64)
        self.lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
        self.roles = unpack(row["roles"], np.uint8)
        self.vocabulary = unpack_sorted(row["vocabulary"])
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        self.pairs, self.pair = np.unique(pair_keys(self.vocabulary, self.tokens, self.lengths), return_inverse=True)
        self.keys = np.concatenate((self.vocabulary, self.pairs))
        self.order = np.argsort(self.keys, kind="stable")
        self.role = np.repeat(self.roles, self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths

    def request(self, parts: int) -> list[dict]:
        counts = []
        for role in (KEPT, DELETED):
            own = self.role == role
            n = np.concatenate((np.bincount(self.tokens[own], minlength=len(self.vocabulary)), np.bincount(self.pair[own], minlength=len(self.pairs))))
            counts.append(n[self.order])
        return request(self.id, self.keys[self.order], counts, parts)

    def resolve(self, answer: np.ndarray, begins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: the counts of itself, of its context and of both, given the keys' counts in ascending order."""
        counts = np.empty(len(self.keys), np.int64)
        counts[self.order] = answer
        one = counts[: len(self.vocabulary)][self.tokens]
        context = np.empty_like(one)
        context[1:] = one[:-1]
        context[self.first] = begins
        return one, context, counts[len(self.vocabulary) :][self.pair]


def bucket(context: np.ndarray) -> np.ndarray:
    """The bit length of the context's count: 0 for none, at most 40."""
    return np.minimum(np.frexp(context.astype(float))[1], 40)


def _level(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(octave from 1, logarithm to base 2) of a part relative to the uniform part; 0 and 0 where it is 0."""
    log = np.log2(part, where=part > 0, out=np.zeros(len(part)))
    return np.where(part > 0, np.clip(np.floor(log) + SHIFT, 1, LEVELS - 1), 0).astype(np.int64), log


def learn(cells: np.ndarray, counts: np.ndarray, logs: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM for the weights (l2, l1, l0) of each of 41 buckets; ``logs`` are the mean logarithms of each cell's two parts.

    Buckets without counts take the pooled weights.
    """
    spot = cells // (LEVELS * LEVELS)
    level = np.stack([cells // LEVELS % LEVELS, cells % LEVELS], 1)
    part = np.where(level > 0, 2.0**logs, 0.0)
    part = np.concatenate((part, np.ones((len(part), 1))), 1)

    def em(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            share = part[rows] * weights
            share *= (counts[rows] / share.sum(1))[:, None]
            weights = np.maximum(share.sum(0), 1e-9)
            weights /= weights.sum()
        return weights

    pooled = em(np.arange(len(cells)), np.full(3, 1 / 3)) if len(cells) else np.full(3, 1 / 3)
    out = np.tile(pooled, (41, 1))
    for b in np.unique(spot):
        out[b] = em(np.flatnonzero(spot == b), pooled)
    out = np.maximum(out, 1e-6)
    return out / out.sum(1, keepdims=True)


def score(docs: DataFrame, held_out) -> DataFrame:
    """Scores of ``docs`` (doc_id, text); ``held_out`` is a boolean column: rows that nothing is learned from.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    and ``bits_per_token``.
    """
    role = F.when(held_out, HELD_OUT).when(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0, DELETED).otherwise(KEPT)
    chunks = written(with_ids(docs.withColumn("_role", role.cast("int")), "_role").mapInArrow(_chunks, CHUNK), "chunks")
    total = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_keys", "n_kept", "n_deleted", "d_kept", "d_deleted")]).first()
    at = levels(total.n_keys)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = Chunk(batch.slice(row, 1).to_pylist()[0]).request(at.parts)
                for i in range(0, len(found), 64):
                    yield pa.RecordBatch.from_pylist(found[i : i + 64], schema=pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    answers = written(counted(chunks.mapInArrow(ask, REQUEST), at), "answers")
    types = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first().v
    train, rest = total.n_kept + total.n_deleted, max(total.n_kept, 1)
    begins, kept_begins = total.d_kept + total.d_deleted, total.d_kept
    uniform = 1 / (types + 1)

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left.to_pylist()[0])
        kept, deleted = read_answer(right, 2)
        one, context, both = chunk.resolve(kept, kept_begins)
        own = chunk.role == DELETED
        b = bucket(context[own])
        two, log2 = _level(both[own] / np.maximum(context[own], 1) / uniform)
        single, log1 = _level(one[own] / rest / uniform)
        cells, where, n = np.unique((b * LEVELS + two) * LEVELS + single, return_inverse=True, return_counts=True)
        logs = np.stack([np.bincount(where, weights=x, minlength=len(cells)) for x in (log2, log1)])
        one, context, both = chunk.resolve(kept + deleted, begins)
        first = chunk.first
        base = np.add.reduceat(np.log10((one + 1) / (train + types + 1)), first)
        known = np.add.reduceat((one > 0).astype(np.int64), first)
        row = {"doc_ids": pack(chunk.doc_ids), "lengths": pack(chunk.lengths), "roles": pack(chunk.roles), "base": pack(base), "known": pack(known), "one": pack(one.astype(np.uint64)), "both": pack(both.astype(np.uint64)), "cells": pack(cells), "n": pack(n), "logs": pack(logs.ravel())}
        return pa.table({k: pa.array([v], pa.binary()) for k, v in row.items()})

    fields = "doc_ids binary, lengths binary, roles binary, base binary, known binary, one binary, both binary, cells binary, n binary, logs binary"
    resolved = written(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(resolve, fields), "resolved")
    discard(chunks)
    discard(answers)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                log2, log1 = unpack(row["logs"], np.float64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (unpack(row["cells"], np.int64), unpack(row["n"], np.int64), log2, log1)], names=["cell", "n", "log2", "log1"])

    sums = [F.sum(c).alias(c) for c in ("n", "log2", "log1")]
    seen = resolved.select("cells", "n", "logs").mapInArrow(spread, "cell long, n long, log2 double, log1 double").groupBy("cell").agg(*sums).toArrow()
    n = np.asarray(seen.column("n"), float)
    weights = learn(np.asarray(seen.column("cell"), np.int64), n, np.stack([np.asarray(seen.column(c), float) / n for c in ("log2", "log1")], 1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lengths, roles = unpack(row["lengths"], np.int64), unpack(row["roles"], np.uint8)
                one, both = unpack(row["one"], np.uint64).astype(np.int64), unpack(row["both"], np.uint64).astype(np.int64)
                first = np.cumsum(lengths) - lengths
                context = np.empty_like(one)
                context[1:] = one[:-1]
                context[first] = begins
                w = weights[bucket(context)]
                p = w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * one / max(train, 1) + w[:, 2] * uniform
                total = np.add.reduceat(np.log10(p), first)
                out = {"doc_id": unpack(row["doc_ids"], np.int64), "held_out": roles == HELD_OUT, "n_tokens": lengths, "n_known": unpack(row["known"], np.int64), "train_tokens": np.full(len(lengths), train), "base_score": unpack(row["base"], np.float64), "score": total, "bits_per_token": -total / lengths * np.log2(10)}
                yield pa.RecordBatch.from_pydict(out)

    out = resolved.select("doc_ids", "lengths", "roles", "base", "known", "one", "both").mapInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_token double"
    )
    return null_ids(out)
