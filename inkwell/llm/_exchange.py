"""Counting keys over the whole corpus and bringing the counts back to where they are asked.

A *chunk* is a slab of documents.  Each chunk sends its distinct 64-bit keys
with local counts, split by the keys' top bits into parts; one task adds up a
part and answers every chunk in the order of its request, so an answer needs
no keys.  A frequent key is one entry for each chunk, so no part is hot.  The
number of parts follows the number of keys: a part holds about
``KEYS_PER_PART`` keys at any input size.

Beyond ``FLAT`` parts there are two levels, since a chunk's few keys for each of
very many parts would make very many small rows: chunks address coarse parts,
whose requests are merged for groups of chunks, and those address the fine
parts.  So a row holds hundreds of keys where both levels have thousands of
parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm._spill import written
from inkwell.llm._text import pack, pack_sorted, unpack, unpack_sorted

KEYS_PER_PART = 1_000_000
FLAT = 4096
REQUEST = "chunk long, part int, keys binary, counts binary"
ANSWER = "chunk long, part int, counts binary, distinct long"


class Levels(NamedTuple):
    """``parts`` that chunks address, each of ``fine`` ranges; ``fine`` is also the number of groups of chunks."""

    parts: int
    fine: int


def levels(keys: int) -> Levels:
    parts = max(1, -(-int(keys) // KEYS_PER_PART))
    if parts <= FLAT:
        return Levels(parts, 1)
    coarse = isqrt(parts - 1) + 1
    return Levels(coarse, -(-parts // coarse))


def bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins among ascending keys: parts are equal ranges of the 64-bit space."""
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)])).astype(np.int64)


def request(chunk: int, keys: np.ndarray, counts: list[np.ndarray], parts: int) -> list[dict]:
    """The rows of a chunk's request: ascending distinct keys, with one or more arrays of uint32 counts."""
    cut = bounds(keys, parts)
    return [
        {"chunk": chunk, "part": p, "keys": pack_sorted(keys[a:b]), "counts": pack(np.concatenate([c[a:b].astype(np.uint32) for c in counts]))}
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))
        if b > a
    ]


def _answer(table: pa.Table) -> pa.Table:
    """All requests of a part: the sums of their counts, in the order of each request."""
    keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    given = [unpack(c, np.uint32).reshape(-1, n) for c, n in zip(table.column("counts").to_pylist(), sizes, strict=True)]
    kinds = given[0].shape[0]
    sums = []
    for k in range(kinds):
        total = np.bincount(where, weights=np.concatenate([g[k] for g in given]), minlength=len(every))
        sums.append(total.astype(np.uint64)[where])
    ends = np.cumsum(sizes)
    out = [pack(np.concatenate([s[e - n : e] for s in sums])) for e, n in zip(ends, sizes, strict=True)]
    first = np.zeros(len(sizes), np.int64)  # of each part: even keys that any chunk counted
    first[0] = np.count_nonzero(np.bincount(where, weights=sum(np.concatenate([g[k] for g in given]) for k in range(kinds)), minlength=len(every))[every & np.uint64(1) == 0])
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "counts": pa.array(out, pa.binary()), "distinct": first})


def _merge(at: Levels) -> Callable[[pa.Table], pa.Table]:
    """The requests of a group of chunks to a part as one, split into the part's fine ranges; its chunk is the group."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        given = [unpack(c, np.uint32).reshape(-1, len(k)) for c, k in zip(table.column("counts").to_pylist(), keys, strict=True)]
        sums = [np.bincount(where, weights=np.concatenate([g[i] for g in given]), minlength=len(every)) for i in range(len(given[0]))]
        part, group = table.column("part")[0].as_py(), table.column("grp")[0].as_py()
        cuts = np.array([((part * at.fine + i) << 64) // (at.parts * at.fine) for i in range(1, at.fine)], np.uint64)
        cut = np.concatenate(([0], np.searchsorted(every, cuts), [len(every)])).tolist()
        rows = [
            {"chunk": group, "part": part * at.fine + i, "keys": pack_sorted(every[a:b]), "counts": pack(np.concatenate([x[a:b].astype(np.uint32) for x in sums]))}
            for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))
            if b > a
        ]
        return pa.Table.from_pylist(rows, schema=pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return run


def _return(requests: pa.Table, merged: pa.Table) -> pa.Table:
    """What the fine parts answered to a group, for each of its chunks in the order of its request."""
    keys = [unpack_sorted(k) for k in requests.column("keys").to_pylist()]
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    kinds = len(unpack(requests.column("counts")[0].as_py(), np.uint32)) // len(keys[0])
    sums = read_answer(merged, kinds)
    ends = np.cumsum([len(k) for k in keys])
    out = [pack(np.concatenate([s[where[e - len(k) : e]] for s in sums])) for e, k in zip(ends, keys, strict=True)]
    first = np.zeros(len(keys), np.int64)
    first[0] = sum(merged.column("distinct").to_pylist())
    return pa.table({"chunk": requests.column("chunk"), "part": requests.column("part"), "counts": pa.array(out, pa.binary()), "distinct": first})


def counted(requests: DataFrame, at: Levels) -> DataFrame:
    """Answers (see ANSWER) to requests (see REQUEST) that address ``at.parts`` parts."""
    if at.fine == 1:
        return requests.groupBy("part").applyInArrow(_answer, ANSWER)
    asked = written(requests.withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(at.fine)).cast("int")), "requests")
    merged = asked.groupBy("part", "grp").applyInArrow(_merge(at), REQUEST)
    found = merged.groupBy("part").applyInArrow(_answer, ANSWER).withColumn("grp", F.col("chunk").cast("int")).withColumn("coarse", F.floor(F.col("part") / at.fine).cast("int"))
    return asked.groupBy("part", "grp").cogroup(found.groupBy("coarse", "grp")).applyInArrow(_return, ANSWER)


def read_answer(table: pa.Table, kinds: int) -> list[np.ndarray]:
    """The counts of a chunk's keys, in ascending key order, from all its answers."""
    order = np.argsort(np.asarray(table.column("part")), kind="stable")
    blobs = table.column("counts").to_pylist()
    each = [unpack(blobs[i], np.uint64).reshape(kinds, -1) for i in order]
    return list(np.concatenate(each, 1)) if each else [np.zeros(0, np.uint64)] * kinds


def chunk_ids() -> Iterator[int]:
    """Ids that no other task of the same job gives."""
    from pyspark import TaskContext

    context = TaskContext.get()
    start = (context.partitionId() if context else 0) << 32
    while True:
        yield start
        start += 1
