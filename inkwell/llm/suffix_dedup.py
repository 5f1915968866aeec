"""Removal of long repeats by a multi-document suffix array, built column by column.

A window is a string of ``length`` bytes.  Every byte that lies in a window
which also starts anywhere else in the corpus is removed.

* Every window has an anchor, its leftmost 32-byte substring of least hash.
  Consecutive windows with one anchor, split by the anchor's distance in them
  into two ranges, form a *piece*: a short string with at most
  ``(length - 32) / 2`` windows, all of which hold a *core* of more than half
  of ``length`` bytes.  The core's hash is the piece's name.  Anchor, range and
  core follow from a window's content, so equal windows have equal names.
* The corpus is counted by name.  All pieces of a name that occurs twice meet by
  name in parts of bounded size; a chunk sends one of each distinct piece with
  its count.
* In a part pieces are compared byte by byte: all windows of one that occurs
  twice are repeats.  The distinct pieces of the names that have several are the documents of a collection
  Burrows-Wheeler transform, a core as one symbol of its own: each round inserts
  one symbol of every piece, from the right, into the sequential columns of
  preceding symbols and of common prefixes (a core counts with its bytes);
  after the last round a window that shares ``length`` bytes with its neighbour
  in suffix order is a repeat.
* A name with more than ``HOT`` pieces doesn't meet in one part: the windows of
  its pieces are counted by 64-bit hash instead, which is exact up to collisions.

The columns of a part are a few MB and stay in memory; what is larger than a
part is in sequential Parquet files in the session's shared folder.

Defined results: null and empty text stay empty; texts shorter than ``length``
stay whole; matches never cross documents; copies count as each other's
repeat; a null id stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.llm._exchange import REQUEST, bounds, chunk_ids, counted, levels, request
from inkwell.llm._spill import bucketed, null_ids, source_bytes, with_ids, written
from inkwell.llm._text import BASE, BYTE_VALUES, flat, mix, pack, ragged, slabs, unpack

LENGTH, GRAM, HOT = 200, 32, 20_000
PART_BYTES, BUCKET_BYTES = 1 << 20, 64 << 20
CHUNK_BYTES = 2 << 20
NOTHING = np.uint16(65535)  # before the first symbol
CORES, END, LOW = 254, np.uint32(0xFF00FFFF), np.uint32(0xFFFF)
EVEN = np.uint64(2**64 - 2)
ZSTD = pa.Codec("zstd", 1)


def squeeze(data: np.ndarray) -> bytes:
    return len(data).to_bytes(8, "little") + ZSTD.compress(data.tobytes(), asbytes=True)


def stretch(blob: bytes) -> np.ndarray:
    return np.frombuffer(ZSTD.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True), np.uint8)


def insert_columns(symbols: np.ndarray, offs: np.ndarray, cap: int, core: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(preceding symbols, common prefixes up to ``cap``) of all suffixes of the strings in suffix order.

    Symbols from 256 on count as ``core`` in a common prefix.  The strings'
    empty suffixes come first, in the strings' order.  Round ``j`` inserts the
    suffix of length ``j`` of every string that long: its symbol stands before
    the suffix inserted last, so its place follows from the number of equal
    symbols above it, and its common prefix from the least one between those
    two symbols' places.  The column is sorted by a byte of each symbol, since
    UTF-8 has none from 254 on; cores, which are few, are sorted among themselves.
    """
    count = len(offs) - 1
    left = offs[1:] - 1
    some = np.diff(offs) > 0
    # of an entry of the column: the symbol in the low half, the common prefix in the third byte, a sort code in the last
    packed = symbols.astype(np.uint32) | np.where(symbols < CORES, symbols, CORES).astype(np.uint32) << np.uint32(24)
    column = np.full(count, END, np.uint32)
    column[some] = packed[left[some]]
    place = np.arange(count)
    active = np.flatnonzero(some)
    owner = np.zeros(int(offs[-1]) + count, np.int32)
    while len(active):
        code = np.ascontiguousarray(column.view(np.uint8)[3::4])
        n = len(column)
        fresh = np.zeros(n, bool)
        fresh[place[active]] = True
        owner[place[active]] = active
        order = np.argsort(code, kind="stable")[: n - np.count_nonzero(code == 255)]
        cores = len(order) - np.count_nonzero(code == CORES)
        order[cores:] = order[cores:][np.argsort(column[order[cores:]] & LOW, kind="stable")]
        new = fresh[order]
        at = np.flatnonzero(new)
        who = owner[order[at]]
        grown = np.empty(count + len(order), np.uint32)
        grown[:count] = column[:count]
        rest = grown[count:]
        rest[~new] = column[count:]
        spot = left[who]
        rest[at] = np.where(spot > offs[who], packed[spot - 1], END)
        after = at[np.append(at[1:] > at[:-1] + 1, at[-1] + 1 < len(order))] + 1
        j = np.sort(np.concatenate((at, after)), kind="stable")
        high = order[j]
        low = order[np.maximum(j - 1, 0)]
        symbol = column[high] & LOW
        same = (j > 0) & (symbol == column[low] & LOW)
        rest[j] &= np.uint32(0xFF00FFFF)
        js, low, high = j[same], low[same] + 1, high[same] + 1
        if len(js):
            down = np.argsort(-low, kind="stable")  # descending, so that the stretches between ranges are empty
            pairs = np.stack([low[down], high[down]], 1).ravel()
            padded = np.append(column.view(np.uint8)[2::4], np.uint8(255))
            least = np.minimum.reduceat(padded, pairs)[::2].astype(np.uint32)
            least += np.where(symbol[same][down] < 256, np.uint32(1), np.uint32(core))
            rest[js[down]] |= np.minimum(least, np.uint32(cap)) << np.uint32(16)
        place[who] = count + at
        left[who] -= 1
        column = grown
        active = active[left[active] >= offs[active]]
    return np.ascontiguousarray(column.view(np.uint16)[::2]), np.ascontiguousarray(column.view(np.uint8)[2::4])


def repeated_windows(symbols: np.ndarray, offs: np.ndarray, length: int = LENGTH, core: int = 1) -> np.ndarray:
    """For each position of the strings: does its window of ``length`` start at another position as well?"""
    count = len(offs) - 1
    before, prefix = insert_columns(symbols, offs, length, core)
    long = prefix >= length
    twice = long.copy()
    twice[:-1] |= long[1:]
    order = np.argsort(before, kind="stable")[: len(symbols)]
    follow = np.zeros(len(before), np.int64)
    follow[order] = count + np.arange(len(order))
    out = np.zeros(len(symbols), bool)
    place, at = np.arange(count), offs[1:] - 1
    active = np.flatnonzero(np.diff(offs) > 0)
    while len(active):  # from each empty suffix to ever longer ones
        place[active] = follow[place[active]]
        out[at[active]] = twice[place[active]]
        at[active] -= 1
        active = active[at[active] >= offs[active]]
    return out


class Pieces:
    """The pieces of a slab of texts: start, number of windows, name (an even hash of the core), hash (odd)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int):
        self.length = length
        n = len(data) - length + 1
        spans = np.maximum(np.diff(offs) - length + 1, 0)
        if n <= 0 or not spans.any():
            self.start = self.windows = self.core = np.zeros(0, np.int64)
            self.name = self.hash = np.zeros(0, np.uint64)
            return
        step = self.step(length)
        grams, whole = rolling(data, GRAM, length)
        width = length - GRAM + 1
        place = mix(grams)
        place >>= np.uint64(32)
        place <<= np.uint64(32)
        place |= np.arange(len(grams), dtype=np.uint64)
        least = sliding(place, width, np.minimum)[:n] & np.uint64(0xFFFFFFFF)  # the leftmost least substring of each window
        del place, grams
        at, _ = ragged(offs[:-1], spans)
        spot = least[at].astype(np.int64)
        slot = (spot - at) // step
        begin = np.ones(len(at), bool)
        begin[1:] = (spot[1:] != spot[:-1]) | (slot[1:] != slot[:-1])
        begin[np.cumsum(spans)[:-1][np.cumsum(spans)[:-1] < len(at)]] = True
        first = np.flatnonzero(begin)
        run, sizes = at[first], np.diff(first, append=len(at))
        core = spot[first] - slot[first] * step
        self.start, self.windows, self.core = run, sizes, core - run
        self.hash = mix(mix(whole[run]) + whole[run + sizes - 1] * np.uint64(3) + sizes.astype(np.uint64)) | np.uint64(1)
        del whole
        self.name = mix(rolling(data, 1, length - step + 1)[1][core]) & EVEN

    @staticmethod
    def step(length: int) -> int:
        return (length - GRAM) // 2


def rolling(data: np.ndarray, small: int, large: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all substrings of ``small`` (a power of two) and ``large`` bytes, by doubling."""
    value = BYTE_VALUES[data]
    size, current, power = 1, value, BASE
    first, whole, have = None, None, 0
    while True:
        if size == small:
            first = current
        if large & size:
            whole, have = (current, size) if whole is None else (whole[: len(data) - have - size + 1] * power + current[have:][: len(data) - have - size + 1], have + size)
        if 2 * size > large and size >= small:
            return first, whole
        current = current[: len(data) - 2 * size + 1] * power + current[size:]
        power = np.uint64(int(power) ** 2 & (1 << 64) - 1)
        size *= 2


def sliding(values: np.ndarray, width: int, keep) -> np.ndarray:
    """The least or greatest of each ``width`` consecutive values."""
    size, current = 1, values
    while 2 * size <= width:
        current = keep(current[:-size], current[size:])
        size *= 2
    return keep(current[: len(values) - width + 1], current[width - size :][: len(values) - width + 1])


CHUNK = "chunk long, doc_ids binary, offsets binary, text binary, starts binary, windows binary, cores binary, names binary, hashes binary, n_keys long"
SHIP = "chunk long, part int, sizes binary, cores binary, counts binary, text binary"


def _chunks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = chunk_ids()
        for slab in slabs(batches, limit=CHUNK_BYTES):
            data, offs = flat(slab.column(1))
            p = Pieces(data, offs, length)
            keys = len(np.unique(p.name))
            row = {"chunk": next(ids), "doc_ids": pack(np.asarray(slab.column(0))), "offsets": pack(offs), "text": squeeze(data), "starts": pack(np.diff(p.start, prepend=0)), "windows": pack(p.windows.astype(np.uint16)), "cores": pack(p.core.astype(np.uint16)), "names": pack(p.name), "hashes": pack(p.hash), "n_keys": keys}
            yield pa.RecordBatch.from_pylist([row])

    return run


class Chunk:
    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.start = np.cumsum(unpack(row["starts"], np.int64))
        self.windows = unpack(row["windows"], np.uint16).astype(np.int64)
        self.core = unpack(row["cores"], np.uint16).astype(np.int64)
        self.name, self.hash = unpack(row["names"], np.uint64), unpack(row["hashes"], np.uint64)
        self.keys, self.inverse = np.unique(self.name, return_inverse=True)
        self.row = row

    def request(self, parts: int) -> list[dict]:
        return request(self.id, self.keys, [np.bincount(self.inverse, minlength=len(self.keys))], parts)

    def settle(self, counts: np.ndarray, hot: int) -> None:
        """From the corpus counts of names: which pieces must meet others, which are hot."""
        named = counts.astype(np.int64)[self.inverse]
        meets = named > 1
        self.hot = np.flatnonzero(named > max(hot, 1))
        meets[self.hot] = False
        which = np.flatnonzero(meets)
        order = which[np.lexsort((self.hash[which], self.name[which]))]
        begin = np.ones(len(order), bool)
        begin[1:] = self.hash[order[1:]] != self.hash[order[:-1]]
        self.sent = order[begin]  # one of each distinct piece, by name
        self.group = np.cumsum(begin) - 1
        self.met = order
        self.local = np.bincount(self.group, minlength=len(self.sent))

    def text(self) -> np.ndarray:
        return stretch(self.row["text"])

    def hot_keys(self, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window starts of the hot pieces, their distinct keys, key of each)."""
        at, _ = ragged(self.start[self.hot], self.windows[self.hot])
        if not len(at):
            return at, np.zeros(0, np.uint64), at
        keys, inverse = np.unique(mix(rolling(data, GRAM, length)[1][at]), return_inverse=True)
        return at, keys, inverse


def _meet(length: int):
    def run(table: pa.Table) -> pa.Table:
        """All requests of a part: the distinct pieces' repeated windows, for each request in its order."""
        texts = [stretch(b) for b in table.column("text").to_pylist()]
        sizes = [unpack(b, np.uint16).astype(np.int64) for b in table.column("sizes").to_pylist()]
        counts = np.concatenate([unpack(b, np.uint32) for b in table.column("counts").to_pylist()])
        cores = np.concatenate([unpack(b, np.uint16) for b in table.column("cores").to_pylist()]).tolist()
        core = length - Pieces.step(length) + 1
        known: dict[bytes, int] = {}
        names: dict[bytes, list[int]] = {}
        at_core: list[int] = []
        which = []
        for text, size in zip(texts, sizes, strict=True):
            raw, at = text.tobytes(), 0
            for n in size.tolist():
                piece = raw[at : at + n]
                at += n
                number = known.setdefault(piece, len(known))
                if number == len(at_core):
                    c = cores[len(which)]
                    at_core.append(c)
                    names.setdefault(piece[c : c + core], []).append(number)
                which.append(number)
        which = np.array(which, np.int64)
        windows = np.array([len(k) for k in known], np.int64) - length + 1
        ends = np.cumsum(windows)
        offs = np.concatenate(([0], ends))
        # all windows of a piece that occurs twice are repeats; the transform finds those of pieces that differ and share a name
        twice = np.repeat(np.bincount(which, weights=counts, minlength=len(known)) > 1, windows)
        pieces = list(known)
        shared = [(k, name) for k, name in enumerate(n for n in names.values() if len(n) > 1)]
        if len(shared) > 65000:
            raise ValueError("a part has more names than symbols")
        strings, mine = [], []
        for k, numbers in shared:
            for number in numbers:  # the core, which all windows hold, becomes one symbol
                symbols, c = np.frombuffer(pieces[number], np.uint8).astype(np.uint16), at_core[number]
                strings.append(np.concatenate((symbols[:c], np.array([256 + k], np.uint16), symbols[c + core :])))
                mine.append(number)
        if strings:
            cut = np.concatenate(([0], np.cumsum([len(x) for x in strings]))).astype(np.int64)
            found = repeated_windows(np.concatenate(strings), cut, length, core)
            here, _ = ragged(offs[:-1][mine], windows[mine])
            there, _ = ragged(cut[:-1], windows[mine])
            twice[here] |= found[there]
        out, done = [], 0
        for size in sizes:
            mine = which[done : done + len(size)]
            at, _ = ragged(offs[:-1][mine], windows[mine])
            out.append(np.packbits(twice[at]).tobytes())
            done += len(size)
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "kind": pa.array([1] * len(out), pa.int32()), "body": pa.array(out, pa.binary())})

    return run


BODY = "chunk long, part int, kind int, body binary"


def _only(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(np.asarray(table.column("kind")) == kind))


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: bool = True, spans: bool = True, hot: int = HOT) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    ``text`` adds ``kept_text`` (a character cut in two is left out), ``spans``
    adds ``removed`` (array of struct: begin, end in bytes).  ``length`` is at
    least 64.  Names with more than ``hot`` pieces are counted window by window.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    source = with_ids(docs)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = max(width, -(-source_bytes(docs) // BUCKET_BYTES))
    chunks = bucketed(source.mapInArrow(_chunks(length), CHUNK).repartition(width, "chunk"), "chunks", "chunk", width)
    total = chunks.agg(F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n")).first().n
    at_names = levels(total)
    light = [c for c in chunks.columns if c not in ("text", "doc_ids", "offsets")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _rows(Chunk(batch.slice(i, 1).to_pylist()[0]).request(at_names.parts), REQUEST)

    answers = written(counted(chunks.select(*light).mapInArrow(ask, REQUEST), at_names).select("chunk", "part", F.lit(0).alias("kind"), F.col("counts").alias("body")), "counts")

    def loads(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left.to_pylist()[0])
        chunk.settle(read_body(right), hot)
        sizes = int((chunk.windows[chunk.sent] + length - 1).sum())
        return pa.table({"chunk": [chunk.id], "bytes": [sizes], "hot": [int(chunk.windows[chunk.hot].sum())]})

    def ship(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left.to_pylist()[0])
        chunk.settle(read_body(right), hot)
        data = chunk.text()
        rows = []
        cut = bounds(chunk.name[chunk.sent], meets)
        for p in np.flatnonzero(np.diff(cut)):
            mine = chunk.sent[cut[p] : cut[p + 1]]
            size = chunk.windows[mine] + length - 1
            at, _ = ragged(chunk.start[mine], size)
            rows.append({"chunk": chunk.id, "part": int(p), "sizes": pack(size.astype(np.uint16)), "cores": pack(chunk.core[mine].astype(np.uint16)), "counts": pack(chunk.local[cut[p] : cut[p + 1]].astype(np.uint32)), "text": squeeze(data[at])})
        return pa.Table.from_pylist(rows, schema=_schema(SHIP))

    def ask_hot(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left.to_pylist()[0])
        chunk.settle(read_body(right), hot)
        _, keys, inverse = chunk.hot_keys(chunk.text(), length)
        rows = request(chunk.id, keys, [np.bincount(inverse, minlength=len(keys))], at_windows.parts) if len(keys) else []
        return pa.Table.from_pylist(rows, schema=_schema(REQUEST))

    by_chunk = lambda df, run, schema: chunks.select(*df).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
    load = by_chunk(light, loads, "chunk long, bytes long, hot long").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("hot"), F.lit(0)).alias("hot")).first()
    meets, at_windows = max(1, -(-load.bytes // PART_BYTES)), levels(load.hot)
    every = answers
    if load.bytes:
        met = by_chunk([*light, "text"], ship, SHIP).groupBy("part").applyInArrow(_meet(length), BODY)
        every = every.unionByName(written(met, "met"))
    if load.hot:
        found = counted(by_chunk([*light, "text"], ask_hot, REQUEST), at_windows)
        every = every.unionByName(written(found.select("chunk", "part", F.lit(2).alias("kind"), F.col("counts").alias("body")), "hot"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept_text string" * text + ", removed array<struct<begin: long, end: long>>" * spans

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk = Chunk(row)
        data, offs = chunk.text(), unpack(row["offsets"], np.int64)
        repeat = np.zeros(len(data) + 1, bool)
        if len(chunk.start):
            chunk.settle(read_body(_only(right, 0)), hot)
            if len(chunk.sent):
                repeat[_settled(chunk, _only(right, 1), meets)] = True
            if len(chunk.hot):
                at, _, inverse = chunk.hot_keys(data, length)
                repeat[at[read_body(_only(right, 2))[inverse] > 1]] = True
        edge = np.diff(repeat[:-1].astype(np.int8), prepend=0, append=0) if len(data) else np.zeros(1, np.int8)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        step = np.zeros(len(data) + length + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, last + length, -1)
        gone = np.cumsum(step)[: len(data)] > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        inner = offs[(offs > 0) & (offs < len(data))]
        begin[inner] = gone[inner]
        sums, runs = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(begin)))
        kept = data[~gone].tobytes()
        upto = offs - sums[offs]
        pieces = [kept[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        out = {"doc_id": unpack(row["doc_ids"], np.int64), "n_bytes": np.diff(offs), "n_removed": np.diff(sums[offs]), "n_spans": np.diff(runs[offs]), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in pieces]}
        if text:
            out["kept_text"] = [x.decode(errors="ignore") for x in pieces]
        if spans:
            start = np.flatnonzero(begin)
            finish = gone.copy()
            finish[:-1] &= ~gone[1:] | begin[1:]
            stop = np.flatnonzero(finish) + 1
            owner = np.searchsorted(offs, start, "right") - 1
            lists: list[list[dict]] = [[] for _ in range(len(offs) - 1)]
            for o, a, b in zip(owner.tolist(), (start - offs[owner]).tolist(), (stop - offs[owner]).tolist(), strict=True):
                lists[o].append({"begin": a, "end": b})
            out["removed"] = pa.array(lists, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        return pa.table(out)

    return null_ids(chunks.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(finish, schema))


def _settled(chunk: Chunk, table: pa.Table, meets: int) -> np.ndarray:
    """Starts of the windows that the parts found repeated."""
    bodies = dict(zip(table.column("part").to_pylist(), table.column("body").to_pylist(), strict=True))
    cut = bounds(chunk.name[chunk.sent], meets)
    found = []
    for p in np.flatnonzero(np.diff(cut)):
        n = int(chunk.windows[chunk.sent[cut[p] : cut[p + 1]]].sum())
        found.append(np.unpackbits(np.frombuffer(bodies[int(p)], np.uint8), count=n).astype(bool))
    mask = np.concatenate(found)
    sums = np.concatenate(([0], np.cumsum(chunk.windows[chunk.sent])))
    source, _ = ragged(sums[chunk.group], chunk.windows[chunk.met])
    at, _ = ragged(chunk.start[chunk.met], chunk.windows[chunk.met])
    return at[mask[source]]


def read_body(table: pa.Table) -> np.ndarray:
    order = np.argsort(np.asarray(table.column("part")), kind="stable")
    bodies = table.column("body").to_pylist()
    return np.concatenate([unpack(bodies[i], np.uint64) for i in order]) if len(bodies) else np.zeros(0, np.uint64)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _rows(rows: list[dict], ddl: str, step: int = 64) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), step):
        yield pa.RecordBatch.from_pylist(rows[i : i + step], schema=_schema(ddl))
