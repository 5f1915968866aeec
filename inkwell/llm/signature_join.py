"""Exact Jaccard self-join of word shingles with signature trees.

1. *Candidates.*  Sets with a Jaccard similarity of ``num/den`` or more share at
   least ``need(size)`` shingles, so a document with fewer that occur elsewhere
   (counted over the corpus) links with nothing.  Of the others' shared ones the
   ``need(size) - 1`` most frequent can go: a linked pair still shares its
   rarest, and passages that many documents have join no unlike ones.  Blocks
   are components of the graph of what is left.  Identical sets are one member.
2. *Signature trees.*  A block, or for a large block each tile of members of
   about one size, becomes a tree: a leaf holds a member's token bitmap, size
   and collisions, a node the OR of its children's bitmaps and the ranges of
   their sizes.  A dual traversal drops node pairs whose greatest possible
   overlap is too small; the pairs of leaves that are left are compared exactly,
   unless their members are already connected.
3. *Large blocks.*  Each tile also holds the pivot of its block and size class,
   so near copies connect through it in linear work.  Then only members outside
   the block's main component meet others, of neighbouring size classes: those
   that hold one of their kept shingles, which a linked pair always shares.
   Holders of a shingle with more than ``RARE`` of them meet in tiles of that
   shingle; the others' partners are gathered for groups of members first, so
   that a chain of texts takes linear work as well.
4. *Centres.*  Near copies of one text all hold its shingles, so in each large
   block sets are also seen as differences from a centre, what most members of
   one tile have (any set would do).  ``slack`` is the difference that a set's
   size allows it less the one it has.  If two sets' slacks add up to 0 or more,
   they link by the triangle inequality, and both with the member of greatest
   slack: those links need no comparison.  Any other linked pair differs from
   the centre in at least ``-(slack + slack) / 2`` of the same shingles, so it
   shares one of the rarest differences, and few members have those.  A member
   asks by its kept shingles or by its differences, whichever fewer others hold.

A tile has at most ``tile`` members and about ``TILE_SHINGLES`` shingles, so it
fits in memory whatever the length of the texts.  Sets are told apart by SHA-256
of their shingles; a node's name is the first half of it, and sets whose names
clash get others.  No link is lost: components are those of all pairs at the
threshold, up to clashes of 64-bit hashes of words and shingles.

Defined results: a text without words has an empty set and links with nothing; with
fewer words than ``words_each`` the whole sequence is one shingle.  Rows with a
null id link with nothing; rows that repeat an id are one member for each text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm._exchange import REQUEST, chunk_ids, counted, levels, read_answer, request
from inkwell.llm._graph import components
from inkwell.llm._spill import NO_ID, bucketed, discard, null_ids, with_ids, written
from inkwell.llm._text import flat, lower, mix, pack, pack_sorted, ragged, slabs, unpack, unpack_sorted, word_hashes, words

NUM, DEN, WORDS = 80, 100, 5
TILE, FAN = 256, 8
TILE_SHINGLES, RARE, GATHERED = 1 << 20, 32, 64
CHUNK_BYTES = 4 << 20
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def need(size, num: int = NUM, den: int = DEN):
    """How many of its shingles a set shares with any set that it links with, at least."""
    return -(-size * num // den)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words_each: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets): each row's distinct ones, ascending."""
    data = lower(data)
    start, end, before = words(data, offs)
    hashes = word_hashes(data, start, end)
    count = np.diff(before)
    spans = np.where(count == 0, 0, np.maximum(count - words_each + 1, 1))
    at, sums = ragged(before[:-1], spans)
    short = np.repeat(np.minimum(count, words_each), spans)
    value = np.zeros(len(at), np.uint64)
    for k in range(words_each):
        inside = k < short
        value[inside] = value[inside] * STEP + mix(hashes[at[inside] + k] + np.uint64(k))
    value = mix(value + short.astype(np.uint64))
    row = np.repeat(np.arange(len(spans)), spans)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    sizes = np.bincount(row[first], minlength=len(spans))
    return value[first], np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


class Tree:
    """A signature tree; level 0 holds the members, each higher level the OR of FAN nodes below."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort((sizes, np.array([s[0] if len(s) else 0 for s in sets], np.uint64)))
        self.sets = [sets[i] for i in self.order]
        sizes = sizes[self.order]
        bits = int(min(1 << 16, max(1024, 1 << int(4 * max(1, sizes.max())).bit_length())))
        self.bits = bits
        low = high = sizes
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            spot = (s >> np.uint64(40)) & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
        spare = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, low, high, spare)]
        while len(maps) > 1:
            cut = np.arange(0, len(maps), FAN)
            maps = np.bitwise_or.reduceat(maps, cut)
            low, high, spare = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(spare, cut)
            self.levels.append((maps, low, high, spare))

    def fold(self, bits: int) -> None:
        """Shrinks the bitmaps to ``bits``, so that two trees can be compared."""
        if bits < self.bits:
            maps = [m[0].reshape(len(m[0]), -1, bits // 64) for m in self.levels]
            maps = [np.bitwise_or.reduce(m, 1) for m in maps]
            self.levels = [(m, *old[1:]) for m, old in zip(maps, self.levels, strict=True)]
            low = self.levels[0]
            spare = low[1] - np.bitwise_count(low[0]).sum(1).astype(np.int64)
            self.levels[0] = (low[0], low[1], low[2], spare)
            for k in range(1, len(self.levels)):
                spare = np.maximum.reduceat(spare, np.arange(0, len(spare), FAN))
                self.levels[k] = (*self.levels[k][:3], spare)
            self.bits = bits


def _children(nodes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.minimum(count - nodes * FAN, FAN)
    at, _ = ragged(nodes * FAN, sizes)
    return at, sizes


def dual(left: Tree, right: Tree, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members (of a tree with itself: i < j) that the bitmaps and sizes do not rule out."""
    own = left is right
    if not own:
        bits = min(left.bits, right.bits)
        left.fold(bits), right.fold(bits)
    la, lb = len(left.levels) - 1, len(right.levels) - 1
    a = b = np.zeros(1, np.int64)
    while True:
        ma, lo_a, hi_a, sa = left.levels[la]
        mb, lo_b, hi_b, sb = right.levels[lb]
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 14):
            x, y = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
            most = np.bitwise_count(ma[x] & mb[y]).sum(1).astype(np.int64) + np.minimum(sa[x], sb[y])
            most = np.minimum(most, np.minimum(hi_a[x], hi_b[y]))
            keep[i : i + (1 << 14)] = ((num + den) * most >= num * (lo_a[x] + lo_b[y])) & (den * hi_a[x] >= num * lo_b[y]) & (den * hi_b[y] >= num * lo_a[x])
        if la == lb and own and la == 0:
            keep &= a < b
        a, b = a[keep], b[keep]
        if la == 0 and lb == 0:
            return a, b
        if la >= lb:
            at, sizes = _children(a, len(left.levels[la - 1][0]))
            a, b, la = at, np.repeat(b, sizes), la - 1
            if own:  # both sides go down together
                at, sizes = _children(b, len(right.levels[lb - 1][0]))
                a, b, lb = np.repeat(a, sizes), at, lb - 1
                ordered = a <= b
                a, b = a[ordered], b[ordered]
        else:
            at, sizes = _children(b, len(right.levels[lb - 1][0]))
            a, b, lb = np.repeat(a, sizes), at, lb - 1


def linked(x: np.ndarray, y: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    """The exact test of two ascending sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
    return common > 0 and den * common >= num * (len(x) + len(y) - common)


class Forest:
    """Union-find over numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def _inside(table: pa.Table) -> pa.Table:
    """Links found among the members of a tile."""
    ids = np.asarray(table.column("node"))
    ids, keep = np.unique(ids, return_index=True)  # a pivot may be in its own tile
    sets = _sets(table.column("set").take(pa.array(keep)))
    tree, forest, edges = Tree(sets), Forest(), []
    ids = ids[tree.order].tolist()
    for i, j in zip(*(x.tolist() for x in dual(tree, tree)), strict=True):
        if forest.find(ids[i]) != forest.find(ids[j]) and linked(tree.sets[i], tree.sets[j]):
            forest.join(ids[i], ids[j])
            edges.append((ids[i], ids[j]))
    return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})


def _between(table: pa.Table) -> pa.Table:
    """Links between members outside the main component and a tile; members know their components."""
    roots = dict(zip(table.column("node").to_pylist(), table.column("root").to_pylist(), strict=True))
    sides = []
    for side in (0, 1):
        part = table.filter(pa.array(np.asarray(table.column("side")) == side))
        if not part.num_rows:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        tree = Tree(_sets(part.column("set")))
        sides.append((tree, np.asarray(part.column("node"))[tree.order].tolist()))
    forest, edges = Forest(), []
    (left, ids), (right, others) = sides
    for i, j in zip(*(x.tolist() for x in dual(left, right)), strict=True):
        x, y = ids[i], others[j]
        if x != y and forest.find(roots[x]) != forest.find(roots[y]) and linked(left.sets[i], right.sets[j]):
            forest.join(roots[x], roots[y])
            edges.append((x, y))
    return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})


CHUNK = "chunk long, doc_ids binary, offsets binary, text binary, n_keys long"
MEMBER = "doc_id long, n_shingles long, high long, low long, set binary, shared binary"
EDGE = "u long, v long"


def _keyed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sets, their offsets, distinct shingles of all sets, which of them each one is)."""
    sets, bound = shingle_sets(data, offs)
    keys, inverse = np.unique(sets, return_inverse=True)
    return sets, bound, keys, inverse


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from inkwell.llm.suffix_dedup import squeeze

    ids = chunk_ids()
    for slab in slabs(batches, limit=CHUNK_BYTES):
        data, offs = flat(slab.column(1))
        keys = int(np.count_nonzero(np.diff(offs)) + len(data) // 7)  # about; only sizes the parts
        yield pa.RecordBatch.from_pylist([{"chunk": next(ids), "doc_ids": pack(np.asarray(slab.column(0))), "offsets": pack(offs), "text": squeeze(data), "n_keys": keys}])


def _open(row: dict) -> tuple[np.ndarray, np.ndarray]:
    from inkwell.llm.suffix_dedup import stretch

    return stretch(row["text"]), unpack(row["offsets"], np.int64)


def _members(name_bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A row for each document of a chunk; the set, its SHA-256 and the kept shared shingles only for candidates."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        sets, bound, keys, inverse = _keyed(*_open(row))
        count = read_answer(right, 1)[0]
        shared = (count > 1)[inverse] if len(keys) else np.zeros(0, bool)
        n = np.concatenate(([0], np.cumsum(shared)))[bound]
        size = np.diff(bound)
        out = {"doc_id": unpack(row["doc_ids"], np.int64), "n_shingles": size}
        candidate = (np.diff(n) >= need(size)) & (size > 0) & (out["doc_id"] != NO_ID)
        owner = np.repeat(np.arange(len(size)), size)
        often = count.astype(np.int64)[inverse] if len(keys) else np.zeros(0, np.int64)
        order = np.lexsort((sets, often, ~shared, owner))  # of each document: shared first, rarest first
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(bound[:-1], size)
        shared &= rank < np.repeat(np.diff(n) - need(size) + 1, size)
        spans = [(a, b) if c else None for a, b, c in zip(bound[:-1].tolist(), bound[1:].tolist(), candidate.tolist(), strict=True)]
        blobs = [sets[x[0] : x[1]].tobytes() if x else None for x in spans]
        names = np.frombuffer(b"".join(hashlib.sha256(x).digest()[:16] if x else bytes(16) for x in blobs), np.int64)
        out["high"], out["low"] = names[::2] & np.int64((1 << name_bits) - 1 if name_bits < 64 else -1), names[1::2]
        out["set"] = pa.array(blobs, pa.binary())
        out["shared"] = pa.array([sets[x[0] : x[1]][shared[x[0] : x[1]]].tobytes() if x else None for x in spans], pa.binary())
        return pa.table(out)

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column(1).to_pylist()
        keys = np.frombuffer(b"".join(blobs), np.int64)
        ids = np.repeat(np.asarray(batch.column(0)), [len(b) // 8 for b in blobs])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys)], names=["node", "key"])


def _centre(table: pa.Table) -> pa.Table:
    """The shingles that over half of a tile's members hold."""
    sets = _sets(table.column("set"))
    keys, count = np.unique(np.concatenate(sets), return_counts=True)
    return pa.table({"block": table.column("block").slice(0, 1), "centre": pa.array([keys[2 * count > len(sets)].tobytes()], pa.binary())})


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In what each set differs from its block's centre, as keys that no other block has."""
    for batch in batches:
        block = mix(np.asarray(batch.column("block")).view(np.uint64))
        pairs = zip(_sets(batch.column("set")), _sets(batch.column("centre")), block, strict=True)
        found = [mix(np.setxor1d(x, y, assume_unique=True) ^ b) for x, y, b in pairs]
        out = [*(batch.column(c) for c in ("node", "block", "n_shingles")), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, names=["node", "block", "n_shingles", "d", "apart"])


def _centred(in_large: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, block, n_shingles, d, apart, slack) of the members of large blocks: differences from the block's centre."""
    tile = ["block", "kind", "tile"]
    most = in_large.groupBy(*tile).agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(F.max(F.struct("n", "kind", "tile")).alias("m")).select("block", "m.kind", "m.tile")
    centres = written(in_large.join(most, tile).join(sets, "node").select("block", "set").groupBy("block").applyInArrow(_centre, "block long, centre binary"), "centres")
    rows = in_large.select("node", "block", "n_shingles").join(sets, "node").join(centres, "block").select("node", "block", "n_shingles", "set", "centre")
    apart = written(rows.mapInArrow(_apart, "node long, block long, n_shingles long, d long, apart binary"), "apart")
    return apart.withColumn("slack", (DEN - NUM) * F.col("n_shingles") - (DEN + NUM) * F.col("d"))


def _star(apart: DataFrame) -> DataFrame:
    """Links with the member of greatest slack in each block, by the triangle inequality."""
    best = apart.groupBy("block").agg(F.max(F.struct("slack", "node")).alias("m"))
    return apart.join(best, "block").where(F.col("slack") + F.col("m.slack") >= 0).select(F.col("node").alias("u"), F.col("m.node").alias("v"))


def _tiled(rows: DataFrame, tile: int, *by: str) -> DataFrame:
    """``rows`` (with n_shingles) with ``tile``, a number that splits what is alike in ``by`` into tiles of bounded size."""
    sums = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_s")), "sums")  # so that no hot value's rows move for it
    parts = F.greatest(F.ceil(F.col("_n") / tile), F.ceil(F.col("_s") / TILE_SHINGLES))
    return rows.join(sums, list(by)).withColumn("tile", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("_n", "_s")


def _distinct_sets(members: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(node, n_shingles, high, low, rep, copies) of the distinct sets, and their table (node, n_shingles, set, shared), bucketed by node."""
    key = ["n_shingles", "high", "low"]
    members = members.where("set is not null")
    same = written(members.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    if same.groupBy("high").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        named = same.withColumn("node", F.col("high"))
        sets = members.withColumnRenamed("high", "node").dropDuplicates(["node"])
    else:
        rank = F.row_number().over(Window.partitionBy("high").orderBy("low", "n_shingles"))
        named = written(same.withColumn("node", F.when(rank == 1, F.col("high")).otherwise(F.xxhash64("high", "low", "n_shingles"))), "named")
        if not named.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise RuntimeError("two sets have one name")
        sets = members.dropDuplicates(key).join(named.select(*key, "node"), key)
    # dealt as the table is, so that a bucket is a file; later joins don't move the sets
    return named, bucketed(sets.select("node", "n_shingles", "set", "shared"), "reps", "node", width)


def link(docs: DataFrame, tile: int = TILE, name_bits: int = 64, rare: int = RARE) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_copies_of_set (documents with the same set)."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = with_ids(docs)
    chunks = written(source.mapInArrow(_chunks, CHUNK), "shingles")
    at = levels(chunks.agg(F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n")).first().n)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from inkwell.llm.suffix_dedup import _rows

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                *_, keys, inverse = _keyed(*_open(row))
                yield from _rows(request(row["chunk"], keys, [np.bincount(inverse, minlength=len(keys))], at.parts), REQUEST)

    answers = counted(chunks.select("chunk", "offsets", "text").mapInArrow(ask, REQUEST), at).select("chunk", "part", "counts")
    members = written(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_members(name_bits), MEMBER), "members")
    discard(chunks)

    same, reps = _distinct_sets(members, width)
    keys = written(reps.select("node", "shared").mapInArrow(_spread, "node long, key long"), "keys")
    least = keys.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "v")
    blocks = components(keys.join(least, "key").select(F.col("node").alias("u"), "v"))
    blocks = blocks.unionByName(blocks.select(F.col("root").alias("u"), "root").distinct())
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int")
    placed = written(reps.select("node", "n_shingles", size_class.alias("kind")).join(blocks.select(F.col("u").alias("node"), F.col("root").alias("block")), "node"), "placed")
    counts = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    large = written(counts.where((F.col("n") > tile) | (F.col("s") > TILE_SHINGLES)).select("block"), "large")
    sets = reps.select("node", "set")
    in_small = placed.join(large, "block", "left_anti").select("node", "block", F.lit(-1).alias("kind"), F.lit(0).alias("tile"))
    in_large = written(_tiled(placed.join(large, "block", "left_semi"), tile, "block", "kind"), "tiles")
    pivots = in_large.groupBy("block", "kind").agg(F.min("node").alias("node"))
    pivots = in_large.select("block", "kind", "tile").distinct().join(pivots, ["block", "kind"]).select("node", "block", "kind", "tile")
    every = in_small.unionByName(in_large.select("node", "block", "kind", "tile")).unionByName(pivots)
    edges = written(every.join(sets, "node").groupBy("block", "kind", "tile").applyInArrow(_inside, EDGE), "links")
    if several := not in_large.isEmpty():
        apart = _centred(in_large, sets)
        edges = edges.unionByName(_star(apart))
    found = components(edges)
    if several:
        known = in_large.join(found.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        known = written(known.select("node", "n_shingles", "block", "kind", "root"), "rooted")
        sums = known.groupBy("block", "root").agg(F.count(F.lit(1)).alias("n"))
        main = sums.groupBy("block").agg(F.max(F.struct("n", "root")).alias("m")).select("block", F.col("m.root").alias("main"))
        outside = written(known.join(main, "block").where("root <> main").drop("block", "main"), "outside")
        if n := outside.count():
            more = written(_others(outside, n, known.drop("block"), keys, apart, sets, tile, rare), "links")
            if not more.isEmpty():
                found = components(edges.unionByName(more))
    nodes = same.join(found.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    top = nodes.join(least, "root").select("n_shingles", "high", "low", "copies", "component_id")
    alone = members.where("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies_of_set"))
    grouped = members.where("set is not null").select("doc_id", "n_shingles", "high", "low").join(top, ["n_shingles", "high", "low"]).select("doc_id", "n_shingles", "component_id", F.col("copies").alias("n_copies_of_set"))
    return null_ids(alone.unionByName(grouped), "component_id")


def _differences(outside: DataFrame, apart: DataFrame) -> DataFrame:
    """(node, key, asks, holds): the rarest differences from the centre; a member ``outside`` that asks by its own meets in one any member that it links with, unless both link with the one of greatest slack.

    Only of blocks whose members differ less from the centre than from nothing.
    """
    out = outside.select("node").withColumn("out", F.lit(True))
    marked = apart.join(out, "node", "left")
    limits = marked.groupBy("block").agg(F.sum("d").alias("_d"), F.sum("n_shingles").alias("_s"), F.max("slack").alias("top"), F.max(F.when(F.col("out"), F.col("slack"))).alias("top_out"))
    marked = written(marked.join(limits.where("_d < _s and top_out is not null").drop("_d", "_s"), "block").select("node", "apart", "slack", "top", "top_out", "out"), "marked")
    far = written(marked.select("node", "apart").mapInArrow(_spread, "node long, key long"), "far")
    often = far.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    each = Window.partitionBy("node")
    ranked = far.join(often, "key").select("node", "key", F.row_number().over(each.orderBy("n", "key")).alias("rank"), F.count(F.lit(1)).over(each).alias("n"))
    least = lambda top: F.greatest(F.lit(1), F.ceil(-(F.col("slack") + F.col(top)) / (2 * (DEN + NUM))))  # noqa: E731  differences that a linked pair has in common
    within = lambda top: F.col("rank") <= F.col("n") - least(top) + 1
    ranked = ranked.join(marked.drop("apart"), "node").select("node", "key", (F.col("out").isNotNull() & within("top")).alias("asks"), within("top_out").alias("holds"))
    return marked.where("out").select("node", F.lit(None).cast("long").alias("key"), F.lit(True).alias("asks"), F.lit(False).alias("holds")).unionByName(ranked.where("asks or holds"))


def _others(outside: DataFrame, n: int, known: DataFrame, keys: DataFrame, apart: DataFrame, sets: DataFrame, tile: int, rare: int) -> DataFrame:
    """Links between the ``n`` members ``outside`` and any ``known`` ones (both: node, n_shingles, kind, root) that share a kept shingle or a rare difference."""
    apart = written(_differences(outside, apart), "differences")
    holders = written(keys.join(known.select("node"), "node", "left_semi").unionByName(apart.where("holds").select("node", "key")), "holders")
    asks = keys.join(outside.select("node"), "node", "left_semi").withColumn("far", F.lit(False)).unionByName(apart.where("asks").select("node", "key", F.lit(True).alias("far")))
    cost = asks.join(holders.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "left").groupBy("node", "far").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    way = written(cost.groupBy("node").agg(F.min(F.struct("n", "far"))["far"].alias("far")), "ways")
    asked = written(asks.where("key is not null").join(way, ["node", "far"]).join(known, "node").drop("far"), "asked")
    held = written(holders.join(asked.select("key").distinct(), "key", "left_semi").join(known, "node"), "held")
    often = written(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rare).select("key"), "often")
    group = F.pmod(F.xxhash64("node"), F.lit(-(-n // GATHERED)))
    columns = ["hot", "by", "node", "n_shingles", "kind", "root"]
    some = asked.join(often, "key", "left_anti").select("key", group.alias("by"), F.col("kind").alias("_k"), F.col("root").alias("_r"))
    near = (F.abs(F.col("kind") - F.col("_k")) <= 1) & (F.col("root") != F.col("_r"))
    gathered = held.join(some, "key").where(near).select(F.lit(False).alias("hot"), *columns[1:]).distinct()
    one = outside.select(F.lit(False).alias("hot"), group.alias("by"), "node", "n_shingles", "kind", "root")
    hot = lambda rows: rows.join(often, "key", "left_semi").select(F.lit(True).alias("hot"), F.col("key").alias("by"), "node", "n_shingles", "kind", "root")
    one = written(_tiled(one.unionByName(hot(asked)), tile, "hot", "by", "kind"), "one").withColumnsRenamed({"kind": "kind_a", "tile": "tile_a"})
    two = written(_tiled(gathered.unionByName(hot(held)), tile, "hot", "by", "kind"), "two")
    pairs = one.select("hot", "by", "kind_a", "tile_a").distinct().join(two.select("hot", "by", "kind", "tile").distinct(), ["hot", "by"]).where(F.abs(F.col("kind_a") - F.col("kind")) <= 1)
    pairs = written(pairs, "pairs")
    key = ["hot", "by", "kind_a", "tile_a", "kind", "tile"]
    left = one.join(pairs, key[:4]).select("node", "root", *key, F.lit(0).alias("side"))
    right = two.join(pairs, ["hot", "by", "kind", "tile"]).select("node", "root", *key, F.lit(1).alias("side"))
    return left.unionByName(right).join(sets, "node").groupBy(*key).applyInArrow(_between, EDGE)
