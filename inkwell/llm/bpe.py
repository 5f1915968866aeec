"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each word is an array of symbols; leaf ``i`` of its segment tree holds
``(rank of the pair that starts at symbol i, i)`` and inner nodes hold the
minimum, so the root is the leftmost lowest-rank merge.  A merge changes three
leaves (the pair before, the merged one, the absorbed one), each a path to the
root.  All words of a size class are merged in step, one numpy operation for
all roots, so a merge costs ``O(log n)`` vector operations.

Words of a batch are first made distinct by a 64-bit hash of their characters
(with a bounded per-task memo), so frequent words are encoded once; a word takes
the ids of a remembered one only where all characters are equal.

The vocabulary file is the ``tokenizers`` JSON format with a BPE model,
``end_of_word_suffix`` and byte-level symbols; its path is a parameter.  What
depends on the Unicode version comes from the library: the file's normaliser
runs as it stands, but for texts of characters whose normal form is their lower
case in every version (``STABLE``), and the file's own split says of each code
point whether it is a letter, a number, white space or another character.
Splitting, merging and decoding are done here.

Defined results: null or empty text gives no ids and an empty decoding; very
long words are one tree; added tokens in the text become their ids; rows that
repeat an id, and rows with a null one, are rows of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkwell.llm._text import flat, ragged, slabs, span_hashes

NONE = np.int64(1) << np.int64(60)
POS = np.int64((1 << 32) - 1)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Fixed values of the split pattern: the endings that an apostrophe begins.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Ranges of characters that no normal form changes or joins, with lower cases that are settled.
STABLE = regex.compile("[\x00-\u02ff\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\U0001f300-\U0001faff]*")
MEMO = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of one vocabulary file; ``runs`` are its :func:`class_runs`."""

    def __init__(self, path: str, runs: tuple[bytes, bytes]):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        self.plain = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"}
        own = Tokenizer.from_file(path).normalizer
        self.own = own.normalize_str if own else str
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order, -1)
        self.merged = np.append(np.array([vocab[a + b] for a, b in pairs], np.int64)[order], -1)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_rank = np.array([vocab[a + b] for a, b in pairs], np.int64)
        names = {**vocab, **self.added}
        self.tokens = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.tokens[i] = token.encode()
        joined = [t + b" " for t in self.tokens]
        self.token_lengths = np.array([len(t) for t in joined], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(joined), np.uint8)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        starts, kinds = np.frombuffer(runs[0], np.uint32), np.frombuffer(runs[1], np.uint8)
        self.classes = np.repeat(kinds, np.diff(starts, append=np.uint32(0x110000)))

    def normalize(self, text: str) -> str:
        """The file's normal form, but for white space, which only separates words."""
        if self.plain and STABLE.fullmatch(text):
            return text.lower()
        return self.own(text)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where there is no such merge."""
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


@lru_cache(4)
def class_runs(path: str) -> tuple[bytes, bytes]:
    """(first code points, classes) of runs of code points of one class, as the file's own split tells them.

    Each code point stands twice between a letter and a digit: a letter joins
    the one before it, a number is a piece of its own, other characters join
    each other, and white space is in no piece.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    kinds = np.zeros(0x110000, np.uint8)
    for part in np.array_split(points, 64):
        spans = np.array([span for _, span in cut.pre_tokenize_str("".join(f"a{c}{c}1" for c in map(chr, part.tolist())))], np.int64)
        begins = np.zeros(4 * len(part) + 1, bool)
        begins[spans[:, 0]] = True
        inside = np.zeros(4 * len(part) + 1, np.int64)
        np.add.at(inside, spans[:, 0], 1)
        np.add.at(inside, spans[:, 1], -1)
        first, second, held = begins[1:-1:4], begins[2:-1:4], np.cumsum(inside)[1:-1:4] > 0
        kinds[part] = np.select([~held, ~first, second], [SPACE, LETTER, NUMBER], OTHER)
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    return starts.astype(np.uint32).tobytes(), kinds[starts].tobytes()


@lru_cache(4)
def vocabulary(path: str, runs: tuple[bytes, bytes] | None = None) -> Vocabulary:
    return Vocabulary(path, runs or class_runs(path))


def merge_words(vocab: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids after all merges of words given as rows of byte ids, padded; (ids, kept) of the same shape."""
    count, width = symbols.shape
    leaves = 1 << max(1, (width - 1).bit_length())
    sym = np.zeros((count, leaves), np.int64)
    sym[:, :width] = symbols
    place = np.arange(leaves)
    alive = place[None, :] < lengths[:, None]
    after = np.broadcast_to(place + 1, (count, leaves)).copy()
    before = np.broadcast_to(place - 1, (count, leaves)).copy()
    tree = np.full((count, 2 * leaves), NONE)
    first, second = sym[:, :-1], sym[:, 1:]
    has = alive[:, 1:]
    ranks = np.full(has.shape, -1, np.int64)
    ranks[has] = vocab.pair_ranks(first[has], second[has])
    tree[:, leaves : 2 * leaves - 1] = np.where(ranks >= 0, ranks << 32 | place[:-1], NONE)
    level = leaves
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def update(rows: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
        node = at + leaves
        tree[rows, node] = key
        while leaves > 1 and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        top = tree[rows, 1]
        at = top & POS
        right = after[rows, at]
        new = vocab.by_rank[top >> 32]
        beyond = after[rows, right]
        sym[rows, at] = new
        alive[rows, right] = False
        after[rows, at] = beyond
        inside = beyond < lengths[rows]
        before[rows[inside], beyond[inside]] = at[inside]
        update(rows, right, np.full(len(rows), NONE))
        rank = np.full(len(rows), -1, np.int64)
        rank[inside] = vocab.pair_ranks(new[inside], sym[rows[inside], beyond[inside]])
        update(rows, at, np.where(rank >= 0, rank << 32 | at, NONE))
        left = before[rows, at]
        some = np.flatnonzero(left >= 0)
        if len(some):
            r, p = rows[some], left[some]
            rank = vocab.pair_ranks(sym[r, p], new[some])
            update(r, p, np.where(rank >= 0, rank << 32 | p, NONE))
        rows = rows[tree[rows, 1] < NONE]
    return sym[:, :width], alive[:, :width]


def encode_words(vocab: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of words given as UTF-8; every word is non-empty."""
    lengths = np.diff(offs)
    counts = np.zeros(len(lengths), np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    classes = np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 1)))).astype(np.int64)
    for size in np.unique(classes):
        every = np.flatnonzero(classes == size)
        step = max(1, (1 << 19) >> int(size))
        for i in range(0, len(every), step):
            which = every[i : i + step]
            n = lengths[which]
            width = int(n.max())
            grid = np.minimum(offs[which][:, None] + np.arange(width), len(data) - 1)
            raw = data[grid]
            symbols = vocab.inner[raw]
            symbols[np.arange(len(which)), n - 1] = vocab.last[raw[np.arange(len(which)), n - 1]]
            ids, kept = merge_words(vocab, symbols, n)
            counts[which] = kept.sum(1)
            done.append((which, ids[kept], counts[which]))
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    ids = np.zeros(out[-1], np.int64)
    for which, found, n in done:
        at, _ = ragged(out[which], n)
        ids[at] = found
    return ids, out


def split(vocab: Vocabulary, points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of normalised text, as code points; ``edges`` are positions no word crosses."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = vocab.classes[points]
    begin = np.ones(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    begin[edges[(edges > 0) & (edges < n)]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    mark = np.flatnonzero((points[starts[:-1]] == 39) & (ends[:-1] - starts[:-1] == 1) & (kind[starts[1:]] == LETTER))
    mark = mark[~np.isin(starts[mark + 1], edges)]
    if len(mark):
        room = ends[mark + 1] - starts[mark + 1]
        one = points[starts[mark + 1]]
        two = points[np.minimum(starts[mark + 1] + 1, n - 1)]
        take = np.zeros(len(mark), np.int64)
        for ending in ENDINGS:
            fits = (one == ord(ending[0])) & (room >= len(ending))
            if len(ending) == 2:
                fits &= two == ord(ending[1])
            take = np.where((take == 0) & fits, len(ending), take)
        hit = take > 0
        ends[mark[hit]] += take[hit]
        starts[mark[hit] + 1] += take[hit]
    keep = (kind[starts[: len(starts)].clip(max=n - 1)] != SPACE) & (ends > starts)
    return starts[keep], ends[keep]


class Encoder:
    """Encodes slabs of texts; remembers up to MEMO distinct words, found by hash and compared by characters."""

    def __init__(self, path: str, runs: tuple[bytes, bytes] | None = None):
        self.vocab = vocabulary(path, runs)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chars = np.zeros(0, np.uint32)

    def _encode(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where the ids of each word begin in ``self.ids``, how many they are, the words' characters)."""
        index, bounds = ragged(starts, ends - starts)
        data, sizes = utf8(points[index])
        ids, offs = encode_words(self.vocab, data, np.concatenate(([0], np.cumsum(sizes)))[bounds])
        first = offs[:-1] + len(self.ids)
        self.ids = np.concatenate((self.ids, ids))
        return first, np.diff(offs), points[index]

    def _words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``self.ids`` the ids of each word begin, and how many they are."""
        hashes = span_hashes(points.view(np.uint8), 4 * starts, 4 * ends)
        unique, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if max(len(self.known), len(self.ids) // 4, len(self.chars) // 16) > MEMO:
            self._forget()
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        near = at < len(self.known)
        new[near] = self.known[at[near]] != unique[near]
        if new.any():
            s, e = starts[sample[new]], ends[sample[new]]
            begin = len(self.chars) + np.cumsum(e - s) - (e - s)
            first, count, chars = self._encode(points, s, e)
            order = np.argsort(np.concatenate((self.known, unique[new])), kind="stable")
            for name, more in (("known", unique[new]), ("first", first), ("count", count), ("begin", begin), ("size", e - s)):
                setattr(self, name, np.concatenate((getattr(self, name), more))[order])
            self.chars = np.concatenate((self.chars, chars))
            at = np.searchsorted(self.known, unique)
        mine, lengths = at[inverse], ends - starts
        same = self.size[mine] == lengths
        here, bounds = ragged(starts[same], lengths[same])
        there, _ = ragged(self.begin[mine[same]], lengths[same])
        if len(here):
            same[same] = np.logical_and.reduceat(points[here] == self.chars[there], bounds[:-1])
        first, count = self.first[mine], self.count[mine]
        if not same.all():  # words that share a hash with another one
            first[~same], count[~same], _ = self._encode(points, starts[~same], ends[~same])
        return first, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        pieces, rows, special = [], [], []
        norm = self.vocab.normalize
        for i, text in enumerate(texts):
            done = 0
            for m in self.vocab.cut.finditer(text):
                if m.start() > done:
                    pieces.append(norm(text[done : m.start()]))
                    rows.append(i)
                    special.append(-1)
                pieces.append("")
                rows.append(i)
                special.append(self.vocab.added[m[0]])
                done = m.end()
            if done < len(text):
                pieces.append(norm(text[done:]))
                rows.append(i)
                special.append(-1)
        sizes = np.array([len(p) for p in pieces], np.int64)
        edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        starts, ends = split(self.vocab, points, edges)
        if len(starts):
            first, count = self._words(points, starts, ends)
        else:
            first = count = np.zeros(0, np.int64)
        row_of = np.array(rows, np.int64)[np.searchsorted(edges, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
        at, _ = ragged(first, count)
        ids = self.ids[at]
        lengths = np.bincount(row_of, weights=count, minlength=len(texts)).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        offs = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        special = np.array(special, np.int64)
        marks = np.flatnonzero(special >= 0)
        if len(marks):  # ids before each added token, so that it is put in its place
            before = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(starts, edges[marks], "left")]
            ids = np.insert(ids, before, special[marks])
            lengths = lengths + np.bincount(np.array(rows)[marks], minlength=len(texts))
            offs = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        return ids, offs

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the decoded rows: the tokens with a space between any two."""
        v = self.vocab
        sizes = v.token_lengths[ids]
        at, sums = ragged(v.token_starts[ids], sizes)
        ends = sums[offs]
        return v.token_bytes[at], ends


def utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points and the number of bytes of each."""
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8), sizes


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, decoded: bool = True, id_lists: bool = True) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with ids and decoding.

    Adds ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256`` and, where
    asked for, ``token_ids`` (array of int) and ``decoded`` text.  ``keep``
    names the input columns that are returned; all by default, but those of the
    names above, which are replaced.  Map-only.
    """
    new = ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    kept = [docs.schema[c] for c in keep]
    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * id_lists + ", decoded string" * decoded
    from pyspark.sql.types import StructType

    schema = StructType([*kept, *StructType.fromDDL(extra).fields])
    need = list(dict.fromkeys([*keep, "text"]))
    runs = class_runs(path)  # a few thousand, of the library on the driver; tasks need not work them out again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, runs)
        for slab in slabs(batches, limit=3 << 20):
            column = slab.column(slab.schema.get_field_index("text"))
            ids, offs = encoder.encode([t or "" for t in column.to_pylist()])
            text, ends = encoder.decode(ids, offs)
            raw, texts = ids.astype("<u4").tobytes(), text.tobytes()
            spans = [(int(a), int(b)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            bounds = [(int(a), max(int(a), int(b) - 1)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            out = [slab.column(slab.schema.get_field_index(c)) for c in keep]
            out += [
                pa.array(np.diff(offs)),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans]),
                pa.array([hashlib.sha256(texts[a:b]).hexdigest() for a, b in bounds]),
            ]
            if id_lists:
                out.append(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32())))
            if decoded:
                out.append(pa.array([texts[a:b].decode() for a, b in bounds]))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(*need).mapInArrow(run, schema)
