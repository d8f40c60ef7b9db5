"""Byte-level BPE without a regex engine in the text path.

Pre-tokens of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
are the words of a small automaton over code-point classes, once each symbol knows whether white
space or a contraction follows. A batch of texts is one array of symbols, cut into equal blocks;
each block's transition function (state -> state, an array) is built for all blocks at once, the
functions are composed by a doubling scan (composition is associative), and a last sweep with
the true states marks where tokens begin. The slices go through a bounded cache of merged ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

# Code points of the Unicode property White_Space.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Classes of code points.
C_LETTER, C_NUMBER, C_OTHER, C_BLANK, C_END = range(5)
# Symbols: a class, or what the look-ahead makes of it.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_BEFORE, BLANK_BEFORE, BLANK, END = range(9)
# States: inside a run of letters, numbers, others or blanks; after a space that begins a token; one or two letters left of a contraction; nothing open.
IN_L, IN_N, IN_O, IN_B, SPACE, ONE, NEW, TWO = range(8)

#: Cached pre-tokens of a worker; the cache starts anew beyond it.
CACHE = 400_000
#: Symbols of a block of the scan.
BLOCK = 256

_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        kind = {"L": C_LETTER, "N": C_NUMBER}
        t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], C_OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        t[WHITE_SPACE] = C_BLANK
        _CLASSES = np.append(t, np.uint8(C_END))
    return _CLASSES


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a token begins, by symbol * 8 + state."""
    go = np.zeros((9, 8), dtype=np.uint8)
    begins = np.ones((9, 8), dtype=bool)
    for state in range(8):
        for symbol, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O), (SHORT, IN_O), (LONG, IN_O)):
            go[symbol, state] = run
            begins[symbol, state] = state not in (run, SPACE)
        if state not in (IN_O, SPACE):
            go[SHORT, state], go[LONG, state] = ONE, TWO
        go[SPACE_BEFORE, state], go[BLANK_BEFORE, state], go[BLANK, state], go[END, state] = SPACE, NEW, IN_B, NEW
    go[LETTER, ONE], go[LETTER, TWO] = NEW, ONE
    begins[LETTER, [ONE, TWO]] = False
    begins[BLANK, IN_B] = False
    begins[END] = False
    return go.ravel(), begins.ravel()


_GO, _BEGINS = _automaton()


def _symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points; the value 0x110000 ends a text."""
    c = _classes()[points]
    after = np.append(c[1:], C_END).astype(np.uint8)
    s = np.array([LETTER, NUMBER, OTHER, BLANK, END], dtype=np.uint8)[c]
    before = (c == C_BLANK) & (after < C_BLANK)
    s[before] = np.where(points[before] == 0x20, SPACE_BEFORE, BLANK_BEFORE)
    q = np.flatnonzero(points == 0x27)
    if len(q):
        one = points[np.minimum(q + 1, len(points) - 1)]
        two = points[np.minimum(q + 2, len(points) - 1)]
        # The suffixes that an apostrophe joins, s t m d and re ve ll.
        s[q[np.isin(one, [115, 116, 109, 100])]] = SHORT
        s[q[(np.isin(one, [114, 118]) & (two == 101)) | ((one == 108) & (two == 108))]] = LONG
    return s


def boundaries(points: np.ndarray) -> np.ndarray:
    """Indexes at which a pre-token begins."""
    if not len(points):
        return np.empty(0, np.int64)
    s = _symbols(points)
    blocks = -(-len(s) // BLOCK)
    grid = np.full(blocks * BLOCK, END, dtype=np.uint8)
    grid[: len(s)] = s
    grid = (np.ascontiguousarray(grid.reshape(blocks, BLOCK).T) << 3).astype(np.uint8)
    f = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, axis=1)
    for row in grid:
        f = _GO[row + f]
    f = f.T  # f[b, state]: state after block b
    step = 1
    while step < blocks:
        f = np.concatenate((f[:step], np.take_along_axis(f[step:], f[:-step].astype(np.intp), axis=1)))
        step *= 2
    state = np.concatenate(([NEW], f[:-1, NEW])).astype(np.uint8)
    marks = np.empty(grid.shape, dtype=bool)
    for t, row in enumerate(grid):
        at = row + state
        marks[t] = _BEGINS[at]
        state = _GO[at]
    return np.flatnonzero(marks.T.ravel()[: len(s)])


def pre_tokens(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """For each text, its pre-tokens and their code-point offsets."""
    points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[ends[:-1]] = 0x110000
    marks = boundaries(points)
    cut = np.searchsorted(marks, np.append(0, ends))
    for i, t in enumerate(texts):
        begin = marks[cut[i] : cut[i + 1]] - (ends[i - 1] + 1 if i else 0)
        b = begin.tolist()
        yield [t[x:y] for x, y in zip(b, [*b[1:], len(t)], strict=True)] if b else [], begin


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Merges and their cache. A byte sequence merges at its lowest rank first, leftmost among equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 80:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return tuple(ranks[p] for p in parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap over a linked list: n log n."""
        n, ranks = len(piece), self.ranks
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if end[i] < 0 or j >= n or end[j] != stop:
                continue  # one of the two parts has changed meanwhile
            end[i], end[j] = stop, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def __call__(self, tokens: list[str]) -> list[int]:
        cache = self.cache
        try:
            return list(chain.from_iterable([cache[t] for t in tokens]))
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            for t in tokens:
                if t not in cache:
                    cache[t] = self.merge(t.encode())
            return list(chain.from_iterable([cache[t] for t in tokens]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[int, Encoder] = {}

_SCHEMAS = {
    False: pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
    True: pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))]),
}


def _encode(shared, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        encoder = _ENCODERS.get(id(ranks))
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[id(ranks)] = Encoder(ranks)
        for batch, raw in steps(batches, limit=1 << 20):
            rows = []
            texts = [x.decode() for x in raw]
            for tokens, _ in pre_tokens(texts):
                ids = encoder(tokens)
                if digest:
                    name = encoder.text_of
                    rows.append((len(ids), hashlib.sha256(",".join([name[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
                else:
                    size = [len(encoder.bytes_of[i]) for i in ids]
                    rows.append((ids, [0, *np.cumsum(size).tolist()][:-1]))
            schema = _SCHEMAS[not digest]
            columns = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, ids, offsets): token ids of each text and the byte at which each begins.

    rank_file is read on the driver and broadcast (a vocabulary, bounded). A null text counts as empty: no ids.
    Special tokens are ordinary text. Every row gives a row, repeated and null ids too; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_file))
    return _input(docs).mapInArrow(_encode(shared, False), "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids): the inverse of encode(). Null ids give null bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {i: b for b, i in shared.value.items()}
        for batch in batches:
            out = [None if ids is None else b"".join(map(names.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of the bytes decoded from them.

    One pass without a shuffle; rows as in encode(). An empty or null text has 0 tokens and two digests of no bytes.
    A text over a step's size is encoded whole, by itself; offsets are encode()'s, digests need none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_file))
    return _input(docs).mapInArrow(_encode(shared, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
