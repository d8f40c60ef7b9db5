"""N-gram language model by deleted interpolation, and whole-text scores.

    p(w | v) = a(v) c(v w) / c(v) + b(v) c(w) / N + g(v) / (V + 1)

The weights a, b, g belong to buckets of the context's frequency c(v) and are learned by
expectation-maximisation on deleted counts: each held-out training text is scored with all counts
but its own.

Counting: documents form blocks of a few MB. A block keeps its texts as numbers of its own words
(written once to the shared folder) and sends its distinct words and word pairs, packed and sorted
by hash, to hash ranges. A range adds up the counts of all blocks and answers each block in the
block's own order, so that scoring needs no table of the whole model in any task. Per key about
five bytes move, and a frequent key moves once a block. A block sends to FAN_OUT ranges at most: where
more are needed, what a range gets is merged into chunks, which ask finer ranges as blocks do and
answer their blocks from what comes back, so the number of blobs follows the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, crc_mod, cut, drop_cut, mix64, pack, ranges_for, release, runs_of, steps, unpack, word_hashes

BLOCK_BYTES = 8 << 20
#: Ranges that a block or chunk sends to, and bytes of blobs that make a chunk.
FAN_OUT, CHUNK_BYTES = 512, 24 << 20
_START, _END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x7FEB352D846CA68B)
_BLOB = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("r", pa.int32()), ("payload", pa.binary()), ("counts", pa.binary())])
_BLOB_DDL = "block long, kind int, r int, payload binary, counts binary"
#: Bins of an octave, and of all, when probabilities are tallied for the mixture weights.
OCTAVE, BINS = 4, 160


@dataclass
class Mixture:
    """Weights (pairs, words, uniform) by bucket of the context's frequency."""

    weights: np.ndarray  # buckets x 3
    tokens: int
    types: int
    texts: int


def _pair_keys(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """56-bit hashes of each token with the one before it in its text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = _START
    return mix64(mix64(before * _BASE + tokens)) >> np.uint64(8)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each value's index among them."""
    order = np.argsort(values)
    s = values[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    at = np.empty(len(values), dtype=np.uint32)
    at[order] = np.cumsum(new) - 1
    return s[new], at


def _edges(keys: np.ndarray, bits: int, ranges: int, first: int = 0, last: int | None = None) -> list[int]:
    """Where each hash range from first to last - 1 (all) begins in sorted keys, and their end."""
    last = ranges if last is None else last
    return np.searchsorted(keys, np.array([min((r << bits) // ranges, (1 << 64) - 1) for r in range(first, last)], dtype=np.uint64)).tolist() + [len(keys)]


def _stage(ranges: int):
    """A row of texts for each block (kind -1) and its keys by range: kind 0 words, kind 1 pairs; kind 2 counts training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch, texts in steps(batches, 2, BLOCK_BYTES):
            words, off = word_hashes(texts)
            n = np.diff(off) + 1
            ends = np.cumsum(n) - 1
            starts = ends - n + 1
            tokens = np.empty(len(words) + len(texts), dtype=np.uint64)
            inside = np.ones(len(tokens), dtype=bool)
            inside[ends] = False
            tokens[ends] = _END
            tokens[inside] = words
            ids = batch.column(0)
            held = np.array(batch.column(1).to_pylist(), dtype=bool)
            types, at = _distinct(tokens)
            del words, inside
            block = TaskContext.get().partitionId() << 32 | made
            made += 1
            train = np.repeat(~held, n)
            payload = [pack(x) for x in (np.array([x or 0 for x in ids.to_pylist()], dtype=np.int64), np.array(ids.is_valid().to_pylist(), dtype=np.uint8), held.astype(np.uint8), n.astype(np.uint32), at, types)]
            rows = [(block, -1, 0, b"".join(len(p).to_bytes(4, "little") + p for p in payload), None), (block, 2, 0, int((~held).sum()).to_bytes(8, "little"), None)]
            pairs, pair_at = _distinct(_pair_keys(tokens, starts))
            for kind, keys, where, bits in ((0, types, at, 64), (1, pairs, pair_at, 56)):
                c = np.bincount(where[train], minlength=len(keys)).astype(np.uint32)
                e = _edges(keys, bits, ranges)
                rows += [(block, kind, r, pack(keys[a:b]), pack(c[a:b])) for r, (a, b) in enumerate(zip(e[:-1], e[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOB, strict=True)], schema=_BLOB)

    return run


def _chunks(many: int, into: int):
    """Merges each range's blobs into chunks. Part "kept" has where each block's keys are in its chunk, part "keys" the chunk's
    keys by `into` finer ranges."""
    schema = pa.schema([("part", pa.string()), *_BLOB])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = made = 0

        def chunk() -> pa.RecordBatch:
            nonlocal held, size, made
            name, made = TaskContext.get().partitionId() << 32 | made, made + 1
            keys = [unpack(x[3]) for x in held]
            distinct, at = _distinct(np.concatenate(keys))
            total = np.bincount(at, weights=np.concatenate([unpack(x[4]) for x in held])).astype(np.uint64)
            kind, r = held[0][1:3]
            ends = np.cumsum([0, *map(len, keys)])
            rows = [("kept", name, kind, r, pack(at[a:b]), x[0].to_bytes(8, "little")) for x, a, b in zip(held, ends[:-1], ends[1:], strict=True)]
            e = _edges(distinct, 64 if kind == 0 else 56, many * into, r * into, (r + 1) * into)
            rows += [("keys", name, kind, f, pack(distinct[a:b]), pack(total[a:b])) for f, a, b in zip(range(r * into, (r + 1) * into), e[:-1], e[1:], strict=True) if b > a]
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _BLOB.names), strict=True):
                if row[1] == 2:
                    yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(("keys", *row), schema, strict=True)], schema=schema)
                    continue
                if held and (row[1:3] != held[0][1:3] or size >= CHUNK_BYTES):
                    yield chunk()
                held.append(row)
                size += len(row[3]) + len(row[4])
        if held:
            yield chunk()

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's totals, given to its blocks in the order of their keys."""
    for _, table in runs_of(batches, "block"):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "r", "payload", "counts")), strict=True), key=lambda x: x[:2])
        totals = np.concatenate([unpack(x[3]) for x in rows if x[2] is None])
        for kind, r, at, block in (x for x in rows if x[2] is not None):
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((int.from_bytes(block, "little"), kind, r, None, pack(totals[unpack(at)])), _BLOB, strict=True)], schema=_BLOB)


def _totals(keys: DataFrame, many: int, ranges: int) -> DataFrame:
    """Totals of the keys that blocks have sent to `many` ranges, by _add_up() over `ranges` ranges or more."""
    asked = lambda df: df.withColumn("slot", F.col("r") * 3 + F.col("kind")).repartition(many, "r").sortWithinPartitions("slot")
    if many >= ranges:
        return cut(asked(keys).mapInArrow(_add_up, _BLOB_DDL), "lm-totals")
    into = min(FAN_OUT, -(-ranges // many))
    chunks = cut(asked(keys).mapInArrow(_chunks(many, into), f"part string, {_BLOB_DDL}"), "lm-chunks", by="part")
    below = _totals(chunks.where("part = 'keys'").select(*_BLOB.names), many * into, ranges)
    back = chunks.where("part = 'kept'").select(*_BLOB.names).unionByName(below.where("kind < 3"))
    out = cut(back.repartition(many, "block").sortWithinPartitions("block").mapInArrow(_answers, _BLOB_DDL).unionByName(below.where("kind >= 3")), "lm-totals")
    drop_cut(chunks)
    drop_cut(below)
    return out


def _parts(payload: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(payload):
        n = int.from_bytes(payload[at : at + 4], "little")
        out.append(unpack(payload[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of a range's keys, for each block in the order of its keys; kind 3 has the range's tokens and types."""
    for _, table in runs_of(batches, "slot"):
        kind = table.column("kind")[0].as_py()
        if kind == 2:
            total = sum(int.from_bytes(x, "little") for x in table.column("payload").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([0], [4], [0], [total.to_bytes(8, "little")], [None]), _BLOB, strict=True)], schema=_BLOB)
            continue
        keys = [unpack(x) for x in table.column("payload").to_pylist()]
        counts = np.concatenate([unpack(x) for x in table.column("counts").to_pylist()]).astype(np.uint64)
        _, at = _distinct(np.concatenate(keys))
        totals = np.bincount(at, weights=counts).astype(np.uint64)
        cut_at = np.cumsum([0, *map(len, keys)])
        r = table.column("r")[0].as_py()
        rows = [(b, kind, r, None, pack(totals[at[x:y]].astype(np.uint32 if totals.max() < 1 << 32 else np.uint64))) for b, x, y in zip(table.column("block").to_pylist(), cut_at[:-1], cut_at[1:], strict=True)]
        if kind == 0:
            rows.append((0, 3, r, int(totals.sum()).to_bytes(8, "little") + int((totals > 0).sum()).to_bytes(8, "little"), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOB, strict=True)], schema=_BLOB)


class _Block:
    """A block's texts with the totals of its words and pairs."""

    def __init__(self, table: pa.Table, texts_total: int):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "r", "payload", "counts")), strict=True), key=lambda x: x[:2])
        ids, valid, held, n, at, types = _parts(next(x[2] for x in rows if x[0] == -1))
        self.ids, self.valid, self.held, self.n, self.at = ids, valid.astype(bool), held.astype(bool), n.astype(np.int64), at
        self.ends = np.cumsum(self.n) - 1
        self.starts = self.ends - self.n + 1
        word_total, pair_total = (np.concatenate([unpack(x[3]) for x in rows if x[0] == k]).astype(np.float64) for k in (0, 1))
        pairs, self.pair_at = _distinct(_pair_keys(types[at], self.starts))
        assert len(pairs) == len(pair_total) and len(types) == len(word_total)
        self.word = word_total[at]
        self.pair = pair_total[self.pair_at]
        self.context = np.empty(len(at))
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = texts_total


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 more than its frequency's octave."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _tally(tokens: int, texts: int):
    """Counts of (bucket, pair probability bin, word probability bin) over deleted counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs_of(batches, "block"):
            b = _Block(table, texts)
            total: dict[tuple[int, int, int], int] = {}
            for i in np.flatnonzero(~b.held):
                s = slice(b.starts[i], b.ends[i] + 1)
                _, w, own = np.unique(b.at[s], return_inverse=True, return_counts=True)
                own_word = own[w]
                _, p, own = np.unique(b.pair_at[s], return_inverse=True, return_counts=True)
                own_context = np.append(1, own_word[:-1])
                context = b.context[s] - own_context
                two = (b.pair[s] - own[p]) / np.maximum(context, 1)
                one = (b.word[s] - own_word) / max(1, tokens - b.n[i])
                bins = [np.where(x > 0, np.clip(np.round(-np.log2(np.maximum(x, 1e-300)) * OCTAVE), 0, BINS - 1), BINS).astype(np.int64) for x in (two, one)]
                code, c = np.unique((_bucket(context) * (BINS + 1) + bins[0]) * (BINS + 1) + bins[1], return_counts=True)
                for k, v in zip(code.tolist(), c.tolist(), strict=True):
                    total[k] = total.get(k, 0) + v
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cell", "c"])

    return run


def fit_weights(cells: np.ndarray, counts: np.ndarray, types: int, rounds: int = 40) -> np.ndarray:
    """Mixture weights of each bucket by expectation-maximisation; buckets without evidence take those of all."""
    side = BINS + 1
    bucket, two, one = cells // (side * side), cells // side % side, cells % side
    prob = np.stack([np.where(x < BINS, 2.0 ** (-x / OCTAVE), 0.0) for x in (two, one)] + [np.full(len(cells), 1 / (types + 1))], axis=1)
    out = np.tile([0.0, 0.9, 0.1], (66, 1))

    def em(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            part = prob[rows] * w
            part /= part.sum(axis=1, keepdims=True)
            w = (part * counts[rows][:, None]).sum(axis=0)
            w = np.maximum(w / w.sum(), 1e-6)
            w /= w.sum()
        return w

    if len(cells):
        everything = em(np.arange(len(cells)), np.array([0.4, 0.4, 0.2]))
        out[1:] = everything
        for b in np.unique(bucket):
            rows = np.flatnonzero(bucket == b)
            if counts[rows].sum() >= 30:
                out[b] = em(rows, everything if b else np.array([1e-6, 0.8, 0.2]))
    return out


def _score(m: Mixture):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs_of(batches, "block"):
            b = _Block(table, m.texts)
            bucket = _bucket(b.context)
            p = m.weights[bucket, 0] * b.pair / np.maximum(b.context, 1)
            p += m.weights[bucket, 1] * (b.word / max(1, m.tokens))
            p += m.weights[bucket, 2] / (m.types + 1)
            sums = [np.add.reduceat(x, b.starts) for x in (np.log10((b.word + 1) / (m.tokens + m.types + 1)), np.log10(p))]
            known = np.add.reduceat((b.word > 0).astype(np.int64), b.starts)
            yield pa.RecordBatch.from_arrays([pa.array(b.ids, mask=~b.valid), pa.array(b.held), pa.array(b.n), pa.array(known), pa.array(np.full(len(b.n), m.tokens)), *map(pa.array, sums)], schema=schema)

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    The model learns from rows whose crc32(doc_id as text) mod 7 is not 2 (a null id counts as the empty text, which
    is among them). Tokens are A-Z lower-cased words between ASCII white space, then one end, so an empty or null
    text is one token; a text of any length is read whole, in a block of its own. For the weights, EM reads the tally of
    all training tokens in bins of a quarter octave of their two probabilities; scores use the probabilities themselves.
    score is the log10 probability of the whole text under the model; base_score is that of
    add-one word counts. Rows of one id each count and each give a row; other columns are ignored. An empty table
    gives no rows; without training rows all counts are 0. Words are told apart by 64-bit hashes, pairs by 56 bits.
    """
    ranges = ranges_for(docs)
    sent = min(ranges, FAN_OUT)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 7) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    staged = cut(rows.mapInArrow(_stage(sent), _BLOB_DDL).withColumn("part", F.when(F.col("kind") < 0, "texts").otherwise("keys")), "lm-blocks", by="part")
    totals = _totals(staged.where("part = 'keys'").select(*_BLOB.names), sent, ranges)
    facts = totals.where("kind >= 3").select("kind", "payload").collect()  # two numbers a range
    number = lambda x, i: int.from_bytes(x[8 * i : 8 * i + 8], "little")
    tokens, types = (sum(number(f["payload"], i) for f in facts if f["kind"] == 3) for i in (0, 1))
    texts = sum(number(f["payload"], 0) for f in facts if f["kind"] == 4)
    drop_cut(staged, "part=keys")
    release(docs.sparkSession)
    blocks = staged.where("part = 'texts'").drop("part")
    many = blocks.count()
    both = blocks.select(*_BLOB.names).unionByName(totals.where("kind in (0, 1)"))
    meet = lambda df, n: df.repartition(max(1, n), "block").sortWithinPartitions("block", "kind", "r")
    tally = meet(both, many).mapInArrow(_tally(tokens, texts), "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).collect()  # cells are bounded by the bins
    weights = fit_weights(np.array([r["cell"] for r in tally], dtype=np.int64), np.array([r["c"] for r in tally], dtype=np.float64), types)
    out = meet(both, many).mapInArrow(_score(Mixture(weights, tokens, types, texts)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out
