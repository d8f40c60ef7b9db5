"""Removal of long repeated byte strings, with a run-length index of what may repeat.

1. Texts that occur twice repeat as a whole. Of each distinct text, every window of `length` bytes is
   assigned to its anchor, the least-hashed k-byte string in it (leftmost of equals). Equal windows
   have equal anchors, wherever they are, at the same place. The windows of an anchor are a segment of the text.
2. Segments are counted by anchor and by hash: those that occur twice as a whole repeat; anchors
   that occur once can't; only the other segments need a look at their bytes.
3. These are split: the windows by the anchor's place in them, in buckets, and these by the bytes that
   all windows of a bucket have. What then is alone, or repeats as a whole, is settled; a group with more
   bytes than an index takes is split again, into narrower buckets. A bucket of one place holds whole
   windows, so this ends, and no task gets a hot anchor.
4. The bytes of each group meet, with one copy of each segment that is known to repeat: a suffix
   array (prefix tripling), its Burrows-Wheeler transform in runs, and samples at the run ends. A
   row within a run has its predecessor's match one byte later, so lengths are compared at run
   heads only and streamed along the text: PLCP[i] = PLCP[i - 1] - 1 elsewhere. A position's
   matching statistic is the longer of its matches with the neighbouring rows; a start with at
   least `length` is marked.
5. The marks go back to the texts, whose covered bytes are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE_VALUE, cut, drop_cut, mix64, ranges_for, runs_of, text_bytes

KMER = 32
PIECE = 1 << 20
#: Bytes of segments that one index takes; a group that has more is split again.
INDEX_BYTES = 1_500_000
#: Places of an anchor in a bucket, from split to split.
WIDTHS = (96, 24, 6, 1)
_U = np.uint64
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_ANCHORS = "owner long, first long, many long, lead long, akey long, skey long"
_BODIES = "part string, akey long, owner long, first long, many long, lead long, state int, bhash long, body binary"
_BODY_SCHEMA = pa.schema([("part", pa.string()), *((c, pa.int64()) for c in ("akey", "owner", "first", "many", "lead")), ("state", pa.int32()), ("bhash", pa.int64()), ("body", pa.binary())])


def _prefix_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse powers that make differences comparable."""
    n = len(raw)
    powers = np.full(n + 1, _BASE, dtype=np.uint64)
    back = np.full(n + 1, _INVERSE, dtype=np.uint64)
    powers[0] = back[0] = 1
    powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
    h = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * powers[:n], out=h[1:])
    return h, back


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    a = np.full(-(-n // w) * w, ~_U(0), dtype=np.uint64)
    a[:n] = v
    a = a.reshape(-1, w)
    ahead = np.minimum.accumulate(a, axis=1).ravel()
    behind = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, windows, anchor's place in the first window, anchor hash, segment hash) of the anchors of texts of at least `length` bytes."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(raw) < length:
        return none
    h, back = _prefix_hashes(raw)
    kmers = mix64((h[KMER:] - h[:-KMER]) * back[: len(raw) - KMER + 1])
    # Places break ties, so that a window's anchor is the leftmost of equal strings.
    least = _sliding_min((kmers >> _U(24) << _U(24)) | np.arange(len(kmers), dtype=np.uint64), length - KMER + 1)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= ends[text]
    same = (least[1:] == least[:-1]) & inside[1:] & inside[:-1] & (text[1:] == text[:-1])
    first = np.flatnonzero(inside & np.concatenate(([True], ~same)))
    last = np.flatnonzero(inside & np.concatenate((~same, [True])))
    if not len(first):
        return none
    place = (least[first] & _U((1 << 24) - 1)).astype(np.int64)
    stop = last + length
    skey = mix64(mix64((h[stop] - h[first]) * back[first]) + (place - first).astype(np.uint64) * _BASE + (stop - first).astype(np.uint64))
    return text[first], first - (ends - sizes)[text[first]], last - first + 1, place - first, kmers[place], skey


def long_pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of a long text that overlap so that each window lies in one of them: none is lost, none is in two."""
    at = 0
    while at == 0 or at + length <= len(text):
        yield at, text[at : at + PIECE + length - 1]
        at += PIECE


def _anchors(length: int):
    schema = pa.schema([(c, pa.int64()) for c in ("owner", "first", "many", "lead", "akey", "skey")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            held: list[tuple[int, int, bytes]] = []
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                if key in seen or len(text) < length:
                    continue
                seen.add(key)
                for at, piece in long_pieces(text, length):
                    held.append((key, at, piece))
                    size += len(piece)
                    if size >= PIECE:
                        yield made(held)
                        held, size = [], 0
            if held:
                yield made(held)

    def made(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        text, first, many, lead, akey, skey = segments([x[2] for x in held], length)
        keys = np.array([x[0] for x in held], dtype=np.int64)
        base = np.array([x[1] for x in held], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[text], base[text] + first, many, lead, akey.view(np.int64), skey.view(np.int64))], schema=schema)

    return run


def _met(segments: DataFrame, kind: str) -> DataFrame:
    """segments (akey, `kind`, owner, first, state, ...) that repeat or need a look, with their new state: 1 repeats as a
    whole, 2 its bytes are needed, 3 stands for repeating ones among such; and bytes, those of its anchor that need a look.

    A segment of state 3 repeats already. Counts are combined before they are exchanged, and only joined to the rows.
    """
    kinds = segments.groupBy("akey", kind).agg(F.count(F.lit(1)).alias("n"), F.max("state").alias("known"), F.min(F.struct("owner", "first")).alias("rep"), F.first("size").alias("one"))
    alone = (F.col("n") == 1) & (F.col("known") == 2)
    groups = kinds.groupBy("akey").agg(F.count(F.lit(1)).alias("kinds"), F.max(alone).alias("open"), F.sum("one").alias("bytes"))
    # Written, so that a hot anchor's rows can be split between tasks of the join.
    groups = cut(groups.where("kinds > 1 and open").drop("kinds", "open"), "anchor-groups")
    kinds = cut(kinds.join(groups, "akey", "left").where("n > 1 or bytes is not null").drop("one"), "anchor-kinds")
    d = segments.withColumnRenamed("state", "was").join(kinds, ["akey", kind])
    again = (F.col("n") > 1) & (F.col("was") == 2)
    stands = F.col("bytes").isNotNull() & ((F.col("n") > 1) | (F.col("was") == 3)) & (F.struct("owner", "first") == F.col("rep"))
    states = F.filter(F.array(F.when(again, 1), F.when(F.col("bytes").isNotNull() & (F.col("n") == 1) & (F.col("was") == 2), 2), F.when(stands, 3)), lambda x: x.isNotNull())
    return d.withColumn("state", F.explode(states)).drop("was", "n", "known", "rep")


def _merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of [from, to) rows; touching ones join."""
    if not len(spans):
        return spans.reshape(0, 2)
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate(([True], s[1:, 0] > reach[:-1]))
    start = np.flatnonzero(new)
    return np.stack((s[start, 0], reach[np.append(start[1:], len(s)) - 1]), axis=1)


def _body_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BODY_SCHEMA, strict=True)], schema=_BODY_SCHEMA)


def _number(*parts: bytes | int) -> int:
    h = hashlib.blake2b(digest_size=8)
    for x in parts:
        h.update(x if isinstance(x, bytes) else x.to_bytes(8, "little", signed=True))
    return int.from_bytes(h.digest(), "little", signed=True)


def _split(row: tuple, length: int, width: int) -> Iterator[tuple]:
    """A segment's windows by buckets of the anchor's place in them, keyed by the bytes that all windows of the bucket have."""
    _, akey, owner, first, many, lead, state, _, body = row
    for bucket in range((lead - many + 1) // width, lead // width + 1):
        low, high = max(lead - many + 1, bucket * width), min(lead, bucket * width + width - 1)
        n = high - low + 1
        part = body[lead - high : lead - high + n + length - 1]
        core = high - bucket * width
        yield "split", _number(akey, bucket, width, part[core : core + max(0, length - width + 1)]), owner, first + lead - high, n, high, state, _number(high, n, part), part


def _segment_bytes(length: int, width: int):
    """Bytes of the segments that are asked for, split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for owner, text, asked in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for x in asked:
                    body = text[x["first"] : x["first"] + x["many"] + length - 1]
                    rows += _split((None, x["akey"], owner, x["first"], x["many"], x["lead"], x["state"], 0, body), length, width)
                    size += len(body)
                if size > 2 << 20:
                    yield _body_rows(rows)
                    rows, size = [], 0
            if rows:
                yield _body_rows(rows)

    return run


def _split_again(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for row in zip(*(batch.column(c).to_pylist() for c in _BODY_SCHEMA.names), strict=True) for x in _split(row, length, width)]
            for at in range(0, len(rows), 2000):
                yield _body_rows(rows[at : at + 2000])

    return run


class RunLengthIndex:
    """Suffix order of several strings (each ends with a character of its own), as a transform in runs with sampled run ends."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings])
        n, m = int(sizes.sum()), len(strings)
        self.text = text = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.ends = ends = np.repeat(np.cumsum(sizes), sizes)
        self.starts = np.cumsum(sizes) - sizes
        string = np.repeat(np.arange(m), sizes)
        place = np.arange(n)
        # First eight bytes as a number; beyond a string's end zeros, which the length in `left` tells apart.
        padded = np.concatenate((text, np.zeros(8, np.uint8)))
        key = np.zeros(n, dtype=np.uint64)
        for j in range(8):
            key = key << _U(8) | np.where(place + j < ends, padded[j : j + n], 0).astype(np.uint64)
        left = np.minimum(ends - place, 8)
        order = np.lexsort((string, left, key)) if (left < 8).any() else np.argsort(key)
        k, f, s = key[order], left[order], string[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (f[1:] != f[:-1]) | ((f[1:] < 8) & (s[1:] != s[:-1]))))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        depth = 8
        top = int(sizes.max())
        while depth < top and rank.max() < n - 1:
            def later(step: int, rank: np.ndarray = rank) -> np.ndarray:
                at = place + step
                return np.where(at < ends, rank[np.minimum(at, n - 1)] + 1, 0)

            if n < (1 << 21) - 1:
                key = (rank.astype(np.uint64) << _U(42)) | (later(depth).astype(np.uint64) << _U(21)) | later(2 * depth).astype(np.uint64)
                order = np.argsort(key)
                k = key[order]
                new = np.concatenate(([True], k[1:] != k[:-1]))
                depth *= 3
            else:
                second = later(depth)
                order = np.lexsort((second, rank))
                a, b = rank[order], second[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                depth *= 2
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new) - 1
        if rank.max() < n - 1:  # equal strings: by string
            order = np.lexsort((string, rank))
            rank[order] = np.arange(n)
        self.rank = rank
        self.rows = np.empty(n, dtype=np.int64)
        self.rows[rank] = place
        before = np.where(place > self.starts[string], text[place - 1].astype(np.int64), 256 + string)
        self.transform = before[self.rows]
        heads = np.concatenate(([True], self.transform[1:] != self.transform[:-1]))
        self.run_heads = np.flatnonzero(heads)  # sampled: rows[run_heads], and rows[run_heads - 1] ends the run before
        self.run_values = self.transform[self.run_heads]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b."""
        out = np.zeros(len(a), dtype=np.int64)
        most = np.minimum(self.ends[a] - a, self.ends[b] - b)
        padded = np.concatenate((self.text, np.zeros(8, np.uint8)))
        word = np.lib.stride_tricks.as_strided(padded, shape=(len(self.text) + 1, 8), strides=(1, 1))
        live = np.flatnonzero(most > 0)
        while len(live):
            x = word[a[live] + out[live]] == word[b[live] + out[live]]
            more = np.where(x.all(axis=1), 8, x.argmin(axis=1))
            more = np.minimum(more, most[live] - out[live])
            out[live] += more
            live = live[(more == 8) & (out[live] < most[live])]
        return out

    def matching_statistics(self) -> np.ndarray:
        """At each position, the longest match that also starts elsewhere in the strings."""
        n = len(self.text)
        head = self.run_heads[1:]
        at = self.rows[head]
        length = np.full(n, -1, dtype=np.int64)
        length[at] = self._common(at, self.rows[head - 1])
        length[self.rows[0]] = 0
        # Between samples a match goes on one byte shorter.
        known = np.maximum.accumulate(np.where(length >= 0, np.arange(n), 0))
        plcp = np.maximum(length[known] - (np.arange(n) - known), 0)
        after = np.zeros(n, dtype=np.int64)
        after[self.rows[:-1]] = plcp[self.rows[1:]]
        return np.maximum(plcp, after)


def _repeating_starts(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """Per segment, the starts of windows that start elsewhere among the segments too."""
    index = RunLengthIndex(bodies)
    long = index.matching_statistics() >= length
    return [np.flatnonzero(long[a : a + len(b)]) for a, b in zip(index.starts, bodies, strict=True)]


def _mark(length: int, index_bytes: int):
    schema = pa.schema([("owner", pa.int64()), ("first", pa.int64()), ("many", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for _, table in runs_of(batches, "akey"):
            n = table.column("body").nbytes
            if held and size + n > index_bytes:
                yield from marked(held)
                held, size = [], 0
            held.append(table)
            size += n
        if held:
            yield from marked(held)

    def marked(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = {}
        for t in tables:
            for akey, owner, first, state, body in zip(*(t.column(c).to_pylist() for c in ("akey", "owner", "first", "state", "body")), strict=True):
                rows[akey, owner, first] = (state, body)
        keys = list(rows)
        out = []
        for (_, owner, first), (state, _), at in zip(keys, rows.values(), _repeating_starts([b for _, b in rows.values()], length), strict=True):
            if state == 2 and len(at):
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                out += [(owner, first + int(x[0]), len(x)) for x in np.split(at, cuts)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


def _cut_out(length: int):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary()), ("kept_text", pa.string())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text, copies, spans in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if copies > 1 and len(text) >= length:
                    gone = np.array([[0, len(text)]])
                else:
                    gone = _merge_spans(np.array([(x["first"], x["first"] + x["many"] + length - 1) for x in spans or []], dtype=np.int64).reshape(-1, 2))
                edges = [0, *gone.ravel().tolist(), len(text)]
                kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                rows.append((doc_id, len(text), [{"start": a, "end": b} for a, b in gone.tolist()], kept, kept.decode(errors="ignore")))
                size += len(kept)
                if size > 2 << 20:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return run


def remove_repeats(docs: DataFrame, *, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, kept_text) for every row of docs (doc_id, text).

    Every byte is removed that a string of `length` bytes covers which also starts anywhere else, in the same text or
    another; strings overlap, and lie within a text. spans are the maximal removed runs (start, end) in bytes, end
    exclusive, in order; kept is the bytes that remain, and kept_text the code points that they make (a removed run may
    cut one). Texts are UTF-8; a null or empty text has 0 bytes and keeps none. Rows that repeat a text repeat each other:
    all of it goes if it has `length` bytes. A null doc_id is a document like any other; other columns are ignored; an
    empty table gives none. `length` is at least 64. Texts are told apart by 64 bits of their MD5, segments by 64-bit
    hashes; a text of any length is read whole, in pieces that overlap.
    """
    if length < 2 * KMER:
        raise ValueError(f"length must be at least {2 * KMER}")
    many = ranges_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 16), 16, -10).cast("long"))
    version = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    texts = rows.groupBy("key").agg(F.min(version).alias("version"), F.count(F.lit(1)).alias("copies"))
    sent = rows.where(F.octet_length("text") >= length).select("key", "text").mapInArrow(_anchors(length), _ANCHORS)
    # A text that several tasks have read comes several times: it repeats as a whole, so its segments count rightly.
    sent = cut(sent, "segments").withColumn("state", F.lit(2)).withColumn("size", F.col("many") + length - 1)
    met = cut(_met(sent, "skey").select("owner", "first", "many", "lead", "akey", "state"), "met")
    marks = met.where("state = 1").select("owner", "first", "many")
    # Bytes of the segments that need a look, from one copy of each text.
    asked = met.where("state > 1").groupBy("owner").agg(F.collect_list(F.struct("first", "many", "lead", "akey", "state")).alias("asked"))
    asked = asked.join(texts.select(F.col("key").alias("owner"), "version"), "owner")
    bodies = rows.withColumn("version", version).join(asked.withColumnRenamed("owner", "key"), ["key", "version"]).select("key", "text", "asked").mapInArrow(_segment_bytes(length, WIDTHS[0]), _BODIES)
    split = cut(bodies, "bodies")
    drop_cut(sent)
    fields = [f.name for f in _BODY_SCHEMA]
    looked, level = None, 0
    while looked is None or not split.isEmpty():
        level += 1
        # Rows that repeat an id and text send a segment twice; their text repeats as a whole, so it counts rightly.
        found = _met(split.withColumn("size", F.octet_length("body")), "bhash").withColumn("part", F.when(F.col("state") == 1, "repeats").when(F.col("bytes") > INDEX_BYTES, "hot").otherwise("whole"))
        found = cut(found.select(*fields), f"split-{level}", by="part")
        marks = marks.unionByName(found.where("part = 'repeats'").select("owner", "first", "many"))
        whole = found.where("part = 'whole'").select("akey", "owner", "first", "state", "body")
        looked = whole if looked is None else looked.unionByName(whole)
        drop_cut(split)
        split = found.where("part = 'hot'")
        if level < len(WIDTHS):
            split = cut(split.select(*fields).mapInArrow(_split_again(length, WIDTHS[level]), _BODIES), f"narrower-{level}")
    looked = looked.repartition(many, "akey").sortWithinPartitions("akey").mapInArrow(_mark(length, INDEX_BYTES), "owner long, first long, many long")
    marks = cut(marks.unionByName(looked), "repeats")
    drop_cut(met)
    spans = marks.groupBy(F.col("owner").alias("key")).agg(F.collect_list(F.struct("first", "many")).alias("spans"))
    # Of texts that occur twice nothing else is asked.
    found = texts.select("key", "copies").where("copies > 1").join(spans, "key", "full_outer").select("key", F.coalesce("copies", F.lit(1)).alias("copies"), F.when(F.coalesce("copies", F.lit(1)) == 1, F.col("spans")).alias("spans"))
    done = rows.join(found, "key", "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "spans")
    return done.mapInArrow(_cut_out(length), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, kept_text string")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_chars, spans, kept_text) of remove_repeats(); spans are spelled start:end, comma-joined."""
    spelled = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.length("kept_text").cast("long").alias("kept_chars"), spelled.alias("spans"), "kept_text",
    )


def drop_repeats(docs: DataFrame, *, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_chars): the digests of remove_repeats() without its spans and texts."""
    return digests(remove_repeats(docs, length=length)).drop("spans", "kept_text")
