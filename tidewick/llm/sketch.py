"""Threshold-scaled sketches: of a text's word shingles, every hash below a fixed fraction of the hash range.

The size of a sketch follows that of its text, so containment between very unequal texts can be
estimated, and the sketch of a union is the union of sketches. Where no hash is below the
threshold, the smallest one stands in, so only texts without words have an empty sketch. merge() is exact all
the same (a union's sketch needs no stand-in if either has a hash below); containment of a stand-in is 1 or 0.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ranges_for, shingle_hashes, text_bytes, word_hashes

LEAST = -(1 << 63)
#: Bytes of text of a bucket of consecutive ids.
BUCKET_BYTES = 64 << 20


def sketches(texts: list[bytes], k: int = 5, fraction: float = 0.25) -> list[np.ndarray]:
    """Sorted distinct 48-bit hashes of each text's k-word shingles that are below the fraction; else the smallest one."""
    sh, off = shingle_hashes(*word_hashes(texts), k)
    sh = sh >> np.uint64(16)
    limit = np.uint64(int(fraction * (1 << 48)))
    out = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        s = np.sort(sh[a:b])
        kept = s[: np.searchsorted(s, limit)]
        if not len(kept):
            kept = s[:1]
        out.append(kept[np.concatenate(([True], kept[1:] != kept[:-1]))] if len(kept) else kept)
    return out


def spell(sketch: np.ndarray) -> str:
    """Text form of a sketch: 8 characters a hash."""
    return base64.b64encode(np.ascontiguousarray(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode()


def parse(text: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    return np.pad(six, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: str, b: str, fraction: float = 0.25) -> str:
    """Sketch of the union of two texts' shingles."""
    both = np.union1d(parse(a), parse(b))
    below = both[both < np.uint64(int(fraction * (1 << 48)))]
    return spell(below if len(below) else both[:1])


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller shingle set that is in the other; 1 for two empty ones, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def fingerprint(docs: DataFrame, *, k: int = 5, fraction: float = 0.25) -> DataFrame:
    """(doc_id, fingerprint, n_kept) of every row of docs (doc_id, text); null texts count as empty, with an empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sketches(text_bytes(batch.column(1)), k, fraction)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spell(x) for x in s], pa.string()), pa.array([len(x) for x in s], pa.int64())], names=["doc_id", "fingerprint", "n_kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_kept long")


def _dealt(firsts: list[int]):
    """Gives each row its bucket of consecutive ids; the first rows of a bucket also go, marked, to the end of the bucket before."""
    many = len(firsts)
    of = {x: i for i, x in enumerate(firsts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [LEAST if x is None else x for x in batch.column(0).to_pylist()]
            bucket = [bisect.bisect_right(firsts, x) - 1 for x in keys]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([False] * len(keys)), *batch.columns], names=["bucket", "mark", "doc_id", "text"])
            again = [i for i, x in enumerate(keys) if x in of]
            if again:
                yield pa.RecordBatch.from_arrays([pa.array([(bucket[i] - 1) % many for i in again], pa.int32()), pa.array([True] * len(again)), *(c.take(pa.array(again)) for c in batch.columns)], names=["bucket", "mark", "doc_id", "text"])

    return run


def _compared(k: int, fraction: float):
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), text_bytes(batch.column(3)), strict=True):
                held.append(row)
                size += len(row[3])
                if size > 4 << 20 and len(held) > 1:
                    yield from compare(held)
                    held, size = held[-1:], len(held[-1][3])
        yield from compare(held)

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not pairs:
            return
        texts = [r[3].decode() for r in rows]
        halves = [len(texts[i]) // 2 for i in pairs]
        edited = [(texts[i][: len(texts[i]) - h] + texts[i + 1][:h]).encode() for i, h in zip(pairs, halves, strict=True)]
        own, new = sketches([r[3] for r in rows], k, fraction), sketches(edited, k, fraction)
        out = [(rows[i][2], len(texts[i]), hashlib.sha256(e).hexdigest(), spell(own[i]), spell(n), containment(own[i], n), containment(own[i], own[i + 1])) for i, e, n in zip(pairs, edited, new, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def edited_fingerprints(docs: DataFrame, *, k: int = 5, fraction: float = 0.25) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the beginning of the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The next document is that of
    the next doc_id, the first one after the last; rows of one id go by text, a null id is the least. A single document is
    its own next. Null texts count as empty. Every row gives a row; other columns are ignored; no rows give none.

    Texts move once: to buckets of consecutive ids, each with a copy of the row that begins the next bucket. As for a
    partitioning by range, the driver holds a border for each bucket of BUCKET_BYTES. A bucket is read as a stream, a few
    MB at a time and never less than two texts, so texts of any length are compared whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(LEAST))
    many = ranges_for(docs, BUCKET_BYTES)
    ids = rows.select(key.alias("key"))
    cuts = sorted({int(x) for x in ids.approxQuantile("key", [i / many for i in range(many)], 1 / (4 * many))})

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy()
            b = np.searchsorted(np.array(cuts, dtype=np.int64), v, side="right")
            order = np.lexsort((v, b))
            first = np.flatnonzero(np.concatenate(([True], b[order][1:] != b[order][:-1]))) if len(v) else []
            yield pa.RecordBatch.from_arrays([pa.array(b[order][first]), pa.array(v[order][first])], names=["bucket", "key"])

    # One number for each bucket, of which there are `many` at most.
    firsts = sorted(r["key"] for r in ids.mapInArrow(bucketed, "bucket long, key long").groupBy("bucket").agg(F.min("key").alias("key")).collect())
    dealt = rows.mapInArrow(_dealt(firsts), "bucket int, mark boolean, doc_id long, text string")
    ordered = dealt.repartition(max(partitions(docs.sparkSession), many), "bucket").sortWithinPartitions("bucket", "mark", "doc_id", "text")
    return ordered.mapInArrow(_compared(k, fraction), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
