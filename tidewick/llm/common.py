"""Shared pieces of the corpus operators: shared-folder tables, Arrow batching, word hashing.

Words are hashed in bulk: a batch of texts becomes one byte array, separators are found
with a lookup table and each word gets a 64-bit polynomial hash over a random byte table,
finished with an avalanche mix. Nothing here loops over words in Python.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once.
STEP_BYTES = 2 << 20

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser over uint64 values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 256), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def _hash_piece(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one byte string."""
    raw = np.frombuffer(piece, dtype=np.uint8)
    blank = _BLANK[raw]
    inside = ~blank
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lens = ends - starts
    first = np.cumsum(lens) - lens
    value = _BYTE_VALUE[_LOWER[raw[inside]]]
    at = np.arange(len(value)) - np.repeat(first, lens)
    value *= _powers(int(lens.max()) + 1)[at]
    return mix64(np.add.reduceat(value, first) + lens.astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts, and len(texts)+1 offsets into them.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and
    carriage return. A text over STEP_BYTES is cut at such a separator, so that memory does
    not follow the length of one document.
    """
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            h, starts = _hash_piece(b" ".join([texts[i] for i in group]))
            lens = np.array([len(texts[i]) + 1 for i in group])
            cut = np.searchsorted(starts, np.cumsum(lens))
            counts[group] = np.diff(cut, prepend=0)
            hashes.append(h)
            group.clear()
            size = 0

    for i, t in enumerate(texts):
        if len(t) > STEP_BYTES:
            flush()
            for piece in text_pieces(t):
                h, _ = _hash_piece(piece)
                counts[i] += len(h)
                hashes.append(h)
            continue
        if size + len(t) > STEP_BYTES:
            flush()
        group.append(i)
        size += len(t) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def text_pieces(t: bytes) -> Iterator[bytes]:
    """Cuts a long text at separators into pieces of about STEP_BYTES."""
    at = 0
    while at < len(t):
        end = at + STEP_BYTES
        while end < len(t) and not _BLANK[t[end]]:
            end += 1
        yield t[at:end]
        at = end


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in order, with offsets; a text of fewer words has one shingle, of no words none."""
    n = np.diff(offsets)
    out_n = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_off = np.concatenate(([0], np.cumsum(out_n)))
    out = np.empty(out_off[-1], dtype=np.uint64)
    if len(words) >= k:
        h = np.full(len(words) - k + 1, _U(k), dtype=np.uint64)
        for j in range(k):
            h = mix64(h * _BASE + words[j : j + len(h)])
        valid = np.flatnonzero(n >= k)
        if len(valid):
            take = np.ones(len(h), dtype=bool)
            # Starts of the last k-1 words of each text don't begin a shingle.
            for j in range(1, k):
                e = offsets[1:] - j
                e = e[(e >= offsets[:-1]) & (e < len(h))]
                take[e] = False
            at = np.repeat(n >= k, out_n)
            out[at] = h[take]
    for c in range(1, k):
        short = np.flatnonzero(n == c)
        if len(short):
            h = np.full(len(short), _U(c), dtype=np.uint64)
            for j in range(c):
                h = mix64(h * _BASE + words[offsets[short] + j])
            out[out_off[short]] = h
    return out, out_off


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = 4 * STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices Arrow batches so that a slice has at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = text_bytes(batch.column(text))
        at = size = 0
        for i, v in enumerate(values):
            if i > at and size + len(v) > limit:
                yield batch.slice(at, i - at), values[at:i]
                at, size = i, 0
            size += len(v)
        yield batch.slice(at), values[at:]


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Groups rows with equal consecutive keys; the input is sorted by the key within its partition."""
    held: list[pa.RecordBatch] = []
    now: object = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        at = 0
        for i in range(n + 1):
            if i == n or keys[i] != keys[at]:
                if held and keys[at] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = keys[at]
                held.append(batch.slice(at, i - at))
                at = i
                if i == n:
                    break
    if held:
        yield now, pa.Table.from_batches(held)


def pack(values: np.ndarray) -> bytes:
    """Compresses an integer array by byte planes; sorted values lose their leading planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return values.dtype.char.encode() + len(values).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    """Inverse of pack()."""
    dtype = np.dtype(blob[:1].decode())
    n = int.from_bytes(blob[1:5], "little")
    raw = pa.decompress(blob[5:], n * dtype.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size on disk."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ranges_for(df: DataFrame, each: int = 8 << 20) -> int:
    """How many hash ranges keep one range's share of a table's words within a task's memory."""
    size = size_in_bytes(df)
    # A table that isn't read from files has no estimate but the largest number.
    return max(partitions(df.sparkSession), size // each if size < 1 << 57 else 0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode, where there is one machine, a temporary one if none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="tidewick-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, and survives lost executors.

    With `by`, each value of that column has a folder of its own, see drop_cut().
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    back._shared_path = path  # type: ignore[attr-defined]
    return back


def drop_cut(df: DataFrame, part: str = "") -> None:
    """Removes a table written by cut(), or one part "column=value" of it, that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        path = f"{path}/{part}" if part else path
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of stages that nothing refers to any more, which otherwise wait for the driver's next collection.

    Python's references go first, and reach the JVM with the next call, so it takes two rounds.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # Texts are long: fewer rows in an Arrow batch keep Python workers small.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, m: int):
    """crc32 of the value as text, modulo m; null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(m)

