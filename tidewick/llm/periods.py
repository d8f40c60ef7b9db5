"""Runs of repeated words (maximal repetitions with at least four periods), found by probing a harmonic grid.

A run of period p and at least 4p words has three neighbouring grid points jp, (j+1)p, (j+2)p whose words equal those one
period on. So for each p only every p-th word is looked at, n/p of them, n log n over all periods, for all texts of a step at
once. Grid points that survive are extended by comparing chunks of doubling length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Fewest periods, and fewest words, of a run.
PERIODS, WORDS = 4, 6
_CHUNK = 16
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _common(ids: np.ndarray, at: int, shift: int, limit: int, back: bool) -> int:
    """How many words from `at` on (or before it), `limit` at most, equal those `shift` further on; by chunks that double."""
    n, size = 0, _CHUNK
    while n < limit:
        size = min(size, limit - n)
        a = at - n - size if back else at + n
        equal = ids[a : a + size] == ids[a + shift : a + shift + size]
        if not equal.all():
            return n + int(np.argmin(equal[::-1] if back else equal))
        n += size
        size *= 2
    return n


def _covered(runs: list[tuple[int, int, int]], at: int, p: int) -> int | None:
    """Up to where words equal those p further on, if a known run tells: one whose period divides p, and that holds the
    two periods from `at` on. The stretch of period p there is that run, since a block of p words has its period."""
    runs[:] = [r for r in runs if r[1] - r[0] >= 2 * p]
    return next((e - p for s, e, q in runs if s <= at and at + 2 * p <= e and p % q == 0), None)


def word_runs(ids: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start, then period; text t's words are ids[starts[t]:starts[t+1]].

    Words are equal if their numbers are. A run can't be extended, its period is its smallest, and it has at least 4
    periods and 6 words.
    """
    lens = np.diff(starts)
    found: list[dict[tuple[int, int], int]] = [{} for _ in lens]
    cover: list[list[tuple[int, int, int]]] = [[] for _ in lens]
    live = np.argsort(-lens, kind="stable")  # the texts that are long enough for a period are the first ones
    sizes = lens[live]
    for p in range(1, int(sizes[0]) // PERIODS + 1 if len(sizes) else 0):
        many = int(np.searchsorted(-sizes, -max(WORDS, PERIODS * p), side="right"))
        if not many:
            break
        texts = live[:many]
        # Grid points j whose partner j + 1 is in the text: 0 <= j < (n - 1) // p.
        points = (lens[texts] - 1) // p
        first = np.cumsum(points) - points
        owner = np.repeat(np.arange(many), points)
        j = np.arange(len(owner)) - first[owner]
        grid = starts[texts][owner] + j * p
        equal = ids[grid] == ids[grid + p]
        # As many points in a row, within one text, as any run of this period has.
        need = WORDS - 1 if p == 1 else PERIODS - 1
        inner = max(0, len(equal) - need + 1)
        hit = equal[:inner].copy()
        for k in range(1, need):
            hit &= equal[k : k + inner]
        hit &= owner[:inner] == owner[len(owner) - inner :]
        hits, i = np.flatnonzero(hit), 0
        while i < len(hits):
            o, at = int(owner[hits[i]]), int(grid[hits[i]])
            t = int(texts[o])
            base, end = int(starts[t]), int(starts[t + 1])
            reached = _covered(cover[t], at, p)
            if reached is None:
                left, right = _common(ids, at, p, at - base, True), _common(ids, at, p, end - p - at, False)
                reached, start, length = at + right, at - left, left + right + p
                if length >= max(WORDS, PERIODS * p) and (start - base, length) not in found[t]:  # else its period is shorter
                    found[t][start - base, length] = p
                    cover[t].append((start, start + length, p))
            i = max(i + 1, int(np.searchsorted(hits, first[o] - (base - reached) // p)))
    return [sorted((s, n, p) for (s, n), p in f.items()) for f in found]


def _numbered(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, equal for equal words within these texts."""
    known: dict[str, int] = {}
    number = known.setdefault
    ids = np.fromiter((number(w, len(known)) for words in texts for w in words), dtype=np.int64, count=sum(map(len, texts)))
    return ids, np.concatenate(([0], np.cumsum([len(w) for w in texts], dtype=np.int64))).astype(np.int64)


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that a run contains after its first period."""
    if not runs:
        return " ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return " ".join([words[i] for i in np.flatnonzero(kept)])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in steps(batches):
        words = [WORD.findall(t.decode()) for t in texts]
        runs = word_runs(*_numbered(words))
        made = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
        text = [collapsed(w, r) for w, r in zip(words, runs, strict=True)]
        yield pa.record_batch([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(made, _RUNS), pa.array(text, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of docs (doc_id, text).

    Words are what space, tab, line feed, vertical tab, form feed and carriage return separate. runs is an array of
    (start, length, period), by start, then period; collapsed is the text without the repetitions. Runs of different
    periods may overlap; all are listed. A null, empty or blank text has no words, no runs and an empty collapsed text. Null
    and repeated doc_ids are rows by themselves. A text of any length is one row and is searched whole. Extra columns are
    ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_find, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with repetitions written into a tenth of the texts, by the checksum of doc_id (null counts as empty).

    With h = crc32(doc_id as text), g = h div 10, h mod 10 = 0 and n words, word i >= a becomes word a + (i - a) mod p, where
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8); the words are then joined by one space.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("words"))
    d = d.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    edited = F.array_join(F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of periodic_runs().

    start, length and period are of the run with the greatest length / period, compared as fractions, then the smallest
    start, then the smallest period; null without runs.
    """
    ahead = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    # Runs come by start, then period, so a later one has to be better.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(ahead(r, a), r).otherwise(a))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    d = found.withColumn("best", best)
    column = lambda c: F.col(f"best.{c}").alias(c)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), column("start"), column("length"), column("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(spelled, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
