import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tidewick.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs by extending every start with every period."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    edited = h % 10 == 0 and n > 0
    if edited:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


def texts():
    rng = random.Random(13)
    made = []
    for i in range(240):
        words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 2, 3, 8])]) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            at, p = rng.randrange(len(words) + 1), rng.randrange(1, 8)
            block = [rng.choice("xyz") for _ in range(p)]
            words[at:at] = (block * 9)[: rng.randrange(3 * p, 9 * p)]
        made.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    return made


def test_equal_to_brute_force(spark):
    rows = texts() + [(900, None), (901, ""), (902, " \n"), (None, "a b " * 9), (None, None), (3, "again " * 7), (3, "again " * 7), (903, "A a " * 8), (904, "ü ü " * 8), (905, "x y z " * 1500 + "w " * 1500 + "x y z " * 1500)]
    docs = spark.createDataFrame([(*r, [1], "c", 5) for r in rows], "doc_id long, text string, runs array<int>, words string, n int")
    got = periods.digests(periods.periodic_runs(periods.planted(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [expected(*r) for r in rows[:-1]]
    assert sorted(map(tuple, got.where("doc_id is null or doc_id <> 905").collect()), key=str) == sorted(want, key=str)
    whole = periods.periodic_runs(docs).where("doc_id = 905").first()
    assert [tuple(r) for r in whole["runs"]] == [(0, 4500, 3), (4500, 1500, 1), (6000, 4500, 3)] and whole["collapsed"] == "x y z w x y z"
    assert periods.digests(periods.periodic_runs(periods.planted(docs.limit(0)))).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_many_texts_at_once(seed):
    """Runs at the borders of texts don't reach into their neighbours."""
    rng = random.Random(seed)
    lists = [[rng.choice("ab"[: rng.choice([1, 2])]) for _ in range(rng.choice([0, 1, 5, 6, 7, 40]))] for _ in range(200)]
    assert periods.word_runs(*periods._numbered(lists)) == [brute(x) for x in lists]


def test_long_texts_stay_linear():
    """200,000 equal words, and as many of a few: nothing is extended again for each multiple of a period."""
    began = time.perf_counter()
    ids = np.zeros(200_000, np.int64)
    assert periods.word_runs(ids, np.array([0, len(ids)])) == [[(0, len(ids), 1)]]
    ids = np.tile(np.arange(7), 30_000)
    assert periods.word_runs(ids, np.array([0, len(ids)])) == [[(0, len(ids), 7)]]
    assert time.perf_counter() - began < 60
