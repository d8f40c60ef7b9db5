"""Results don't depend on what they must not depend on: other items' lengths, lengths of names, words and schemes."""

import collections
import math
import random
import re
import time

import numpy as np
import pytest

from tidewick.llm import bm25, secrets, toxicity

SCHEMA = "doc_id long, text string"
ITEMS = "item_id long, text string"


def leaks(spark, docs, items, **kw):
    p = bm25.Bm25Params(**kw)
    got = bm25.leaks(spark.createDataFrame([(*d, "x", 1.0) for d in docs], SCHEMA + ", item_id string, score double"), spark.createDataFrame(items, ITEMS), p)
    return {(r["doc_id"], r["item_id"]): (round(r["score"], 6), round(r["question_overlap"], 6), round(r["answer_overlap"], 6)) for r in got.collect()}


def test_an_unrelated_long_item_changes_no_row(spark):
    """A short item in four pieces, 900 words apart, is not held, with or without a long item beside it."""
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(100_000)}"
    item = "what is the colour of the moon at night ? it is grey and sometimes red indeed".split()
    filler = [[word() for _ in range(900)] for _ in range(5)]
    scattered = " ".join(" ".join(f + item[4 * i : 4 * i + 4]) for i, f in enumerate(filler))
    whole = " ".join([*filler[0], *item, *filler[1]])
    docs = [(1, scattered), (2, whole), (3, " ".join(filler[2]))]
    short, long = (1, " ".join(item)), (2, " ".join(word() for _ in range(5000)))
    alone, both = leaks(spark, docs, [short]), leaks(spark, docs, [short, long])
    assert set(alone) == set(both) == {(2, 1)}
    assert alone[2, 1][1:] == both[2, 1][1:] == (1.0, 1.0)


def plain_leaks(docs, items, p):
    """All documents against all items: normalised BM25 of every window, overlap of every span."""
    items = [(i, t.split()) for i, t in items]
    df = collections.Counter(w for _, t in items for w in set(t))
    mean = sum(len(t) for _, t in items) / len(items)
    out = {}
    for item_id, item in items:
        weight = {w: math.log1p((len(items) - df[w] + 0.5) / (df[w] + 0.5)) * n * (p.k1 + 1) / (n + p.k1 * (1 - p.b + p.b * len(item) / mean)) for w, n in collections.Counter(item).items()}
        total = sum(weight.values())
        stride = p.least_stride
        while stride < len(item):
            stride *= 2
        cut = bm25.split_item([w.encode() for w in item], " ".join(item).encode(), p.answer_share)[0]
        parts = [(part, 3 if len(part) >= 8 else 1) for part in (item[:cut], item[cut:])]
        grams = lambda words, k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
        span = max(int(p.spread * len(item)), len(item) + 16)
        for doc_id, text in docs:
            words = text.split()
            for a in range(0, max(1, len(words)), stride):
                score = sum(weight.get(w, 0.0) for w in set(words[a : a + 2 * stride])) / total
                if score < p.threshold - 1e-9:
                    continue
                passage = words[max(0, a - stride) : a + 3 * stride]
                seen = [tuple(len(grams(passage[f : f + span], k) & grams(part, k)) / len(grams(part, k)) for part, k in parts) for f in range(len(passage))]
                q, r = max(seen, key=lambda x: (min(x), sum(x)))
                if min(q, r) >= p.overlap:
                    key = doc_id, item_id
                    out[key] = max(out.get(key, (0,)), (round(score, 6), round(q, 6), round(r, 6)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_all_pairs(spark, seed):
    """Whole, cut, shuffled and scattered items of several lengths; scores at the threshold count."""
    rng = random.Random(seed)
    word = lambda n=400: f"w{rng.randrange(n)}"
    items = [(i, " ".join([*(word() for _ in range(rng.choice([6, 20, 40, 90]))), "end.", *(word() for _ in range(rng.choice([1, 5, 12])))])) for i in range(14)]
    docs = []
    for i in range(60):
        t = items[rng.randrange(len(items))][1].split()
        kind = i % 5
        if kind == 1:
            t = t[: len(t) * 7 // 10]
        elif kind == 2:
            t = [w if rng.random() > 0.2 else word() for w in t]
        elif kind == 3:
            t = [x for w in t for x in (w, *(word(100_000) for _ in range(rng.choice([0, 0, 0, 3]))))]
        elif kind == 4:
            rng.shuffle(t)
        docs.append((i, " ".join([*(word(100_000) for _ in range(rng.randrange(200))), *t, *(word(100_000) for _ in range(rng.randrange(200)))])))
    p = bm25.Bm25Params()
    got, want = leaks(spark, docs, items), plain_leaks(docs, items, p)
    assert set(got) == set(want) and len(want) > 20
    assert all(np.allclose(got[k][0], want[k][0], atol=1e-5) for k in want)


def test_names_of_any_length():
    """Long key labels and schemes are whole; a long run of scheme characters is read once."""
    label = "VERY " * 12
    key = f"-----BEGIN {label}PRIVATE KEY-----\n{'MIIEpAIBAAKCAQEA7' + 'q' * 47}\n-----END {label}PRIVATE KEY-----"
    assert (2, 2 + len(key), 4) in secrets.find_spans(f"x {key} y")
    for scheme in ("a" * 30, "git+ssh.v2-" * 4 + "x", "ab"):
        url = f"{scheme}://user:secretpw@host.org"
        assert (4, 4 + len(url), 5) in secrets.find_spans(f"see {url} now")
    assert [s for s in secrets.find_spans("9+http://u:passw@h a://u:passw@h") if s[2] == 5] == [(2, 18, 5)]
    began = time.perf_counter()
    secrets.find_spans("a" * 2_000_000 + "@ :// " + "-----BEGIN " * 20_000)
    assert time.perf_counter() - began < 20
    old = re.compile(r"[a-z][a-z0-9+.-]+://[^\s/:@]*:[^\s/@]{4,}@[A-Za-z0-9.-]+")
    rng = random.Random(3)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "9", "://", ":", "u:passw@h", "@", " ", "/", "+b", "É"]) for _ in range(rng.randrange(14)))
        assert secrets._urls(t) == [m.span() for m in old.finditer(t)], t


def test_long_words_are_learned(spark):
    insult, harmless = "x" * 25 + "y" * 25, "z" * 50
    rows = [(i, f"you{i % 40} {insult} number{i}" if i % 2 else f"you{i % 40} {harmless} number{i}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], SCHEMA)
    lexicon = toxicity.learn(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, lexicon).collect()}
    assert all(got[i] == toxic for i, _, toxic in rows)
