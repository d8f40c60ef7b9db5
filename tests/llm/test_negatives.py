import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.llm import negatives
from tidewick.llm.negatives import MiningParams

SCHEMA = "vec_id long, label int, embedding array<float>, anchor_id string, pool int, found int"


def brute(rows, p=MiningParams()):
    """All pairs, after the rules for unusable and repeated rows."""
    known = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        known[i] = min(known.get(i, (label, v)), (label, v))
    ints = {i: (label, np.floor(p.scale * np.array(v)).astype(np.int64)) for i, (label, v) in known.items()}

    def score(a, b):
        n = min(len(a), len(b))
        return int(a[:n] @ b[:n])

    out = []
    for a, (label, v) in ints.items():
        if a % 3:
            continue
        scored = sorted((-score(v, w), b, other) for b, (other, w) in ints.items() if b != a)
        for s, b, _ in [x for x in scored if x[2] == label][: p.positives]:
            fit = [x for x in scored if x[2] != label and p.low * -s <= 100 * -x[0] <= p.high * -s][: p.negatives]
            out += [(a, b, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out)


def run(spark, rows, p):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = negatives.mine(df, F.col("vec_id") % 3 == 0, p)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(seed, n=260, labels=4):
    """Clusters, ties by vectors that repeat, one label with a third of the rows, and rows that take no part."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [round(x + rng.gauss(0, 0.1), 1) for x in c] if i % 4 else centres[0]
        rows.append((i, 0 if i % 3 == 1 else rng.randrange(labels), v))
    rows += [(None, 1, centres[0]), (900, None, centres[0]), (903, 1, None), (906, 1, [0.1, None]), (909, 2, [float("nan")] * 6), (912, 2, [float("inf")] * 6), (915, 3, []), (918, 3, [0.5, 0.5]), (921, 1, [*centres[1], 0.4]), rows[3], (3, 9, centres[2])]
    return rows


@pytest.mark.parametrize(("seed", "p"), [(1, MiningParams()), (2, MiningParams(tree_rows=40, block=16, group=2, leaf=4)), (3, MiningParams(tree_rows=90, block=8, leaf=1, positives=2, negatives=3, low=50, high=120))])
def test_equal_to_brute_force(spark, seed, p):
    rows = vectors(seed)
    want = brute(rows, p)
    assert len(want) > 300 and run(spark, rows, p) == want


def test_few_rows(spark):
    p = MiningParams()
    assert run(spark, [], p) == [] and run(spark, [(1, 1, [1.0])], p) == [] and run(spark, [(3, 1, [1.0]), (4, 2, [1.0])], p) == []
    assert run(spark, [(3, 1, [1.0]), (4, 1, [0.5]), (5, 2, [0.45])], p) == [(3, 4, 1, 5, 256 * 128, 256 * 115)]
    assert run(spark, [(3, 1, [0.0]), (4, 1, [1.0]), (5, 2, [-1.0])], p) == [(3, 4, 1, 5, 0, 0)]  # equal to zero is within the window
    assert run(spark, [(3, 1, [-1.0]), (4, 1, [1.0]), (5, 2, [0.9])], p) == []  # no score is both above 80 and below 100 % of a negative one


def test_search_prunes_and_keeps_ties():
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.integers(-50, 50, (1, 8)) + rng.integers(-3, 4, (250, 8)) for _ in range(20)]).astype(np.int64)
    ids, labels = rng.permutation(len(vectors)).astype(np.int64), (np.arange(len(vectors)) // 250).astype(np.int64)
    tree = negatives.BallTree.build(ids, labels, vectors, 50)
    assert all((np.asarray(a) == b).all() for a, b in zip(negatives.unbundle(tree.bundle()), [getattr(tree, f.name) for f in negatives.fields(tree)], strict=True))
    anchors = vectors[::500]
    q = negatives.Queries(ids[::500], labels[::500], anchors, np.arange(len(anchors)), np.full(len(anchors), negatives._LOW), np.full(len(anchors), negatives._LAST))
    seen, plain = [], negatives.inner
    try:
        negatives.inner = lambda a, b: seen.append(len(a) * len(b)) or plain(a, b)
        _, found, scores = negatives.search(tree, q, 5, True).rows()
    finally:
        negatives.inner = plain
    assert sum(seen) < 0.2 * len(anchors) * len(vectors)  # most nodes were passed over
    for k, a in enumerate(anchors):
        same = [(-int(s), int(i)) for s, i, label in zip(vectors @ a, ids, labels, strict=True) if label == q.labels[k] and i != q.ids[k]]
        assert [(-s, i) for s, i in zip(scores[5 * k : 5 * k + 5], found[5 * k : 5 * k + 5], strict=True)] == sorted(same)[:5]
    big = np.full((1, 2), 1 << 26)
    assert plain(big, big)[0, 0] == 1 << 53
    with pytest.raises(ValueError, match="64 bits"):
        plain(big << 2, big)
