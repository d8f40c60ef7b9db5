"""Boosting and grids against plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.operators import boosting
from tidewick.operators.boosting import Boosting

COLUMNS = [f"x{i}" for i in range(5)]


def table(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 2)
    x[:, 4] = rng.integers(0, 2, n)
    y = np.abs(0.5 + np.where(x[:, 0] > 0.3, 0.4, 0) + 0.2 * x[:, 1] * (x[:, 4] > 0) + rng.normal(size=n) * 0.05)
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(i, float(t), *map(float, v), i % 4) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "k long, y double, " + ", ".join(f"{c} double" for c in COLUMNS) + ", part int").repartition(parts, "k")


def soft(g, a):
    return np.sign(g) * max(abs(g) - a, 0.0)


def plain_fit(x, y, cuts, spec):
    """Trees by looking at the rows of every node for every threshold; no rows or columns are sampled."""
    margin, trees = np.full(len(y), y.mean()), []
    score = lambda g, n: soft(g, spec.l1) ** 2 / (n + spec.l2) if n + spec.l2 else 0.0

    def grow(at, depth):
        g, n = (margin - y)[at].sum(), len(at)
        best = None
        if depth < spec.depth:
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left = x[at, f] <= c
                    a = left.sum()
                    if min(a, n - a) < spec.child:
                        continue
                    gl = (margin - y)[at][left].sum()
                    gain = score(gl, a) + score(g - gl, n - a) - score(g, n)
                    if gain > spec.least_gain and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, f, c
        if best is None:
            return ("leaf", -soft(g, spec.l1) / (n + spec.l2) * spec.rate, at)
        left = x[at, best[1]] <= best[2]
        return (best, n, grow(at[left], depth + 1), grow(at[~left], depth + 1))

    def leaves(node):
        if node[0] == "leaf":
            yield node
        else:
            yield from leaves(node[2])
            yield from leaves(node[3])

    for _ in range(spec.rounds):
        trees.append(grow(np.arange(len(y)), 0))
        step = np.zeros(len(y))
        for _, value, at in leaves(trees[-1]):
            step[at] = value
        margin = margin + step
    return margin, trees


def gains(node, out):
    if node[0] != "leaf":
        (gain, f, _), n = node[0], node[1]
        out.append((f, gain, n))
        gains(node[2], out)
        gains(node[3], out)
    return out


@pytest.mark.parametrize("spec", [Boosting(rounds=30, depth=3), Boosting(rounds=12, depth=4, l1=0.3, l2=5.0, child=9), Boosting(rounds=30, depth=2, l2=0.0, child=20, rate=0.3, least_gain=0.0)])
@pytest.mark.parametrize("local", [boosting.LOCAL_BYTES, 0])
def test_fit_equals_plain_numpy(spark, spec, local):
    """By model and by rows: the same trees, forecasts and gains as a version that has all rows at hand."""
    if not local:
        spec = boosting.replace(spec, rounds=4)
    x, y = table()
    df = frame(spark, x, y)
    t = boosting.BinnedTable(df, COLUMNS, "y", [F.lit(1)], ["k"])
    try:
        (model,), scores = t.fit([(spec, 0, (spec.rounds,))], local)
    finally:
        t.close()
    assert not scores  # no rows to score
    margin, trees = plain_fit(x, y, t.cuts, spec)
    got = {r["k"]: r["prediction"] for r in boosting.predict(model, t.cuts, df, COLUMNS, ["k"]).collect()}
    assert np.allclose([got[i] for i in range(len(y))], margin, rtol=1e-9)
    splits = [s for tree in trees for s in gains(tree, [])]
    for i, (name, gain, cover, n, share) in enumerate(boosting.importances(model, COLUMNS)):
        mine = [s for s in splits if s[0] == i]
        assert name == COLUMNS[i] and n == len(mine)
        if mine:
            assert np.allclose([gain, cover], [np.mean([s[1] for s in mine]), np.mean([s[2] for s in mine])]) and 0 <= share <= 1


def test_both_ways_agree_with_sampling_and_checkpoints(spark, monkeypatch):
    """Rows and columns are sampled by key and round, so it doesn't matter where a row is; margins are written on the way."""
    monkeypatch.setattr(boosting, "CUT_ROUNDS", 2)
    x, y = table(300)
    roles = [F.when(F.col("part") < 3, 1).otherwise(2), F.when(F.col("part") == 0, 1).when(F.col("part") == 1, 2).otherwise(0)]
    tasks = [(Boosting(rounds=5, rows=0.7, columns=0.7), 0, (2, 5)), (Boosting(rounds=3, depth=2, child=5), 1, (3,))]
    found = []
    for parts, local in ((1, boosting.LOCAL_BYTES), (3, 0)):
        t = boosting.BinnedTable(frame(spark, x, y, parts), COLUMNS, "y", roles, ["k"], found[0][2] if found else None)
        found.append((*t.fit(tasks, local), t.cuts))
        t.close()
    (a, s, _), (b, u, _) = found
    assert s.keys() == u.keys() == {(0, 2), (0, 5), (1, 3)} and all(np.allclose(s[k], u[k]) for k in s)
    for m, n in zip(a, b, strict=True):
        assert all((p["feature"] == q["feature"]).all() and (p["bin"] == q["bin"]).all() and np.allclose(p["value"], q["value"]) for p, q in zip(m.trees, n.trees, strict=True))


def test_grid_takes_stages_of_one_fit(spark):
    x, y = table(250)
    roles = [F.when(F.col("k") < a, 1).when(F.col("k") < a + 60, 2).otherwise(0) for a in (120, 190)]
    t = boosting.BinnedTable(frame(spark, x, y), COLUMNS, "y", roles, ["k"])
    grid = [Boosting(rounds=r, rate=rate, depth=2) for r in (3, 8) for rate in (0.1, 0.5)]
    got = boosting.grid_search(t, grid)
    one_by_one = [boosting.grid_search(t, [c])[0] for c in grid]
    assert [g[0] for g in got] == grid and np.allclose([g[1:] for g in got], [o[1:] for o in one_by_one])
    t.close()


def test_odd_tables(spark):
    """No rows, one row, missing features and labels, a constant column."""
    schema = "k long, y double, " + ", ".join(f"{c} double" for c in COLUMNS)
    for rows in ([], [(1, 2.0, 0.0, None, float("nan"), 1.0, 1.0)], [(1, None, *[0.0] * 5)], [(i, 1.0, *[0.5] * 5) for i in range(9)]):
        df = spark.createDataFrame(rows, schema)
        t = boosting.BinnedTable(df, COLUMNS, "y", [F.lit(1)], ["k"])
        (model,), _ = t.fit([(Boosting(rounds=2), 0, ())])
        found = [r["prediction"] for r in boosting.predict(model, t.cuts, df, COLUMNS, ["k"]).collect()]
        assert len(found) == len(rows) and np.allclose(found, rows[0][1] or 0.0 if rows else 0.0)
        t.close()


def test_models_side_by_side_sum_few_rows_and_equal_single_ones(spark, monkeypatch):
    """Models of the same samples share them, only smaller children are summed and exclusive flags make one column: the trees are
    those of fits one by one over rows, from less than half the values a level of all rows and columns has."""
    x, y = table(500)
    flags = (np.arange(500)[:, None] % 12 == np.arange(12)).astype(float)
    values = np.hstack((x, flags))
    names = [f"c{i}" for i in range(values.shape[1])]
    df = spark.createDataFrame([(i, float(t), *map(float, v)) for i, (v, t) in enumerate(zip(values, y, strict=True))], "k long, y double, " + ", ".join(f"{c} double" for c in names))
    t = boosting.BinnedTable(df, names, "y", [F.when(F.col("k") % 5 < 4, 1).otherwise(2)], ["k"], bins=32)
    specs = [Boosting(rounds=3, depth=4, rows=0.7, columns=0.7, rate=r, l2=l2, l1=0.01) for r in (0.1, 0.4) for l2 in (1.0, 5.0)]
    single, scores = t.fit([(s, 0, (3,)) for s in specs], 0)
    blocks = [boosting._read_block(r.asDict()) for r in t.blocks.collect()]
    batch = boosting.Batch(blocks, specs, 0, t.means[0], t.offsets)
    assert len(batch.place) == 4 + 2 and len(batch.train) == 400  # the first flag of x and the twelve: two packs
    seen, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda v, *a, **k: (seen.append(len(v)), plain(v, *a, **k))[1])
    grown = [batch.grow(i) for i in range(3)]
    assert sum(seen) < len(specs) * 3 * 4 * (400 * 0.7) * int(17 * 0.7) * 2 / 2
    for k, model in enumerate(single):
        for mine, tree in zip(grown, model.trees, strict=True):
            assert (mine["feature"][k] == tree["feature"]).all() and (mine["bin"][k] == tree["bin"]).all()
            assert all(np.allclose(mine[c][k], tree[c]) for c in ("value", "gain", "rows"))
    assert all(np.allclose((e[0] / e[2], e[1] / e[2]), scores[k, 3]) for k, e in enumerate(batch.errors()))
    t.close()


def test_grids_are_dealt_in_batches_of_like_samples():
    from tidewick.operators import tuning

    todo = [boosting.Task(boosting.replace(c, rounds=700), fold, 0.5, (400, 700)) for c in tuning.candidates("xgb") if c.rounds == 400 for fold in range(3)]
    dealt = boosting.alike(todo, 8)
    assert len(todo) == 384 and len(dealt) == 48 and sorted(i for b in dealt for i in b) == list(range(384))
    assert all(len({(todo[i].fold, todo[i].spec.rows, todo[i].spec.columns, todo[i].spec.depth) for i in b}) == 1 for b in dealt)
