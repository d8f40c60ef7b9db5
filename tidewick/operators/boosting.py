"""Gradient-boosted trees for squared errors on binned features: Newton gains with L1 and L2 weights, rows and columns
sampled per tree, and many models at once.

Features are cut into quantile bins once. A level of all models' trees is one aggregation: every block of rows sums its
gradients and row counts by (model, node, feature bin), the sums meet by model, where the best split of each node is chosen,
and only splits come to the driver. Rows of a split go to its children by their bins, so no row ever moves. A table whose
bins are proven small is dealt by model instead: a task then grows whole models, those with the same samples side by side,
and chooses splits by the same function.

The trees of n rounds are the first n of a longer fit, so one fit is scored at every wanted number of trees.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import saved

#: Rows of a block, whose bins are one value.
BLOCK_ROWS = 1 << 15
#: Bytes of bins up to which a task grows whole models.
LOCAL_BYTES = 64 << 20
#: Models that a task grows side by side, and pairs of a model and a row whose sums are made at once.
BATCH, PAIRS = 8, 1 << 11
#: Bytes of bins that are dealt to more groups than four a core.
SPREAD_BYTES = 1 << 30
#: After so many rounds the margins of a distributed fit are written down.
CUT_ROUNDS = 25


@dataclass(frozen=True)
class Boosting:
    """rounds of trees of a depth, each added at a rate. l1, l2: weights on leaf values. child: least rows of a leaf.
    rows, columns: shares sampled for each tree. With l1 = l2 = 0 a leaf is the mean of its residuals, and the gain is the
    decrease of squared error."""

    rounds: int = 100
    rate: float = 0.1
    depth: int = 3
    l1: float = 0.0
    l2: float = 1.0
    child: int = 1
    rows: float = 1.0
    columns: float = 1.0
    least_gain: float = 1e-6
    seed: int = 17


@dataclass
class Model:
    """Split k of tree t sits at node[k] (children 2i + 1 and 2i + 2): rows whose bin of `feature` is at most `bin`, so values
    at most `cut`, go left. Leaves have feature -1 and a value."""

    spec: Boosting
    base: float
    trees: list[dict[str, np.ndarray]]


def cuts_of(df: DataFrame, columns: list[str], bins: int = 256, error: float = 0.001) -> list[np.ndarray]:
    """Upper borders of all bins but the last of each column: its quantiles below the greatest value, without repeats."""
    found = [np.array(q, dtype=np.float64) for q in df.approxQuantile(columns, [*(i / bins for i in range(1, bins)), 1.0], error)]
    return [np.unique(q[:-1][q[:-1] < q[-1]]) if len(q) else q for q in found]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of rows: how many borders a value is above; a missing value is in the first bin."""
    out = np.empty(values.shape, dtype=np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, np.nan_to_num(values[:, f], nan=-np.inf), side="left")
    return out


def _mixed(ids: np.ndarray, spec: Boosting, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row, the same wherever the row is."""
    x = ids ^ np.uint64(zlib.crc32(f"{spec.seed}:{tree}".encode()) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def _columns(spec: Boosting, tree: int, many: int) -> np.ndarray:
    n = max(1, int(spec.columns * many))
    return np.sort(np.random.default_rng((spec.seed, tree)).permutation(many)[:n])


def _spans(offsets: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Where the bins of the sampled columns begin, side by side, and how many there are."""
    return np.concatenate(([0], np.cumsum(offsets[columns + 1] - offsets[columns])))


def histogram(place: np.ndarray, node: np.ndarray, grad: np.ndarray, nodes: int, width: int) -> np.ndarray:
    """Sums of gradients and counts of rows, by node of a level and bin: (2, nodes, width). place: each row's bins, side by side."""
    at = (place + (node * width)[:, None]).ravel()
    g = np.bincount(at, np.repeat(grad, place.shape[1]), nodes * width)
    return np.stack((g, np.bincount(at, minlength=nodes * width))).reshape(2, nodes, width)


def best_splits(sums: np.ndarray, offsets: np.ndarray, spec: Boosting, columns: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
    """For each node (feature, bin, gain, leaf value, rows, gradient): the split of greatest gain, feature -1 if none helps.

    Gains within a billionth of the greatest are equal; the first feature, then the first bin, is taken. Sums of the last
    level have totals only, (2, nodes, 1).
    """
    span = _spans(offsets, columns)
    whole = sums.shape[2] == 1
    total_g, total_n = sums[:, :, : 1 if whole else span[1]].sum(2)
    l1, l2, child, least = (np.full(len(total_g), x) for x in (spec.l1, spec.l2, max(spec.child, 1), spec.least_gain))
    leaf = _leaves(total_g, total_n, l1, l2)
    out = [(-1, 0, 0.0, float(v), float(n), float(g)) for v, n, g in zip(leaf, total_n, total_g, strict=True)]
    if whole or not total_n.any():
        return out
    at, gain, _, _ = _best(sums[0], sums[1], total_g, total_n, span, l1, l2, child, least)
    for i in np.flatnonzero(at >= 0):
        f = int(np.searchsorted(span, at[i], side="right")) - 1
        out[i] = (int(columns[f]), int(at[i] - span[f]), float(gain[i]), *out[i][3:])
    return out


def _soft(g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1.any() else g


def _leaves(g: np.ndarray, n: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    return -_soft(g, l1) / np.maximum(n + l2, 1e-300)


def _best(g: np.ndarray, n: np.ndarray, total_g: np.ndarray, total_n: np.ndarray, span: np.ndarray, l1: np.ndarray, l2: np.ndarray, child: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node the place of its best split among the bins side by side, or -1, its gain, and the gradient and rows that
    go left. g, n: sums by node and bin; the rest by node."""
    l1, l2, child, all_g, all_n = (x[:, None] for x in (l1, np.maximum(l2, 1e-300), child, total_g, total_n))
    of = np.repeat(np.arange(len(span) - 1), np.diff(span))

    def running(x):
        run = x.cumsum(1)
        return run - np.concatenate((np.zeros((len(x), 1)), run[:, span[1:-1] - 1]), 1).take(of, 1)

    g, n = running(g), running(n)
    other = all_n - n
    fits = (n >= child) & (other >= child)
    fits[:, span[1:] - 1] = False  # all of a feature's rows go left
    gain = _soft(g, l1) ** 2 / (n + l2) + _soft(all_g - g, l1) ** 2 / (other + l2)
    gain -= _soft(all_g, l1) ** 2 / (all_n + l2)
    gain[~fits] = -np.inf
    top, node = gain.max(1), np.arange(len(g))
    at = (gain >= (top - 1e-9 * np.abs(top))[:, None]).argmax(1)
    return np.where(top > least, at, -1), gain[node, at], g[node, at], n[node, at]


def _level(tree: dict[str, np.ndarray], splits: list[tuple], depth: int, spec: Boosting) -> None:
    """Writes a level's splits into a tree; nodes at the last level, and nodes without a gain, are leaves."""
    first = (1 << depth) - 1
    for k, (feature, cut, gain, leaf, rows, _) in enumerate(splits):
        i = first + k
        tree["rows"][i] = rows
        if feature >= 0 and depth < spec.depth:
            tree["feature"][i], tree["bin"][i], tree["gain"][i] = feature, cut, gain
        else:
            tree["value"][i] = spec.rate * leaf


def _empty_tree(depth: int) -> dict[str, np.ndarray]:
    n = (1 << (depth + 1)) - 1
    return {"feature": np.full(n, -1, np.int16), "bin": np.zeros(n, np.int16), "gain": np.zeros(n), "value": np.zeros(n), "rows": np.zeros(n)}


def descend(tree: dict[str, np.ndarray], bins: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row is in after so many levels; rows stop at leaves."""
    node = np.zeros(len(bins), dtype=np.int64)
    at = np.arange(len(bins))
    for _ in range(levels):
        f = tree["feature"][node]
        inner = f >= 0
        right = bins[at, np.maximum(f, 0)] > tree["bin"][node]
        node = np.where(inner, 2 * node + 1 + right, node)
    return node


def added(tree: dict[str, np.ndarray], bins: np.ndarray, depth: int) -> np.ndarray:
    return tree["value"][descend(tree, bins, depth)]


@dataclass
class Block:
    """Rows of the table: ids, labels, bins and, for each fold, the role (0 none, 1 train, 2 validation)."""

    ids: np.ndarray
    y: np.ndarray
    bins: np.ndarray
    role: np.ndarray


class Sampled:
    """A block's rows that a tree learns from, with the bins of the columns that it may split on, and the node each is in."""

    def __init__(self, b: Block, margin: np.ndarray, spec: Boosting, fold: int, t: int, offsets: np.ndarray) -> None:
        use = b.role[:, fold] == 1
        if spec.rows < 1:
            use &= _mixed(b.ids, spec, t) < spec.rows
        at = np.flatnonzero(use)
        columns = _columns(spec, t, len(offsets) - 1)
        span = _spans(offsets, columns)
        self.bins, self.grad, self.spec, self.span = b.bins[at], (margin - b.y)[at], spec, span
        # Columns of two bins need no histogram: what is in the second one is a product of matrices.
        self.two = np.flatnonzero(np.diff(span) == 2)
        wide = np.flatnonzero(np.diff(span) != 2)
        self.place = self.bins[:, columns[wide]] + span[wide]
        self.flags = self.bins[:, columns[self.two]].astype(np.float64)
        self.node = np.zeros(len(at), dtype=np.int64)

    def down(self, tree: dict[str, np.ndarray]) -> None:
        """Rows in a node that has been split go to its children."""
        f = tree["feature"][self.node]
        right = self.bins[np.arange(len(f)), np.maximum(f, 0)] > tree["bin"][self.node]
        self.node = np.where(f >= 0, 2 * self.node + 1 + right, self.node)

    def sums(self, tree: dict[str, np.ndarray], depth: int) -> np.ndarray:
        """histogram() of the rows that are in nodes of this level; of the last level totals only."""
        node, nodes = self.node - ((1 << depth) - 1), 1 << depth
        at = slice(None) if not depth else np.flatnonzero(node >= 0)
        node, grad = node[at], self.grad[at]
        total = np.stack((np.bincount(node, grad, nodes), np.bincount(node, minlength=nodes)))[:, :, None]
        if depth == self.spec.depth:
            return total
        sums = histogram(self.place[at], node, grad, nodes, int(self.span[-1]))
        member = (node == np.arange(nodes)[:, None]).astype(np.float64)
        second = np.stack((member * grad @ self.flags[at], member @ self.flags[at]))
        sums[:, :, self.span[self.two]], sums[:, :, self.span[self.two] + 1] = total - second, second
        return sums


def level_sums(b: Block, margin: np.ndarray, spec: Boosting, fold: int, t: int, tree: dict[str, np.ndarray], depth: int, offsets: np.ndarray) -> np.ndarray:
    """The sums of one level of a tree whose upper levels are known."""
    rows = Sampled(b, margin, spec, fold, t, offsets)
    for _ in range(depth):
        rows.down(tree)
    return rows.sums(tree, depth)


class Batch:
    """Models of a fold that see the same rows and columns in every round (alike()), grown side by side.

    Of two children only the smaller one's rows are summed; the other has what is left of their parent's sums. Columns of two
    bins are summed as one column where no row is in the second bin of more than one of them.
    """

    def __init__(self, blocks: list[Block], specs: list[Boosting], fold: int, base: float, offsets: np.ndarray) -> None:
        used = [np.flatnonzero(b.role[:, fold]) for b in blocks]
        self.ids, self.y, bins, role = (np.concatenate([getattr(b, c)[i] for b, i in zip(blocks, used, strict=True)]) for c in ("ids", "y", "bins", "role"))
        self.specs, self.offsets, self.bins = specs, offsets, np.ascontiguousarray(bins.T)
        self.train, self.scored = np.flatnonzero(role[:, fold] == 1), np.flatnonzero(role[:, fold] == 2)
        self.margin = np.full((len(specs), len(self.y)), base)
        self.rate, self.l1, self.l2, self.least = (np.array([getattr(s, c) for s in specs], dtype=np.float64) for c in ("rate", "l1", "l2", "least_gain"))
        self.child = np.array([max(s.child, 1) for s in specs])
        sums, self.at, self.held = [], {}, {}  # columns of sums; where a feature's bins are among them; in which column
        self.width = 0
        for f in np.flatnonzero(np.diff(offsets) != 2):
            size = int(offsets[f + 1] - offsets[f])
            self.at[f], self.held[f] = np.arange(self.width, self.width + size), len(sums)
            sums.append(self.bins[f].astype(np.int32) + self.width)
            self.width += size
        for pack in self._packs(np.flatnonzero(np.diff(offsets) == 2)):
            code = np.zeros(len(self.y), dtype=np.int32)
            for k, f in enumerate(pack, 1):
                code[self.bins[f] > 0] = k
                self.at[f], self.held[f] = np.array([self.width, self.width + k]), len(sums)
            sums.append(code + self.width)
            self.width += len(pack) + 1
        self.place = np.stack(sums)

    def _packs(self, two: np.ndarray) -> list[list[int]]:
        packs: list[tuple[np.ndarray, list[int]]] = []
        for f in two:
            flag = self.bins[f] > 0
            for taken, pack in packs:
                if not (taken & flag).any():
                    taken |= flag
                    pack.append(f)
                    break
            else:
                packs.append((flag, [f]))
        return [pack for _, pack in packs]

    def grow(self, t: int) -> dict[str, np.ndarray]:
        """Tree t of every model, (models, nodes); margins of all rows go on by it."""
        spec, models, rows = self.specs[0], len(self.specs), self.train
        if spec.rows < 1:
            rows = rows[_mixed(self.ids[rows], spec, t) < spec.rows]
        columns = _columns(spec, t, len(self.offsets) - 1)
        span = _spans(self.offsets, columns)
        take = np.concatenate([self.at[f] for f in columns])
        first = span[:-1][np.diff(span) == 2]  # first bins of columns of two: what isn't in the second
        place = self.place[np.ix_(np.unique([self.held[f] for f in columns]), rows)]
        grad = self.margin[:, rows] - self.y[rows]
        one = _empty_tree(spec.depth)
        trees = {c: np.tile(x, (models, 1)) for c, x in one.items()}
        node, size, m = np.zeros((models, len(self.y)), dtype=np.int64), len(one["value"]), np.arange(models)[:, None]
        sums, flat, at_row = self._root(place, grad), self.bins.ravel(), np.arange(len(self.y))
        total_g, total_n = grad.sum(1)[:, None], np.full((models, 1), float(len(rows)))
        for depth in range(spec.depth + 1):
            nodes, here = 1 << depth, slice((1 << depth) - 1, (2 << depth) - 1)
            by_node = [np.repeat(x, nodes) for x in (self.l1, self.l2, self.child, self.least)]
            leaf = _leaves(total_g.ravel(), total_n.ravel(), *by_node[:2]).reshape(models, nodes)
            trees["rows"][:, here] = total_n
            split = np.zeros((models, nodes), dtype=bool)
            if depth < spec.depth:
                g, n = sums.reshape(2, models * nodes, -1).take(take, 2)
                for x, total in ((g, total_g), (n, total_n)):
                    x[:, first] = total.reshape(-1, 1) - x[:, first + 1]
                at, gain, left_g, left_n = (x.reshape(models, nodes) for x in _best(g, n, total_g.ravel(), total_n.ravel(), span, *by_node))
                split = at >= 0
                f = np.searchsorted(span, at, side="right") - 1
                trees["feature"][:, here] = np.where(split, columns[f], -1)
                trees["bin"][:, here] = np.where(split, at - span[f], 0)
                trees["gain"][:, here] = np.where(split, gain, 0.0)
            trees["value"][:, here] = np.where(split, 0.0, self.rate[:, None] * leaf)
            if not split.any():
                break
            key, inner = node + m * size, trees["feature"].ravel() >= 0
            begin, cut = np.maximum(trees["feature"].ravel(), 0) * np.int64(len(self.y)), trees["bin"].ravel().astype(np.uint8)
            right = flat.take(begin.take(key) + at_row) > cut.take(key)
            node = np.where(inner.take(key), 2 * node + 1 + right, node)
            left_g, left_n = np.where(split, left_g, 0.0), np.where(split, left_n, 0.0)
            right_g, right_n = np.where(split, total_g - left_g, 0.0), np.where(split, total_n - left_n, 0.0)
            if depth + 1 < spec.depth:
                sums = self._children(sums, place, grad, node[:, rows] - ((2 << depth) - 1), left_n <= right_n, split)
            total_g, total_n = (np.stack(x, 2).reshape(models, 2 * nodes) for x in ((left_g, right_g), (left_n, right_n)))
        self.margin += trees["value"].ravel().take(node + m * size)
        return trees

    def _root(self, place: np.ndarray, grad: np.ndarray) -> np.ndarray:
        """Sums of gradients and rows of all sampled rows, (2, models, 1, width)."""
        out = np.zeros((2, len(grad), 1, self.width))
        for a in range(0, place.shape[1], PAIRS):
            part = place[:, a : a + PAIRS].astype(np.int64)
            out[1] += np.bincount(part.ravel(), minlength=self.width)
            for k, x in enumerate(grad[:, a : a + PAIRS]):
                out[0, k, 0] += np.bincount(part.ravel(), np.broadcast_to(x, part.shape).ravel(), self.width)
        return out

    def _children(self, sums: np.ndarray, place: np.ndarray, grad: np.ndarray, node: np.ndarray, left: np.ndarray, split: np.ndarray) -> np.ndarray:
        """Sums of the next level, (2, models, nodes, width). node: where rows are in it, below 0 in leaves above; left: whether
        the left child of each node is the smaller one; split: whether it has children."""
        models, parents = left.shape
        small = np.stack((left, ~left), 2).reshape(models, 2 * parents)
        k, r = np.nonzero((node >= 0) & small[np.arange(models)[:, None], np.maximum(node, 0)])
        slot, weight = (k * parents + node[k, r] // 2) * self.width, grad[k, r]
        less = np.zeros((2, models * parents * self.width))
        for a in range(0, len(k), PAIRS):
            at = place[:, r[a : a + PAIRS]] + slot[a : a + PAIRS]
            less[0] += np.bincount(at.ravel(), np.broadcast_to(weight[a : a + PAIRS], at.shape).ravel(), less.shape[1])
            less[1] += np.bincount(at.ravel(), minlength=less.shape[1])
        less = less.reshape(2, models, parents, self.width)
        more, left = sums - less, left[None, :, :, None]
        more[:, ~split] = 0.0
        return np.stack((np.where(left, less, more), np.where(left, more, less)), 3).reshape(2, models, 2 * parents, self.width)

    def errors(self) -> list[tuple[float, float, int]]:
        """errors() of each model's forecasts of the fold's rows to score."""
        return [errors(self.y[self.scored], x[self.scored]) for x in self.margin]


def alike(todo: list[Task], most: int) -> list[list[int]]:
    """Places of tasks whose models Batch grows together, up to so many."""
    found: dict[tuple, list[list[int]]] = {}
    for i, t in enumerate(todo):
        s = t.spec
        lists = found.setdefault((t.fold, t.base, t.stages, s.rounds, s.depth, s.seed, s.rows, s.columns, s.l1 > 0), [[]])
        if len(lists[-1]) == most:
            lists.append([])
        lists[-1].append(i)
    return [x for lists in found.values() for x in lists]


# --- Spark ---

_BLOCK = "block long, n long, ids binary, y binary, bins binary, role binary"
_SPLITS = "model int, splits binary"
FLOOR = 1e-12


def _to_blocks(cuts: list[np.ndarray], folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, y, role 0..., feature 0...) as blocks."""
        for k, table in enumerate(_tables(batches)):
            columns = [table.column(i).to_numpy(zero_copy_only=False) for i in range(table.num_columns)]
            values = np.stack(columns[2 + folds :], 1).astype(np.float64)
            role = np.stack(columns[2 : 2 + folds], 1).astype(np.uint8)
            parts = (columns[0].astype(np.int64).view(np.uint64), columns[1].astype(np.float64), binned(values, cuts), role)
            yield pa.record_batch([pa.array([k], pa.int64()), pa.array([table.num_rows], pa.int64()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts)], names=["block", "n", "ids", "y", "bins", "role"])

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _read_block(row: dict) -> Block:
    n = row["n"]
    one = lambda c, kind: np.frombuffer(row[c], kind)
    return Block(one("ids", np.uint64), one("y", np.float64), one("bins", np.uint8).reshape(n, -1), one("role", np.uint8).reshape(n, -1))


def errors(y: np.ndarray, pred: np.ndarray) -> tuple[float, float, int]:
    """Sums of relative and absolute errors of forecasts of at least 1e-12, and rows."""
    off = np.abs(y - np.maximum(pred, FLOOR))
    return float((off / np.maximum(np.abs(y), FLOOR)).sum()), float(off.sum()), len(y)


def _pack_tree(trees: list[dict[str, np.ndarray]]) -> bytes:
    return b"".join(t[c].astype(np.float64).tobytes() for t in trees for c in ("feature", "bin", "gain", "value", "rows"))


def _unpack_trees(blob: bytes, depth: int) -> list[dict[str, np.ndarray]]:
    n = (1 << (depth + 1)) - 1
    a = np.frombuffer(blob, np.float64).reshape(-1, 5, n)
    return [{"feature": t[0].astype(np.int16), "bin": t[1].astype(np.int16), "gain": t[2].copy(), "value": t[3].copy(), "rows": t[4].copy()} for t in a]


@dataclass
class Task:
    """A model to grow: its specification and fold, the mean label of that fold's training rows, and the rounds to score."""

    spec: Boosting
    fold: int
    base: float
    stages: tuple[int, ...]


class BinnedTable:
    """Rows of a data set as blocks of bins. Close it when its models are grown."""

    def __init__(self, df: DataFrame, columns: list[str], label: str, roles: list[Column], key: list[str], cuts: list[np.ndarray] | None = None, bins: int = 256) -> None:
        """roles: for each fold 1 on rows to fit and 2 on rows to score, else 0. key: columns that tell rows apart."""
        self.columns, self.folds = columns, len(roles)
        rows = df.select(F.xxhash64(*key).alias("id"), F.col(label).cast("double").alias("y"), *(r.cast("int").alias(f"role_{i}") for i, r in enumerate(roles)), *(F.col(c).cast("double").alias(f"f_{i}") for i, c in enumerate(columns)))
        rows = rows.where("y is not null")
        self.cuts = cuts_of(df, columns, bins) if cuts is None else cuts
        self.offsets = np.concatenate(([0], np.cumsum([len(c) + 1 for c in self.cuts]))).astype(np.int64)
        self.blocks = rows.mapInArrow(_to_blocks(self.cuts, self.folds), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
        found = rows.agg(*(F.avg(F.when(F.col(f"role_{i}") == 1, F.col("y"))) for i in range(self.folds)), F.count(F.lit(1))).first()
        self.means, self.rows = [float(m or 0.0) for m in found[: self.folds]], found[self.folds]

    def close(self) -> None:
        self.blocks.unpersist()

    def fit(self, tasks: list[tuple[Boosting, int, tuple[int, ...]]], local_bytes: int = LOCAL_BYTES, keep: bool = True) -> tuple[list[Model], dict[tuple[int, int], tuple[float, float]]]:
        """Grows a model for each (specification, fold, rounds to score), and gives (mape, mae) of the fold's validation rows
        by (task, rounds). Without `keep`, models that single tasks grow have no trees: only their errors come back."""
        todo = [Task(s, fold, self.means[fold], tuple(stages)) for s, fold, stages in tasks]
        if not self.rows:
            return [Model(t.spec, t.base, []) for t in todo], {}
        small = self.rows * (len(self.columns) + 16) <= local_bytes
        return self._by_model(todo, keep) if small else self._by_rows(todo)

    def _by_model(self, todo: list[Task], keep: bool) -> tuple[list[Model], dict[tuple[int, int], tuple[float, float]]]:
        """Blocks go to every group of models, which one task grows."""
        spark, offsets, size = self.blocks.sparkSession, self.offsets, self.rows * (len(self.columns) + 16)
        cores = max(1, spark.sparkContext.defaultParallelism)
        batches = alike(todo, max(1, min(BATCH, len(todo) // (4 * cores), BLOCK_ROWS // self.rows)))
        groups = min(len(batches), max(4 * cores, SPREAD_BYTES // size))

        def grow(key, table):
            group = key[0].as_py()
            blocks = [_read_block(r) for r in table.sort_by([("part", "ascending"), ("block", "ascending")]).to_pylist()]
            out = []
            for members in batches[group::groups]:
                task = todo[members[0]]
                batch = Batch(blocks, [todo[m].spec for m in members], task.fold, task.base, offsets)
                trees, scores = [[] for _ in members], [[] for _ in members]
                for t in range(task.spec.rounds):
                    grown = batch.grow(t)
                    if keep:
                        for k, mine in enumerate(trees):
                            mine.append({c: x[k] for c, x in grown.items()})
                    if t + 1 in task.stages:
                        for mine, found in zip(scores, batch.errors(), strict=True):
                            mine.append((t + 1, *found))
                out += [{"model": m, "trees": _pack_tree(mine), "rounds": [s[0] for s in score], "mape": [s[1] for s in score], "mae": [s[2] for s in score], "n": [s[3] for s in score]} for m, mine, score in zip(members, trees, scores, strict=True)]
            return pa.Table.from_pylist(out, schema)

        schema = pa.schema([("model", pa.int32()), ("trees", pa.binary()), ("rounds", pa.list_(pa.int32())), ("mape", pa.list_(pa.float64())), ("mae", pa.list_(pa.float64())), ("n", pa.list_(pa.int64()))])
        dealt = self.blocks.select(F.spark_partition_id().alias("part"), "*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        found = dealt.repartition(4 * groups, "group").groupBy("group").applyInArrow(grow, "model int, trees binary, rounds array<int>, mape array<double>, mae array<double>, n array<long>")
        models, scores = [None] * len(todo), {}
        for r in found.collect():  # a row a model
            models[r["model"]] = Model(todo[r["model"]].spec, todo[r["model"]].base, _unpack_trees(r["trees"], todo[r["model"]].spec.depth))
            scores |= {(r["model"], k): (a / n, b / n) for k, a, b, n in zip(r["rounds"], r["mape"], r["mae"], r["n"], strict=True) if n}
        return models, scores

    def _by_rows(self, todo: list[Task]) -> tuple[list[Model], dict[tuple[int, int], tuple[float, float]]]:
        """All models grow level by level; blocks add up, and a task a model chooses its splits."""
        models = [Model(t.spec, t.base, []) for t in todo]
        scores: dict[tuple[int, int], tuple[float, float]] = {}
        state = self.blocks.select(F.spark_partition_id().alias("part"), "*", F.lit(None).cast("binary").alias("margins"))
        since = 0
        for t in range(max(task.spec.rounds for task in todo)):
            live = [m for m, task in enumerate(todo) if t < task.spec.rounds]
            for m in live:
                models[m].trees.append(_empty_tree(todo[m].spec.depth))
            grown = {m: models[m].trees[since:t] for m in range(len(todo))}
            open_nodes = list(live)
            for depth in range(max(todo[m].spec.depth for m in live) + 1):
                open_nodes = [m for m in open_nodes if depth <= todo[m].spec.depth]
                if not open_nodes:
                    break
                now = {m: models[m].trees[t] for m in open_nodes}
                found = state.mapInArrow(_sum_level(todo, grown, now, t, depth, self.offsets), "model int, sums binary").groupBy("model").applyInArrow(_choose(todo, t, depth, self.offsets), _SPLITS)
                still = []
                for r in found.collect():  # a level's splits of each model
                    splits = [(int(s[0]), int(s[1]), *map(float, s[2:])) for s in np.frombuffer(r["splits"]).reshape(-1, 6)]
                    _level(now[r["model"]], splits, depth, todo[r["model"]].spec)
                    if any(s[0] >= 0 for s in splits):
                        still.append(r["model"])
                open_nodes = still
            grown = {m: models[m].trees[since : t + 1] for m in range(len(todo))}
            scored = [m for m in live if t + 1 in todo[m].stages]
            if scored:
                rows = state.mapInArrow(_score_level(todo, grown, scored), "model int, mape double, mae double, n long").groupBy("model").agg(F.sum("mape"), F.sum("mae"), F.sum("n")).collect()
                scores |= {(r[0], t + 1): (r[1] / r[3], r[2] / r[3]) for r in rows if r[3]}
            if t + 1 - since == CUT_ROUNDS:
                state, since = saved(state.mapInArrow(_write_margins(todo, grown), "part int, " + _BLOCK + ", margins binary"), "margins"), t + 1
        return models, scores


def _margins(row: dict, block: Block, todo: list[Task], grown: dict[int, list[dict]], m: int) -> np.ndarray:
    n = len(block.y)
    base = np.full(n, todo[m].base) if row["margins"] is None else np.frombuffer(row["margins"]).reshape(len(todo), n)[m].copy()
    for tree in grown[m]:
        base += added(tree, block.bins, todo[m].spec.depth)
    return base


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, _read_block(row)


def _sum_level(todo, grown, now, t: int, depth: int, offsets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for row, block in _each(batches):
            for m, tree in now.items():
                s = level_sums(block, _margins(row, block, todo, grown, m), todo[m].spec, todo[m].fold, t, tree, depth, offsets)
                total[m] = total[m] + s if m in total else s
        for m, s in total.items():
            yield pa.record_batch([pa.array([m], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["model", "sums"])

    return run


def _choose(todo, t: int, depth: int, offsets: np.ndarray):
    def run(key, table):
        m = key[0].as_py()
        total = None
        for s in table["sums"].to_pylist():
            a = np.frombuffer(s).reshape(2, 1 << depth, -1)
            total = a.copy() if total is None else total + a
        splits = best_splits(total, offsets, todo[m].spec, _columns(todo[m].spec, t, len(offsets) - 1))
        return pa.table([pa.array([m], pa.int32()), pa.array([np.array(splits, dtype=np.float64).tobytes()], pa.binary())], names=["model", "splits"])

    return run


def _score_level(todo, grown, scored: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _each(batches):
            rows = []
            for m in scored:
                v = block.role[:, todo[m].fold] == 2
                rows.append((m, *errors(block.y[v], _margins(row, block, todo, grown, m)[v])))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["model", "mape", "mae", "n"])

    return run


def _write_margins(todo, grown):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _each(batches):
            margins = np.stack([_margins(row, block, todo, grown, m) for m in range(len(todo))])
            names = ["part", "block", "n", "ids", "y", "bins", "role"]
            yield pa.record_batch([pa.array([row["part"]], pa.int32()), *(pa.array([row[c]], pa.int64()) for c in names[1:3]), *(pa.array([row[c]], pa.binary()) for c in names[3:]), pa.array([margins.tobytes()], pa.binary())], names=[*names, "margins"])

    return run


def predict(model: Model, cuts: list[np.ndarray], df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., prediction) of the rows; a missing feature counts as below all borders."""
    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", prediction double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(columns))], 1)
            bins, out = binned(values, cuts), np.full(batch.num_rows, model.base)
            for tree in model.trees:
                out += added(tree, bins, model.spec.depth)
            yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), pa.array(out)], names=[*keep, "prediction"])

    return df.select(*keep, *(F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(columns))).mapInArrow(run, schema)


_NODE = "tree int, node int, feature string, bin int, cut double, gain double, value double, rows double"


def node_table(model: Model, cuts: list[np.ndarray], columns: list[str], df: DataFrame) -> DataFrame:
    """The nodes of a model that hold rows, (tree, node, feature, bin, cut, gain, value, rows); leaves have no feature."""
    rows = []
    for t, tree in enumerate(model.trees):
        for i in np.flatnonzero(tree["rows"] > 0):
            f, b = int(tree["feature"][i]), int(tree["bin"][i])
            where = (columns[f], b, float(cuts[f][b])) if f >= 0 else (None, None, None)
            rows.append((t, int(i), *where, float(tree["gain"][i]), float(tree["value"][i]), float(tree["rows"][i])))
    return df.sparkSession.createDataFrame(rows, _NODE)


def from_nodes(nodes: DataFrame, spec: Boosting, base: float, columns: list[str]) -> tuple[Model, list[np.ndarray]]:
    """The model of a node table, with the cuts that it uses: a model's trees are as many as its rounds, whatever the data."""
    rows = nodes.collect()
    cuts = [np.unique([r["cut"] for r in rows if r["feature"] == c]) for c in columns]
    trees = [_empty_tree(spec.depth) for _ in range(1 + max((r["tree"] for r in rows), default=-1))]
    for r in rows:
        tree, i = trees[r["tree"]], r["node"]
        tree["gain"][i], tree["value"][i], tree["rows"][i] = r["gain"], r["value"], r["rows"]
        if r["feature"] is not None:
            f = columns.index(r["feature"])
            tree["feature"][i], tree["bin"][i] = f, int(np.searchsorted(cuts[f], r["cut"]))
    return Model(spec, base, trees), cuts


def importances(model: Model, columns: list[str]) -> list[tuple[str, float, float, int, float]]:
    """(feature, gain, cover, splits, share): mean gain and mean rows of the splits on a feature, how many there are, and the
    feature's share of the total gain; features without a split have zeros."""
    gain, rows, n = (np.zeros(len(columns)) for _ in range(3))
    for tree in model.trees:
        inner = tree["feature"] >= 0
        f = tree["feature"][inner]
        np.add.at(gain, f, tree["gain"][inner])
        np.add.at(rows, f, tree["rows"][inner])
        np.add.at(n, f, 1)
    one, whole = np.maximum(n, 1), gain.sum() or 1.0
    return [(c, float(g / k), float(r / k), int(m), float(g / whole)) for c, g, r, k, m in zip(columns, gain, rows, one, n, strict=True)]


def grid_search(table: BinnedTable, candidates: list[Boosting]) -> list[tuple[Boosting, float, float]]:
    """(candidate, mape, mae), means over the folds; candidates that differ in rounds only come from one fit."""
    longest: dict[Boosting, list[int]] = {}
    for c in candidates:
        longest.setdefault(replace(c, rounds=0), []).append(c.rounds)
    tasks = [(replace(c, rounds=max(r)), fold, tuple(sorted(set(r)))) for c, r in longest.items() for fold in range(table.folds)]
    _, scores = table.fit(tasks, keep=False)
    at = {(replace(s, rounds=0), fold): i for i, (s, fold, _) in enumerate(tasks)}
    out = []
    for c in candidates:
        found = [scores[at[replace(c, rounds=0), fold], c.rounds] for fold in range(table.folds) if (at[replace(c, rounds=0), fold], c.rounds) in scores]
        if found:
            out.append((c, float(np.mean([m for m, _ in found])), float(np.mean([a for _, a in found]))))
    return out

