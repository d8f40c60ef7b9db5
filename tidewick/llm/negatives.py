"""Hard-negative mining by inner product: ball trees over bounded parts of the rows, searched by branch and bound.

Rows of a label are dealt to parts of bounded size, and a part becomes one row that holds its ball tree. Anchors, in blocks,
visit the trees: a node with centre c and radius r holds no row whose inner product with anchor a is above a.c + |a| r or below
a.c - |a| r. It is passed over by the anchors for which this range lies outside the wanted scores, or whose worst kept row is
strictly better. Each tree gives its own best rows; a window over an anchor's rows then keeps the best of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

_LOW = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class MiningParams:
    """positives and negatives: how many of each are kept. low and high: a negative's score is between low and high
    percent of its positive's. tree_rows: rows of a tree at most, on average. block: anchors that visit a tree together.
    group: blocks that go with one copy of a tree. leaf: rows of a leaf at most. scale: a component x counts as
    floor(scale * x)."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    tree_rows: int = 4096
    block: int = 512
    group: int = 64
    leaf: int = 64
    scale: int = 256


@dataclass
class BallTree:
    """Rows (ids, labels, vectors) and nodes in preorder: a node's rows are [first, last), its right child is at `right` (0
    for a leaf), its left child follows it; pure nodes hold rows of one label, `label`."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    first: np.ndarray
    last: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    least_id: np.ndarray
    pure: np.ndarray
    label: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int) -> BallTree:
        """Splits at the median of the component that varies most; by place, so that equal vectors are split as well."""
        place = np.argsort(ids, kind="stable")
        points = vectors.astype(np.float64)
        nodes: list[list[int]] = []

        def grow(a: int, b: int) -> None:
            at = len(nodes)
            nodes.append([a, b, 0])
            if b - a <= leaf:
                return
            part = points[place[a:b]]
            axis = int(np.argmax(part.max(0) - part.min(0))) if part.shape[1] else 0
            if part.shape[1]:
                place[a:b] = place[a:b][np.argsort(part[:, axis], kind="stable")]
            middle = (a + b) // 2
            grow(a, middle)
            nodes[at][2] = len(nodes)
            grow(middle, b)

        grow(0, len(ids))
        first, last, right = np.array(nodes, dtype=np.int64).T
        ids, labels, vectors, points = ids[place], labels[place], vectors[place], points[place]
        centre = np.array([points[a:b].mean(0) for a, b in zip(first, last, strict=True)])
        radius = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(first, last, centre, strict=True)])
        pure = np.array([(labels[a:b] == labels[a]).all() for a, b in zip(first, last, strict=True)])
        return cls(ids, labels, vectors, first, last, right, centre, radius, np.array([ids[a:b].min() for a, b in zip(first, last, strict=True)]), pure, labels[first])

    def bundle(self) -> bytes:
        return bundle(*(getattr(self, f.name) for f in fields(self)))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node and anchor the least and greatest inner product, outwards by more than rounding can take away."""
        a = anchors.astype(np.float64)
        norm = np.sqrt((a * a).sum(1))
        middle = self.centre @ a.T
        reach = self.radius[:, None] * norm
        slack = 1e-9 * ((np.sqrt((self.centre**2).sum(1)) + self.radius)[:, None] * norm) + 1e-6
        return middle - reach - slack, middle + reach + slack


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows: in doubles where no sum can be rounded, else in integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**55:
        return a @ b.T
    raise ValueError("inner products, times 100, need more than 64 bits")


class Best:
    """The k best (score, id) of each of n queries: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.scores = np.full((n, k), _LOW, dtype=np.int64)
        self.ids = np.full((n, k), _LAST, dtype=np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> None:
        wanted &= scores >= self.scores[at, -1:]
        some = wanted.any(1)
        at, scores, wanted = at[some], scores[some], wanted[some]
        s = np.concatenate((self.scores[at], np.where(wanted, scores, _LOW)), axis=1)
        i = np.concatenate((self.ids[at], np.where(wanted, ids, _LAST)), axis=1)
        order = np.lexsort((i, ~s), axis=-1)[:, : self.scores.shape[1]]
        self.scores[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of what was found."""
        q, k = np.nonzero(self.ids != _LAST)
        return q, self.ids[q, k], self.scores[q, k]


@dataclass
class Queries:
    """Query q is of anchor of[q] (ids, labels, vectors) and wants rows with low[q] <= 100 * score <= high[q]."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray


def search(tree: BallTree, q: Queries, k: int, same: bool) -> Best:
    """The k best rows of the tree for each query: other rows of its anchor's label (same), or rows of another label."""
    best = Best(len(q.of), k)
    if not len(q.of) or not len(tree.ids):
        return best
    width = tree.centre.shape[1]  # beyond it, the tree's rows are zero
    least, most = tree.bounds(np.pad(q.vectors[:, :width], ((0, 0), (0, max(0, width - q.vectors.shape[1])))))

    def visit(node: int, active: np.ndarray) -> None:
        top, bottom = most[node, q.of[active]], least[node, q.of[active]]
        worst = best.scores[active, -1]
        # Strictly beneath the worst kept row, or as good at best and with greater ids only.
        worth = (top > worst) | (top == worst) & (tree.least_id[node] < best.ids[active, -1])
        worth &= (100 * top >= q.low[active]) & (100 * bottom <= q.high[active])
        if tree.pure[node]:
            worth &= (q.labels[q.of[active]] == tree.label[node]) == same
        active = active[worth]
        if not len(active):
            return
        if tree.right[node]:
            left, right = node + 1, int(tree.right[node])
            # The side that promises more goes first, so that the other is more often passed over.
            if most[right, q.of[active]].sum() > most[left, q.of[active]].sum():
                left, right = right, left
            visit(left, active)
            visit(right, active)
            return
        rows = slice(tree.first[node], tree.last[node])
        seen, place = np.unique(q.of[active], return_inverse=True)
        scores = inner(q.vectors[seen], tree.vectors[rows])[place]
        ids, of = tree.ids[rows][None, :], q.of[active]
        wanted = (100 * scores >= q.low[active, None]) & (100 * scores <= q.high[active, None])
        wanted &= (tree.labels[rows][None, :] == q.labels[of][:, None]) == same
        best.add(active, scores, ids, wanted & (ids != q.ids[of][:, None]))

    visit(0, np.arange(len(q.of)))
    return best


def bundle(*arrays: np.ndarray) -> bytes:
    """Arrays as one value; integers in the narrowest type that holds them."""
    out = []
    for a in arrays:
        if a.dtype == np.int64:
            most = max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))
            a = a.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)
        shape = np.array([*a.shape, -1][:2], np.int64)
        body = np.ascontiguousarray(a).tobytes()
        out.append(a.dtype.char.encode() + shape.tobytes() + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def unbundle(blob: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(blob):
        dtype, shape = np.dtype(chr(blob[at])), np.frombuffer(blob, np.int64, 2, at + 1)
        n = int.from_bytes(blob[at + 17 : at + 25], "little")
        a = np.frombuffer(blob, dtype, n // dtype.itemsize, at + 25).reshape(shape if shape[1] >= 0 else shape[:1])
        out.append(a.astype(np.int64) if dtype.kind == "i" else a)
        at += 25 + n
    return out


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * component); shorter ones end in zeros."""
    lens = np.array([len(x) for x in column], dtype=np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= 2**53:
        raise ValueError("a component is beyond exact integers")
    out = np.zeros((len(lens), int(lens.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lens[:, None]] = flat.astype(np.int64)
    return out


def _grow(p: MiningParams):
    """A group's rows (vec_id, label, embedding) as one tree."""

    def run(key, table):
        table = table.combine_chunks()
        tree = BallTree.build(table["vec_id"].to_numpy(), table["label"].to_numpy(), _matrix(_whole(table["embedding"]), p.scale), p.leaf)
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([tree.bundle()], pa.binary())], names=["pool", "part", "body"])

    return run


def _gather(p: MiningParams):
    """A group's anchors (vec_id, label, embedding, found) as one block; found are the positives, nulls before they are known."""

    def run(key, table):
        table = table.combine_chunks()
        found = table["found"].to_pylist()
        of = np.repeat(np.arange(len(found)), [len(f) for f in found])
        ids, scores = (np.array([x[c] for f in found for x in f], dtype=np.int64) for c in ("id", "score"))
        body = bundle(table["vec_id"].to_numpy(), table["label"].to_numpy(), _matrix(_whole(table["embedding"]), p.scale), of, ids, scores)
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([body], pa.binary())], names=["pool", "block", "body"])

    return run


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


_FOUND = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "id", "score")])


def _visit(p: MiningParams, same: bool):
    """Rows (visit, kind, body), sorted: of each visit first a tree, then the blocks of anchors that search it, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for kind, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == 0:
                    tree = BallTree(*unbundle(body))
                    continue
                ids, labels, vectors, of, positive, score = unbundle(body)
                if same:  # before there are positives: one query an anchor
                    of = np.arange(len(ids))
                    bounds = np.full(len(ids), _LOW), np.full(len(ids), _LAST)
                else:
                    bounds = p.low * score, p.high * score
                q, found, got = search(tree, Queries(ids, labels, vectors, of, *bounds), p.positives if same else p.negatives, same).rows()
                of_positive = (pa.nulls(len(q), pa.int64()),) * 2 if same else (positive[q], score[q])
                yield pa.record_batch([pa.array(x) for x in (ids[of[q]], *of_positive, found, got)], schema=_FOUND)

    return run


def known_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of rows whose id, label, vector and components are known and finite; one row an id, the least."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    d = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    d = d.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "embedding")).alias("x"))
    return d.select("vec_id", "x.label", "x.embedding")


def _meet(trees: DataFrame, blocks: DataFrame, p: MiningParams, same: bool) -> DataFrame:
    """Every block searches every tree of its pool; both tables have their pool's numbers of trees and blocks."""
    groups = F.greatest(F.lit(1), F.ceil(F.col("blocks") / p.group))
    name = lambda part, group: F.concat_ws(":", F.col("pool").cast("string"), part.cast("string"), group.cast("string")).alias("visit")
    # A tree goes to each group of blocks, a block to each tree.
    t = trees.select("pool", "part", "body", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("group"))
    b = blocks.select("pool", "body", F.pmod(F.col("block"), groups).alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("part"))
    rows = t.select(name(F.col("part"), F.col("group")), F.lit(0).alias("kind"), "body").unionByName(b.select(name(F.col("part"), F.col("group")), F.lit(1).alias("kind"), "body"))
    found = rows.repartition("visit").sortWithinPartitions("visit", "kind").mapInArrow(_visit(p, same), "anchor_id long, positive_id long, positive_score long, id long, score long")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (p.positives if same else p.negatives))


def mine(embeddings: DataFrame, is_anchor: Column, params: MiningParams = MiningParams()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of embeddings (vec_id, label, embedding).

    A score is the inner product of the vectors' floor(scale * component). An anchor's positives are its best other rows of
    the same label; each positive's negatives are the best rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score. Higher scores are better, of equal ones smaller ids; fewer rows than asked for
    are all kept, and a positive without negatives has no row. Rows with a null id, label, vector or component, or one that
    isn't finite, take no part; rows that share a vec_id are one, that of the least label, then vector. Vectors of different
    lengths are compared as if zeros followed. Extra columns are ignored, an empty table gives no rows. Components beyond
    2^53 after scaling, or products beyond 2^55, raise ValueError.
    """
    p = params
    rows = cut(known_rows(embeddings).withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "negatives-rows")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"))
    total = counts.agg(F.sum("n").alias("n"), F.sum("anchors").alias("anchors"), F.sum(F.when(F.col("n") < p.tree_rows, F.col("n"))).alias("small")).first()
    if not total["n"]:
        return embeddings.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # Labels with enough rows have trees of their own; the others share pools by hash.
    shared = max(1, -(-(total["small"] or 0) // p.tree_rows))
    pool = F.when(F.col("n") < p.tree_rows, F.pmod(F.xxhash64("label"), F.lit(shared)).cast("string")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    pools = counts.select("label", pool.alias("pool"), "n", "anchors")
    parts = pools.groupBy("pool").agg(F.sum("n").alias("n"), F.sum("anchors").alias("anchors"))
    parts = parts.select("pool", F.greatest(F.lit(1), F.ceil(F.col("n") / p.tree_rows)).alias("trees"), F.greatest(F.lit(1), F.ceil(F.col("anchors") / p.block)).alias("blocks"))
    places = cut(pools.select("label", "pool").join(parts, "pool"), "negatives-pools")
    parts = places.select("pool", "trees", "blocks").distinct()

    part = F.pmod(F.xxhash64("vec_id"), F.col("trees")).alias("part")
    own = rows.join(places, "label").select("pool", part, "vec_id", "label", "embedding").groupBy("pool", "part").applyInArrow(_grow(p), "pool string, part long, body binary")
    none = F.array().cast("array<struct<id:bigint,score:bigint>>").alias("found")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block")
    asking = rows.where("anchor").join(places, "label").select("pool", block, "vec_id", "label", "embedding", none).groupBy("pool", "block").applyInArrow(_gather(p), "pool string, block long, body binary")
    positives = _meet(own.join(parts, "pool"), asking.join(parts, "pool"), p, True).groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("found"))
    positives = cut(positives, "negatives-positives")

    # Against other labels, all rows are one pool of trees: their nodes tell which labels they hold.
    trees, blocks = -(-total["n"] // p.tree_rows), max(1, -(-total["anchors"] // p.block))
    one = F.lit("").alias("pool")
    others = rows.select(one, F.pmod(F.xxhash64("vec_id"), F.lit(trees)).alias("part"), "vec_id", "label", "embedding").groupBy("pool", "part").applyInArrow(_grow(p), "pool string, part long, body binary")
    asking = rows.where("anchor").join(positives, F.col("vec_id") == F.col("anchor_id")).select(one, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "label", "embedding", "found")
    asking = asking.groupBy("pool", "block").applyInArrow(_gather(p), "pool string, block long, body binary")
    numbers = {"trees": F.lit(trees).cast("long"), "blocks": F.lit(blocks).cast("long")}
    found = cut(_meet(others.withColumns(numbers), asking.withColumns(numbers), p, False), "negatives-found")
    for t in (rows, places, positives):
        drop_cut(t)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
