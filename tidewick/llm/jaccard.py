"""N-gram Jaccard self-join with adaptive multi-match prefixes, reported as link components.

1. Each text becomes a set of shingle hashes; equal sets form one class (a digest of the set).
2. Shingles are gathered by hash range, packed per block of documents. Only those in two or
   more different classes go on; a class keeps them ordered by (class frequency, hash), and the
   rest of its set only as a number, which takes the first places of that order.
3. Each class chooses how many prefix tokens a partner must share (1 to 3): a longer prefix costs
   more postings but fewer verifications; frequencies of its tokens give the estimate. Classes x
   and y are candidates if they share min(l_x, l_y) prefix tokens.
4. A posting list of up to `small_list` classes gives its pairs. In a longer one each class is first
   compared with one pivot of its rarest such list. What these links connect is a family, and the
   pivot with most of them its centre p. A list whose classes are in one family by now is done. For
   a pair of classes x, y of any other list,
       |x & y| = |p| - |p-x| - |p-y| + s,   s = tokens in which both differ from p,
   so a class outside the family can only link with classes that share enough of its differences
   from p: these are indexed by prefix in turn, only as far as they can still reach the bound, and a
   list pairs the classes outside the family, which ask, with those that answer. Tokens that p has
   and x lost are lost by a share of a large family, so their lists are long. But x and y share at
   most the lesser number of them, so unless y is shorter than p by more than x is from a link with
   p, they share tokens that p lacks, which few have: those that answer are dealt by how much
   shorter they are, and x asks each such band only for what a partner there must share. A list with
   many of both gets a pivot, the least of its classes, and differences from it, where pairing
   it would take more than `pairs_a_row` times the rows of the level: pivots grow from level to level, so this ends.
5. Verified links, and the families in between, go to connected components.

No pair of different components is lost: the filters are bounds, and there is no cap on lists or partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, mix64, pack, ranges_for, release, runs_of, shingle_hashes, steps, unpack, word_hashes
from .graph import components

_OUT = "r int, doc_ids binary, digests binary, keys binary, owner binary"
_PACKED = pa.schema([("r", pa.int32()), *((c, pa.binary()) for c in ("doc_ids", "digests", "keys", "owner"))])
#: Hash ranges that one exchange deals to at most; more are made in several exchanges, so blobs stay in proportion to the input.
FAN_OUT = 512
#: Bytes of packed shingles that are merged before they are dealt to finer ranges.
SPLIT_BYTES = 24 << 20
#: Differences from a pivot that a pair must share, at most, before it is verified.
MATCHES = 8


def set_digest(keys: np.ndarray) -> int:
    """64-bit digest of a set of hashes."""
    return int(mix64(mix64(keys).sum(keepdims=True) + np.uint64(len(keys)))[0])


def _blocks(k: int, ranges: int):
    """Packs the shingles of blocks of documents by hash range; r = -1 carries the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            words, off = word_hashes(texts)
            sh, so = shingle_hashes(words, off, k)
            sets, digests, sizes = [], [], []
            first: dict[int, int] = {}
            for i in range(len(texts)):
                s = np.sort(sh[so[i] : so[i + 1]])
                if len(s):
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
                d = set_digest(s)
                digests.append(d)
                sizes.append(len(s))
                if len(s) and d not in first:
                    first[d] = len(sets)
                    sets.append(s)
            ids = batch.column(0).to_pylist()
            known = np.array([x is not None for x in ids], dtype=np.uint8)
            rows = [(-1, pack(np.array([x or 0 for x in ids], dtype=np.int64)), pack(np.array(digests, dtype=np.uint64)), pack(np.array(sizes, dtype=np.uint32)), pack(known))]
            if sets:
                keys = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
                order = np.argsort(keys)
                rows += _dealt(np.array(list(first), dtype=np.uint64), keys[order], owner[order], 0, ranges, ranges)
            yield _packed(rows)

    return run


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _dealt(names: np.ndarray, keys: np.ndarray, owner: np.ndarray, first: int, last: int, ranges: int) -> list[tuple]:
    """Rows of sorted keys by hash range first..last - 1 of all ranges, each with the names of its owners only."""
    rows = []
    edge = np.searchsorted(keys, _limits(ranges)[first : last + 1])
    if last == ranges:
        edge[-1] = len(keys)
    for r, a, b in zip(range(first, last), edge[:-1], edge[1:], strict=True):
        if b > a:
            here = owner[a:b]
            present = np.zeros(len(names), dtype=bool)
            present[here] = True
            at = np.cumsum(present) - 1
            rows.append((r, None, pack(names[present]), pack(keys[a:b]), pack(at[here].astype(np.uint16 if len(names) < 65536 else np.uint32))))
    return rows


def _split(many: int, into: int):
    """Deals each of `many` hash ranges to `into` finer ones; blobs are merged first, so that their number follows the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] < 0:
                    yield _packed([row])
                    continue
                held.setdefault(row[0], []).append(row)
                size += sum(len(x) for x in row[2:])
                if size >= SPLIT_BYTES:
                    yield from dealt(held)
                    held, size = {}, 0
        yield from dealt(held)

    def dealt(held: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
        for r, rows in held.items():
            names, keys, owner = _unpacked(*zip(*(x[2:] for x in rows), strict=True))
            names, same = np.unique(names, return_inverse=True)
            owner = same[owner]
            order = np.argsort(keys)
            yield _packed(_dealt(names, keys[order], owner[order], r * into, (r + 1) * into, many * into))

    return run


def _unpacked(digests, keys, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, keys and each key's owner as an index into the names, of several blobs together."""
    names = [unpack(x) for x in digests]
    base = np.cumsum([0, *map(len, names)])
    return np.concatenate(names), np.concatenate([unpack(x) for x in keys]), np.concatenate([unpack(x).astype(np.int64) + b for x, b in zip(owner, base[:-1], strict=True)])


def _limits(ranges: int) -> np.ndarray:
    """Borders of equal hash ranges; the last one is past every hash but the largest."""
    return np.array([min(((1 << 64) * r) // ranges, (1 << 64) - 1) for r in range(ranges + 1)], dtype=np.uint64)


def _merge(buckets: int):
    """Of each hash range, the shingles in two or more classes, packed by buckets of classes with their class counts."""
    schema = pa.schema([("bucket", pa.int32()), ("owner", pa.binary()), ("keys", pa.binary()), ("df", pa.binary()), ("digest", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, table in runs_of(batches, "r"):
            if r == -1:
                for ids, dg, n, known in zip(*(table.column(c).to_pylist() for c in ("doc_ids", "digests", "keys", "owner")), strict=True):
                    ids, known = unpack(ids), unpack(known)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int32()), *(pa.nulls(len(ids), pa.binary()) for _ in range(3)), pa.array(unpack(dg).view(np.int64)), pa.array(ids, mask=known == 0), pa.array(unpack(n).astype(np.int64))], schema=schema)
                continue
            names, keys, owner = _unpacked(*(table.column(c).to_pylist() for c in ("digests", "keys", "owner")))
            owner = names[owner]
            order = np.argsort(keys)
            keys, owner = keys[order], owner[order]
            same = keys[1:] == keys[:-1]
            more = np.concatenate((same, [False])) | np.concatenate(([False], same))
            keys, owner = keys[more], owner[more]  # alone in the corpus: out
            if not len(keys):
                continue
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            one = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
            keys, owner = keys[one], owner[one]
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            df = np.diff(np.concatenate((start, [len(keys)])))
            df = np.repeat(df, df)
            keys, owner, df = keys[df > 1], owner[df > 1], df[df > 1].astype(np.uint32)
            if not len(keys):
                continue
            out = _by_bucket(owner, keys, df, buckets)
            m = len(out)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)), *(pa.nulls(m, pa.int64()) for _ in range(3))], schema=schema)

    return run


def _by_bucket(owner: np.ndarray, keys: np.ndarray, df: np.ndarray, buckets: int) -> list[tuple]:
    bucket = (owner % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((owner, bucket))
    keys, owner, df, bucket = keys[order], owner[order], df[order], bucket[order]
    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    return [(int(bucket[a]), pack(owner[a:b]), pack(keys[a:b]), pack(df[a:b])) for a, b in zip(start, [*start[1:], len(keys)], strict=True)]


def _split_buckets(buckets: int):
    """Deals rows of coarse buckets to finer ones, merged first."""
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("owner", "keys", "df"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                held.append(row)
                size += sum(map(len, row))
                if size >= SPLIT_BYTES:
                    yield dealt(held)
                    held, size = [], 0
        if held:
            yield dealt(held)

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        out = _by_bucket(*(np.concatenate([unpack(x) for x in c]) for c in zip(*held, strict=True)), buckets)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All shared shingles of each class of a bucket, in the order (class count, hash)."""
    schema = pa.schema([("digest", pa.int64()), ("keys", pa.list_(pa.int64())), ("df", pa.list_(pa.int32()))])
    for _, table in runs_of(batches, "bucket"):
        owner, keys, df = (np.concatenate([unpack(x) for x in table.column(c).to_pylist()]) for c in ("owner", "keys", "df"))
        order = np.lexsort((keys, df, owner))
        owner, keys, df = owner[order].view(np.int64), keys[order].view(np.int64), df[order].astype(np.int32)
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        for at in range(0, len(start), 2000):
            cuts = np.append(start[at : at + 2000], start[at + 2000] if at + 2000 < len(start) else len(owner))
            a, b = cuts[0], cuts[-1]
            off = pa.array((cuts - a).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(owner[cuts[:-1]]), pa.ListArray.from_arrays(off, pa.array(keys[a:b])), pa.ListArray.from_arrays(off, pa.array(df[a:b]))], schema=schema)


def _packed_shingles(docs: DataFrame, k: int, ranges: int) -> tuple[DataFrame, int]:
    """Packed shingles of docs by hash range, and the number of ranges: dealt in as many exchanges as the fan-out asks for."""
    many = min(ranges, FAN_OUT)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_blocks(k, many), _OUT)

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.repartition(n, F.when(F.col("r") < 0, F.xxhash64("digests") % n).otherwise(F.col("r"))).sortWithinPartitions("r")

    while many < ranges:
        into = min(FAN_OUT, -(-ranges // many))
        packed, many = dealt(packed, many).mapInArrow(_split(many, into), _OUT), many * into
    return dealt(packed, many), many


def link_components(docs: DataFrame, *, k: int = 3, num: int = 90, den: int = 100, max_match: int = 3, verify_cost: float = 4.0, small_list: int = 32, pairs_a_row: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text); other columns are ignored.

    Two documents link if den * |A & B| >= num * |A | B| over their sets of k-word shingles (A-Z lower-cased,
    words between ASCII white space; fewer than k words: the whole sequence is the one shingle). component_id is
    the smallest doc_id that links reach. Null and blank texts have no shingles and link with nothing: they are
    their own component. Repeated rows each give a row. A null doc_id gives a row, counts for links, and is a
    component_id only where no document of the component has an id. An empty table gives no rows. Texts of any
    length are read whole, in pieces. Similarities that equal the bound link.

    Shingles and sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    packed, ranges = _packed_shingles(docs, k, ranges_for(docs))
    buckets = min(ranges, FAN_OUT)
    merged = packed.mapInArrow(_merge(buckets), "bucket int, owner binary, keys binary, df binary, digest long, doc_id long, n long").withColumn("part", F.when(F.col("keys").isNull(), "documents").otherwise("shingles"))
    merged = cut(merged, "shared-shingles", by="part")
    del packed
    release(spark)
    rows = merged.where("part = 'documents'").select("doc_id", "digest", "n")
    classes = rows.where("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"))
    sets = merged.where("part = 'shingles'").select("bucket", "owner", "keys", "df")
    while buckets < ranges:
        sets, buckets = sets.repartition(buckets, "bucket").mapInArrow(_split_buckets(buckets * min(FAN_OUT, -(-ranges // buckets))), "bucket int, owner binary, keys binary, df binary"), buckets * min(FAN_OUT, -(-ranges // buckets))
    sets = sets.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_gather, "digest long, keys array<long>, df array<int>")
    # A class can only link if as many shingles are shared as the least possible partner needs.
    sets = cut(sets.join(classes.select("digest", "n"), "digest").where(F.size("keys") * den >= F.col("n") * num), "shingle-sets")
    drop_cut(merged, "part=shingles")
    release(spark)
    roots = _roots(sets, num, den, max_match, verify_cost, small_list, pairs_a_row)
    drop_cut(sets)
    joined = classes.join(roots.withColumnRenamed("node", "digest"), "digest")
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = joined.join(least, "root").select("digest", "component_id").unionByName(classes.join(roots, F.col("digest") == F.col("node"), "left_anti").select("digest", F.col("rep").alias("component_id")))
    out = rows.join(found, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stand for their component: those of its smallest doc_id, with all columns.

    Rows without a doc_id can't be named by a component and stay. Rows that repeat a kept id and text count as one,
    the one whose columns are least as JSON. Texts without words stay. Columns may have any names; no rows give none.
    """
    found = link_components(docs, k=k, num=num, den=den)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    # The row travels as one column, so names can't clash.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("said"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = rows.join(keep, F.col("id") == F.col("kept"), "left_semi").groupBy("id", "said").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return one.select("row").unionByName(rows.where("id is null").select("row")).select("row.*")


def _prefixes(sets: DataFrame, num: int, den: int, max_match: int, verify_cost: float) -> DataFrame:
    """Posting lists (list, x, n, need, at, u, probe, index) over the prefix tokens of each class."""
    eps = 1e-6
    # Place of the first indexed token, prefix length for one match, and the number of matches by estimated cost.
    base = sets.select("digest", "n", "keys", "df", (F.col("n") - F.size("keys")).cast("int").alias("u"), (F.col("n") - F.ceil(F.col("n") * num / den - eps) + 1).cast("int").alias("p"))
    width = lambda l: F.least(F.size("keys"), F.greatest(F.lit(0), F.col("p") + (l - 1) - F.col("u")))
    weight = [F.aggregate(F.slice("df", 1, width(m)), F.lit(0.0), lambda a, v: a + v) * (1 + verify_cost / m) for m in range(1, max_match + 1)]
    best = F.least(*weight)
    choice = F.lit(max_match)
    for m in range(max_match - 1, 0, -1):
        choice = F.when(weight[m - 1] == best, F.lit(m)).otherwise(choice)
    chosen = base.withColumn("l", choice).where(F.col("u") < F.col("p") + F.col("l") - 1)
    tokens = F.slice("keys", 1, F.least(F.size("keys"), F.col("p") + F.col("l") - 1 - F.col("u")))
    lists = chosen.select(F.posexplode(tokens).alias("i", "token"), F.col("digest").alias("x"), "n", "u", "l")
    return lists.select(F.xxhash64("token").alias("list"), "x", "n", F.col("l").cast("int").alias("need"), (F.col("i") + F.col("u")).cast("int").alias("at"), "u", F.lit(True).alias("probe"), F.lit(True).alias("index"))


def _roots(sets: DataFrame, num: int, den: int, max_match: int, verify_cost: float, small_list: int, pairs_a_row: int) -> DataFrame:
    """(node, root) of every class that has a link."""
    sx, sy = (sets.select(F.col("digest").alias(c), F.col("n").alias(f"n{c}"), F.col("keys").alias(f"k{c}")) for c in "xy")
    linked = F.col("inter") * (num + den) >= (F.col("nx") + F.col("ny")) * num

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.select("x", "y").join(sx, "x").join(sy, "y").withColumn("inter", F.size(F.array_intersect("kx", "ky")))
        return both.where(linked).select("x", "y")

    def rooted(df: DataFrame, column: str, name: str) -> DataFrame:
        if roots is None:
            return df.withColumn(name, F.col(column))
        return df.join(roots.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    def grown(links: DataFrame) -> DataFrame:
        new = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
        return components(new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    roots: DataFrame | None = None
    lists, level = _prefixes(sets, num, den, max_match, verify_cost), 0
    while True:
        lists = rooted(lists, "x", "root")
        # A list's pairs are those of a row that asks and one that answers: with few of either they are few a row.
        stats = lists.groupBy("list").agg(F.min(F.struct("u", "x")).alias("pivot"), F.min("root").alias("low"), F.max("root").alias("high"), F.least(F.count_if("probe"), F.count_if("index")).alias("c"), F.greatest(F.count_if("probe"), F.count_if("index")).alias("by"))
        stats = stats.where("c > 0 and low < high").select("list", "c", "by", F.col("pivot.x").alias("p"))
        held = cut(lists.join(stats, "list").select("list", "x", "n", "need", "at", "probe", "index", "root", "c", "by", "p"), f"lists-{level}")
        most = small_list if level == 0 else _longest(held, small_list, pairs_a_row)
        long = held.where(F.col("c") > most)
        found = verified(_pairs(held.where(F.col("c") <= most), num, den, level == 0)).withColumn("star", F.lit(False))
        if level == 0:
            first = long.where("x <> p").groupBy("x").agg(F.min_by("p", F.struct("at", "list")).alias("y"))
            found = found.unionByName(verified(first).withColumn("star", F.lit(True)))
        found = cut(found, f"links-{level}")
        if not found.isEmpty():
            roots = grown(found)
        near = rooted(rooted(long.select("x", "p").distinct(), "x", "rx"), "p", "rp")
        if level == 0:
            # One pivot for each family: that with most links of its own, for a list's pivot without any itself.
            centres = rooted(found.where("star").groupBy("y").count(), "y", "rp").groupBy("rp").agg(F.max_by("y", F.struct("count", "y")).alias("y"))
            near = near.select("x", "rx", "rp").distinct().join(centres, "rp", "left").select("x", "rx", "rp", F.coalesce("y", "rp").alias("y"))
        else:
            near = near.withColumnRenamed("p", "y")
        open_ = near.where("rx <> rp").select("y").distinct()
        near = near.join(open_, "y", "left_semi").where("x <> y").select("x", "y", (F.col("rx") == F.col("rp")).alias("same"))
        first = near.join(sx, "x").join(sy, "y").select("x", "y", "nx", "ny", F.array_except("kx", "ky").alias("plus"), F.array_except("ky", "kx").alias("minus"), F.size("kx").alias("sx"), F.size("ky").alias("sy"), "same")
        first = first.withColumn("inter", F.col("sx") - F.size("plus")).withColumn("new", linked & ~F.col("same")).withColumn("same", F.col("same") | linked)
        first = cut(first, f"pivots-{level}")
        drop_cut(held)
        if first.isEmpty():
            drop_cut(first)
            return roots if roots is not None else grown(found)
        centres = cut(_centres(first, sy), f"centres-{level}")
        both = first.select("x", F.col("y").alias("of"), "same").join(centres, "of").where("x <> c").join(sx, "x").join(sy.withColumnRenamed("y", "c"), "c")
        both = both.select("x", "of", F.col("c").alias("y"), "nx", "ny", "same", "km", F.array_except("kx", "ky").alias("plus"), F.array_except("ky", "kx").alias("minus"), F.array_except("kx", "km").alias("pm"), F.array_except("km", "kx").alias("mm"), F.size("kx").alias("sx"), F.size("ky").alias("sy"))
        both = both.withColumn("inter", F.col("sx") - F.size("plus")).withColumn("new", linked & ~F.col("same")).withColumn("same", F.col("same") | linked)
        far = (F.col("sx") - F.size("pm")) * (num + den) < (F.col("nx") + F.size("km")) * num
        pivot = F.struct("y", F.col("ny").alias("ny"), "sy", "plus", "minus", (~F.col("same") & ~far).alias("open"), "new")
        most = F.struct(F.xxhash64("of", F.lit("most")).alias("y"), F.size("km").cast("long").alias("ny"), F.size("km").alias("sy"), F.col("pm").alias("plus"), F.col("mm").alias("minus"), (~F.col("same") & far).alias("open"), F.lit(False).alias("new"))
        star = both.select("x", "nx", "sx", F.explode(F.array(pivot, most)).alias("to")).select("x", "nx", "sx", "to.*").withColumn("inter", F.col("sx") - F.size("plus"))
        star = cut(_differences(star, num, den), f"stars-{level}")
        more = first.where("new").select("x", "y").unionByName(star.where("new").select("x", "y"))
        if not more.isEmpty():
            roots = grown(more)
        drop_cut(first)
        drop_cut(centres)
        if star.where("asks > 0").isEmpty():
            drop_cut(star)
            return roots if roots is not None else grown(found)
        lists = _bands(star, num, den)
        level += 1


def _centres(first: DataFrame, sy: DataFrame) -> DataFrame:
    """For each pivot `of`: km, the tokens that most of its classes have, and c, that of its own component which is nearest to these.

    A pivot lacks some tokens that nearly all others have, which then are differences of all of these; from km no
    difference is one of more than half of them.
    """
    nothing = F.array().cast("array<long>")
    each = first.select("y", F.explode("plus").alias("token"), F.lit(True).alias("gained")).unionByName(first.select("y", F.explode("minus").alias("token"), F.lit(False).alias("gained")))
    common = each.groupBy("y", "gained", "token").count().join(first.groupBy("y").agg(F.count(F.lit(1)).alias("many")), "y").where("2 * count > many")
    common = common.groupBy("y").agg(F.collect_list(F.when(F.col("gained"), F.col("token"))).alias("gained"), F.collect_list(F.when(~F.col("gained"), F.col("token"))).alias("lost"))
    off = F.size("plus") + F.size("minus") - 2 * (F.size(F.array_intersect("plus", "gained")) + F.size(F.array_intersect("minus", "lost"))) + F.col("nx") - F.col("sx") - (F.col("ny") - F.col("sy"))
    nearer = first.where("same").join(common, "y").withColumn("off", off).where("off < 0").groupBy("y").agg(F.min_by("x", F.struct("off", "x")).alias("c"))
    found = first.select("y").distinct().join(sy, "y").join(common, "y", "left").join(nearer, "y", "left")
    return found.select(F.col("y").alias("of"), F.coalesce("c", "y").alias("c"), F.concat(F.array_except("ky", F.coalesce("lost", nothing)), F.coalesce("gained", nothing)).alias("km"))


def _longest(held: DataFrame, small_list: int, pairs_a_row: int) -> int:
    """The length up to which lists are paired: as long as all pairs of a level are in proportion to its rows."""
    sizes = held.groupBy("list", "c", "by").count().groupBy(F.floor(F.log2("c")).alias("power")).agg(F.sum(F.col("c") * F.col("by")).alias("pairs"), F.sum("count").alias("rows")).orderBy("power").collect()
    left, most = pairs_a_row * sum(r["rows"] for r in sizes), small_list
    for r in sizes:
        left -= r["pairs"]
        if left < 0:
            break
        most = max(most, (2 << r["power"]) - 1)
    return most


def _bands(star: DataFrame, num: int, den: int) -> DataFrame:
    """Posting lists of differences, by the pivot and how much shorter than it those that answer are: by 0, 1, 2 to 3, 4 to 7, ... tokens.

    A partner z that is shorter than y by at most d shares at least excess(x) - t d tokens with x that y lacks, as it
    shares at most min(|y - x|, |y - z|) of the others, where excess(x) = t (|x| + |y|) - |x & y| > 0. Up to MATCHES of them count.
    """
    t, eps = num / (num + den), 1e-6
    shorter = F.when(F.col("short") <= 0, F.lit(0)).otherwise(F.floor(F.log2(F.greatest(F.lit(1), "short"))) + 1).cast("int")
    star = star.withColumn("band", shorter)
    star = star.join(star.where("asks > 0").select("y").distinct(), "y", "left_semi")
    answers = star.where("answers > 0").select("y", F.col("band").alias("of"), "x", "n", F.lit(1).alias("need"), "u", F.posexplode(F.slice("tokens", 1, F.col("answers"))).alias("at", "token"), F.lit(False).alias("probe"), F.lit(True).alias("index"))
    bands = star.where("answers > 0").select("y", F.col("band").alias("of")).distinct()
    least = F.greatest(F.ceil(F.col("excess") - t * (F.pow(F.lit(2.0), F.col("of")) - 1) - eps), F.ceil((F.col("excess") - t * F.col("gone")) / (1 - t) - eps))
    asked = star.where("asks > 0").join(bands, "y").withColumn("least", least).withColumn("need", F.greatest(F.lit(1), F.least(F.lit(MATCHES), "least")).cast("int"))
    far = F.when(F.col("least") < 1, F.col("asks")).when(F.col("plus") < F.col("least"), F.lit(0)).otherwise(F.col("plus") - F.col("least") + F.col("need"))
    asked = asked.withColumn("asks", far.cast("int")).where("asks > 0")
    asked = asked.select("y", "of", "x", "n", "need", "u", F.posexplode(F.slice("tokens", 1, F.col("asks"))).alias("at", "token"), F.lit(True).alias("probe"), F.lit(False).alias("index"))
    return asked.unionByName(answers).select(F.xxhash64("y", "of", "token").alias("list"), "x", "n", "need", "at", "u", "probe", "index")


def _pairs(small: DataFrame, num: int, den: int, prefixes: bool) -> DataFrame:
    """Candidates (x, y) of different components that share enough lists; of prefix lists, the first shared place bounds the overlap."""
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("x", "n", "need", "at", "root")]
    pairs = small.where("probe").select("list", *side("a")).join(small.where("index").select("list", *side("b")), "list")
    pairs = pairs.where((F.col("x_a") < F.col("x_b") if prefixes else F.col("x_a") != F.col("x_b")) & (F.col("root_a") != F.col("root_b")) & (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num))
    if not prefixes:
        # By several pivots a pair is counted together, so that none is lost.
        pairs = pairs.groupBy("x_a", "x_b").agg(F.count(F.lit(1)).alias("c"), F.min("need_a").alias("need")).where("c >= need")
        return pairs.select(F.least("x_a", "x_b").alias("x"), F.greatest("x_a", "x_b").alias("y")).distinct()
    pairs = pairs.groupBy(F.col("x_a").alias("x"), F.col("x_b").alias("y")).agg(F.count(F.lit(1)).alias("c"), F.first(F.least("need_a", "need_b")).alias("need"), F.min("at_a").alias("i"), F.min("at_b").alias("j"), F.first("n_a").alias("nx"), F.first("n_b").alias("ny"))
    return pairs.where("c >= need").where(F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j")) * (num + den) >= (F.col("nx") + F.col("ny")) * num)


def _differences(star: DataFrame, num: int, den: int) -> DataFrame:
    """The tokens in which each class x differs from a set y, as far as links outside the pivot's component can depend on them.

    y is the pivot, or what most of its classes have; those that ask (open) are outside the component and would not link with y.

    In the order: tokens that the pivot lacks, rarest first, those that only the pivot has, commonest first, the
    pivot's unshared tokens as one. With t = num / (num + den), x and z link if they share
        s >= a(x) + a(z) of them,   a(x) = t |x| + |y - x| - |y| / 2.
    * A partner z that shares `plus` of the first kind and `minus` of the second has at least that many, so
      (1 - t) plus + t minus >= A(x) = t (|x| + |y|) + |y - x| - |y|: what is left behind a token in x's order must weigh as much.
    * One of the two asks and so would not link with y, so for the other s >= B(z) = t (|z| - |y|) + |y - z| + 1 / (num + den).
    asks tokens of a class outside the component are looked up; answers tokens of any class are found, with as many
    more of the first kind as let MATCHES shared ones be seen: before the last of them are MATCHES - 1 that weigh 1 - t at most.
    """
    t, eps = num / (num + den), 1e-6
    plus, gone, own = F.size("plus"), F.col("ny") - F.col("inter"), F.col("ny") - F.col("sy")
    whole = plus + gone
    a = t * (F.col("nx") + F.col("ny")) + gone - F.col("ny")
    b = t * (F.col("nx") - F.col("ny")) + gone + 1 / (num + den)
    reach = F.when(gone * t >= a - eps, F.floor(whole - a / t + eps) + 1).otherwise(F.floor(plus - (a - gone * t) / (1 - t) + eps) + 1)
    bound = lambda n: F.greatest(F.lit(0), F.least(whole, n)).cast("int")
    asks = F.when(F.col("open"), bound(reach)).otherwise(F.lit(0))
    answers = F.least(reach, F.floor(whole - b + eps) + 1)
    answers = F.when(answers < 1, F.lit(0)).otherwise(bound(F.greatest(answers, F.least(plus, answers + math.ceil((MATCHES - 1) * den / num)))))
    tokens = F.concat("plus", F.reverse("minus"), F.when(own > 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>")))
    d = star.select("x", "y", F.col("nx").alias("n"), (F.col("nx") - F.col("sx")).cast("int").alias("u"), "new", asks.alias("asks"), answers.cast("int").alias("answers"), plus.alias("plus"), gone.alias("gone"), a.alias("excess"), (F.col("ny") - F.col("nx")).alias("short"), tokens.alias("tokens"))
    # Of the first kind, those that ask may need more for MATCHES.
    return d.withColumn("tokens", F.slice("tokens", 1, F.greatest("asks", "answers", F.when(F.col("asks") > 0, F.col("plus")).otherwise(0))))
