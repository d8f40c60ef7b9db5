"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

The test items are the indexed collection, every passage of the training documents is a query.
Impacts are divided by the score that an item gives itself, so a threshold of 0.6 asks for 60 % of
an item's weight. Postings are in blocks with the largest impact of each.

Most passages hold no item; for a whole slice of documents at once, an upper bound shows that. In
each item, the lightest terms that together weigh less than the threshold can't reach it alone: only
the others, its essential terms, are looked up, and what a passage lacks of them is out of reach.
The remaining passages go through block-max WAND, and its results through verification.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shingle_hashes, steps, word_hashes

RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


@dataclass(frozen=True)
class Bm25Params:
    """threshold: share of an item's own score; essential: share of its weight in essential terms, at least 1 - threshold;
    overlap: share of the shingles of question and of answer, see _Part, that must be in one span of a document; spread: words of
    a span, as a multiple of the item's; shard_bytes bounds the index that travels with tasks."""

    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.6
    essential: float = 0.75
    overlap: float = 0.5
    spread: float = 2.0
    answer_share: float = 0.3
    block: int = 32
    least_stride: int = 64
    shard_bytes: int = 16 << 20


class BlockMaxIndex:
    """Normalised impacts of items by term, in blocks of postings ordered by item."""

    def __init__(self, items: list[np.ndarray], terms: np.ndarray, idf: np.ndarray, mean_length: float, params: Bm25Params):
        self.params = params
        rows = []
        for i, words in enumerate(items):
            t, tf = np.unique(words, return_counts=True)
            w = idf[np.searchsorted(terms, t)] * tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * len(words) / mean_length))
            w = w / w.sum()
            light = np.argsort(w, kind="stable")
            essential = np.ones(len(w), dtype=bool)
            essential[light[np.cumsum(w[light]) < 1 - params.essential]] = False
            rows.append((t, np.full(len(t), i), w, essential))
        t, item, w, essential = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((item, t))
        self.vocabulary, first = np.unique(t[order], return_index=True)
        self.first = np.append(first, len(order))
        self.item, self.impact, self.essential = item[order].astype(np.int64), w[order], essential[order]
        self.reach = np.array([params.threshold - r[2][~r[3]].sum() for r in rows])  # what essential terms must bring
        self.lists = []
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            cuts = list(range(a, b, params.block))
            self.lists.append(
                (self.item[a:b].tolist(), self.impact[a:b].tolist(), float(self.impact[a:b].max()), [int(self.item[min(c + params.block, b) - 1]) for c in cuts], [float(self.impact[c : c + params.block].max()) for c in cuts])
            )
        keep = self.essential
        self.e_first = np.concatenate(([0], np.cumsum(keep)))[self.first]
        self.e_item, self.e_impact = self.item[keep], self.impact[keep]

    def terms_of(self, words: np.ndarray) -> np.ndarray:
        """Term number of each word hash, -1 outside the vocabulary."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items of at least the threshold for a query of distinct terms, by block-max WAND."""
        size = self.params.block
        lists = [self.lists[t] for t in terms]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        out = []
        eps = 1e-9

        def forward(k: int, item: int) -> None:
            """Moves list k to its first posting of `item` or later, by blocks first."""
            items, _, _, last, _ = lists[k]
            block = at[k] // size
            if last[block] < item:
                while block < len(last) and last[block] < item:
                    block += 1
                at[k] = block * size
            while at[k] < len(items) and items[at[k]] < item:
                at[k] += 1

        while True:
            live = [k for k in live if at[k] < len(lists[k][0])]
            live.sort(key=lambda k: lists[k][0][at[k]])
            bound, pivot = 0.0, -1
            for i, k in enumerate(live):
                bound += lists[k][2]
                if bound >= threshold - eps:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
                pivot += 1
            block_bound, edge = 0.0, None
            for k in live[: pivot + 1]:
                last = lists[k][3]
                block = at[k] // size
                while block < len(last) and last[block] < item:
                    block += 1
                if block < len(last):
                    block_bound += lists[k][4][block]
                    edge = last[block] if edge is None else min(edge, last[block])
            if block_bound < threshold - eps:
                # No item up to the nearest block end can reach it, nor before the next list begins.
                to = edge + 1
                if pivot + 1 < len(live):
                    to = min(to, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                to = max(to, item + 1)
                for k in live[: pivot + 1]:
                    forward(k, to)
            elif lists[live[0]][0][at[live[0]]] == item:
                total = 0.0
                for k in live[: pivot + 1]:
                    total += lists[k][1][at[k]]
                    at[k] += 1
                if total >= threshold - eps:
                    out.append((item, total))
            else:
                for k in live[:pivot]:
                    if lists[k][0][at[k]] < item:
                        forward(k, item)

    def windows(self, terms: np.ndarray, offsets: np.ndarray, stride: int) -> np.ndarray:
        """(text, window) rows in which the bound allows an item; window c covers the words of strides c and c + 1."""
        at = np.flatnonzero(terms >= 0)
        text = np.searchsorted(offsets, at, side="right") - 1
        chunk = (at - offsets[text]) // stride
        t = terms[at]
        n = self.e_first[t + 1] - self.e_first[t]
        has = n > 0
        at, text, chunk, t, n = at[has], text[has], chunk[has], t[has], n[has]
        if not len(at):
            return np.empty((0, 2), np.int64)
        row = np.repeat(np.arange(len(at)), n)
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.e_first[t], n)
        # A term that is repeated in a window adds to the bound again, which stays a bound.
        wide = int(chunk.max()) + 2
        many = len(self.reach)
        key = ((text[row] * wide + chunk[row]) * many + self.e_item[post]).astype(np.int64)
        key = np.concatenate((key, np.where(chunk[row] > 0, key - many, -1)))
        value = np.tile(self.e_impact[post], 2)
        value, key = value[key >= 0], key[key >= 0]
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        fits = np.add.reduceat(value, start) >= self.reach[key[start] % many] - 1e-9
        found = np.unique(key[start][fits] // many)
        return np.stack((found // wide, found % wide), axis=1)


def split_item(words: list[bytes], text: bytes, share: float) -> tuple[int, int]:
    """Words of the question and of the answer: the last sentence or line is the answer; of one sentence, its last `share`."""
    n = len(words)
    ends = [i + 1 for i, w in enumerate(words[:-1]) if w[-1:] in b".?!:"]
    lines = text.strip().rfind(b"\n")
    if lines > 0:
        ends.append(n - len(text.strip()[lines:].split()))
    cut = max((e for e in ends if 0 < e < n), default=0) or max(1, n - max(1, round(n * share)))
    return cut, n


class _Part:
    """The question's or the answer's 3-word shingles; of a part with fewer than 8 words, the words."""

    def __init__(self, words: np.ndarray) -> None:
        self.k = 3 if len(words) >= 8 else 1
        self.own = np.unique(shingle_hashes(words, np.array([0, len(words)]), self.k)[0]) if len(words) else np.empty(0, np.uint64)

    def found(self, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in a passage shingles of the part begin, and which ones they are."""
        there = shingle_hashes(passage, np.array([0, len(passage)]), self.k)[0] if len(passage) >= self.k else np.empty(0, np.uint64)
        which = np.minimum(np.searchsorted(self.own, there), max(0, len(self.own) - 1))
        at = np.flatnonzero(self.own[which] == there) if len(self.own) else np.empty(0, np.int64)
        return at, which[at]

    def share(self, at: np.ndarray, which: np.ndarray, first: int, last: int) -> float:
        """Share of the shingles that lie in words [first, last); 1 for a part without words."""
        return len(np.unique(which[(at >= first) & (at + self.k <= last)])) / len(self.own) if len(self.own) else 1.0


def span_overlap(item: np.ndarray, cut: int, passage: np.ndarray, p: Bm25Params) -> tuple[float, float]:
    """(question overlap, answer overlap) in the best span of a passage: as many words as `spread` times the item's, 16 more
    than it has at least. The best span has the greatest lesser overlap, then the greatest sum."""
    span = max(int(p.spread * len(item)), len(item) + 16)
    question, answer = _Part(item[:cut]), _Part(item[cut:])
    q, r = question.found(passage), answer.found(passage)
    whole = question.share(*q, 0, len(passage)), answer.share(*r, 0, len(passage))
    if len(passage) <= span or min(whole) < p.overlap:
        return whole
    best = (0.0, 0.0)
    for first in np.unique(np.concatenate((q[0], r[0]))).tolist():
        here = question.share(*q, first, first + span), answer.share(*r, first, first + span)
        best = max(best, here, key=lambda x: (min(x), sum(x)))
    return best


@dataclass
class ItemClass:
    """Items of similar length: their index, ids, words, ends of questions, and the stride of the windows that they are sought in."""

    index: BlockMaxIndex
    ids: list[int]
    words: list[np.ndarray]
    cuts: list[int]
    stride: int


def _held(classes: list[ItemClass], texts: list[bytes]) -> dict[tuple[int, int], tuple]:
    """(score, question overlap, answer overlap) by (text, item id) that a passage holds."""
    hashes, off = word_hashes(texts)
    best: dict[tuple[int, int], tuple] = {}  # an item may have several texts
    for c in classes:
        terms, p, stride = c.index.terms_of(hashes), c.index.params, c.stride
        for i, w in c.index.windows(terms, off, stride).tolist():
            a, b = off[i] + w * stride, min(off[i + 1], off[i] + (w + 2) * stride)
            here = terms[a:b]
            for item, score in c.index.search(np.unique(here[here >= 0]).tolist(), p.threshold):
                # An item at the window's edge may go on beyond it.
                q, r = span_overlap(c.words[item], c.cuts[item], hashes[max(off[i], a - stride) : min(off[i + 1], b + stride)], p)
                if q >= p.overlap and r >= p.overlap:
                    best[i, c.ids[item]] = max(best.get((i, c.ids[item]), (0.0, 0.0, 0.0)), (score, q, r))
    return best


def _search(classes: list[ItemClass]):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            doc_ids = batch.column(0).to_pylist()
            rows = [(doc_ids[i], item, *v) for (i, item), v in sorted(_held(classes, texts).items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def leaks(docs: DataFrame, items: DataFrame, params: Bm25Params = Bm25Params()) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every item that a passage of a document holds.

    docs (doc_id, text), items (item_id, text); other columns are ignored. Items are searched by length class: passages are
    windows of two strides, a stride apart, and a class's stride is the power of two, least_stride at least, that none of
    its items is longer than; so an item's passages follow its own length, whatever other items there are. Question and
    answer have to overlap with one span of `spread` times the item's words. Texts are read whole, in steps of bounded size.
    score is the best passage's BM25 as a share of the item's own; values that equal a bound count as reached. Null, empty
    and blank texts hold and are nothing. Repeated documents each give their rows; items with a null id are ignored,
    repeated ones count once, and of one with several texts the best match counts. No items or no documents give no rows.

    The index of up to shard_bytes of item text travels with the tasks; a larger benchmark is searched in shards of that
    size, one after the other, each with all documents and with word statistics of the whole. No shuffle of documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards, each = _shards(items, params)
    out = spark.createDataFrame([], RESULT)
    for shard in each:
        found = rows.mapInArrow(_search(shard), RESULT)
        if shards == 1:
            return found
        out = out.unionByName(cut(found, "leaks"))  # the driver holds one shard at a time
    return out


def without_leaks(docs: DataFrame, items: DataFrame, params: Bm25Params = Bm25Params()) -> DataFrame:
    """The rows of docs that hold no item, with all their columns: a pass for each shard of items.

    Null and empty texts stay; repeated rows stay or go together; without items all rows stay.
    """
    shards, each = _shards(items, params)
    for classes in each:

        def run(batches: Iterator[pa.RecordBatch], classes=classes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(batch.schema.get_field_index("text"))], names=["doc_id", "text"])
                clean, at = np.ones(batch.num_rows, dtype=bool), 0
                for part, texts in steps(iter([column])):
                    clean[[at + i for i, _ in _held(classes, texts)]] = False
                    at += part.num_rows
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if shards > 1:
            docs = cut(docs, "no-leaks")
    return docs


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, words) for each distinct word of each item, and (null, words) for the item itself."""
    for batch in batches:
        for part, texts in steps(iter([batch])):
            hashes, off = word_hashes(texts)
            terms = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(off[:-1], off[1:], strict=True)]
            n = np.diff(off)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(np.concatenate(terms)), pa.nulls(len(n), pa.int64())]), pa.array(np.concatenate((np.repeat(n, [len(t) for t in terms]), n)))], names=["term", "words"])


def _shards(items: DataFrame, params: Bm25Params) -> tuple[int, Iterator[tuple]]:
    """The number of shards, and the length classes of each in turn.

    Word statistics are counted by Spark; a shard's items and the counts of its words, in proportion to shard_bytes, come
    to the driver.
    """
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and trim(text) <> ''").distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // params.shard_bytes))
    terms = tests.select("item_id", "text").mapInArrow(_item_words, "term long, words long")
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("words").alias("words"))
    if shards > 1:
        counts = cut(counts, "item-words")
    whole = counts.where("term is null and words > 0").first()

    def each() -> Iterator[tuple]:
        for k in range(shards if whole else 0):
            mine = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
            part = sorted((r["item_id"], r["text"]) for r in mine.collect())
            hashes, off = word_hashes([t.encode() for _, t in part])
            words = [hashes[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
            keep = [i for i, w in enumerate(words) if len(w)]
            part, words = [part[i] for i in keep], [words[i] for i in keep]
            if not part:
                continue
            own = mine.mapInArrow(_item_words, "term long, words long").where("term is not null").select("term").distinct()
            df = counts.where("term is not null").join(own, "term").select("term", "df").toPandas()
            found = df["term"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(found)
            n = df["df"].to_numpy(np.float64)[order]
            idf = np.log1p((whole["df"] - n + 0.5) / (n + 0.5))
            strides = [max(params.least_stride, 1 << (len(w) - 1).bit_length()) for w in words]
            classes = []
            for stride in sorted(set(strides)):
                at = [i for i, s in enumerate(strides) if s == stride]
                own_words = [words[i] for i in at]
                cuts = [split_item(part[i][1].encode().split(), part[i][1].encode(), params.answer_share)[0] for i in at]
                classes.append(ItemClass(BlockMaxIndex(own_words, found[order], idf, whole["words"] / whole["df"], params), [part[i][0] for i in at], own_words, cuts, stride))
            yield classes

    return shards, each()
