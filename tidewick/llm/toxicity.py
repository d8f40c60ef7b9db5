"""Toxicity scores from a learned lexicon, matched with Levenshtein automata on a trie.

Lexicon: words, and stems with several forms, whose occurrences in labelled training texts are
significantly and almost only in toxic ones. An occurrence counts once for each preceding word,
so copies of one text don't make its words evidence.

Matching: the nodes of the lexicon's trie, each with the edits spent so far, are the states of a
nondeterministic automaton that accepts every word within the allowed distance of an entry. It is
determinised as words are read, and its transitions are kept, so a word costs a look-up per
letter until its state set is empty.

Scoring: each hit has the precision that its entry shows in training. A near miss has that of its own
form, smoothed by all near misses of its entry, and these by all of their kind, so harmless neighbours
of an entry weigh little. Different near misses add up; one that repeats counts once a text, by its
strongest hit. A window around the hit tells quotation (inside quote marks, after reporting words) from abuse.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_bytes

# Words before a reported term in English, German, French and Spanish, and quotation marks.
REPORTING = frozenset(
    "said says say quote quoted quotes quoting called calls wrote writes term word words cited "
    "sagt sagte schrieb schreibt nannte nennt wort worte zitat zitiert dit disait écrit écrivait appelle appelait mot mots cité "
    "dijo dice escribió escribe llamó llama palabra palabras término cita citó".split()
)
QUOTES = re.compile("[\"“”„«»‹›]")

TOKEN = re.compile(r"[^\W_]+")
PIECE = 1 << 20


@dataclass(frozen=True)
class ToxicityParams:
    """max_rows bounds the labelled rows that the lexicon is learned from; everything else covers all rows.

    Words of fewer than least_chars characters are not learned, of any greater length they are. A form that weighs less than
    least_weight is no hit, alone or with others.
    near_entry forms and near_form contexts are what the smoothing of near misses counts as; near_most is its highest weight, so
    one alone makes no text toxic. The three were set on a third of the training rows.
    """

    max_rows: int = 12_000
    min_contexts: int = 5
    purity: float = 0.98
    alpha: float = 0.01
    stem_lengths: tuple[int, ...] = (4, 5, 6, 7)
    stem_forms: int = 3
    fuzzy_from: int = 5
    fuzzy2_from: int = 9
    window: int = 60
    quoted: float = 0.25
    prior: float = 0.01
    threshold: float = 0.7
    near_entry: float = 2.0
    near_form: float = 2.0
    near_most: float = 0.5
    least_chars: int = 3
    least_weight: float = 0.02


@dataclass
class Lexicon:
    """Entries (text, is a stem, weight) and the weight of near misses by (is a stem, edits), by (entry, edits) and by form, the most special first."""

    entries: list[tuple[str, bool, float]]
    near: dict[tuple[bool, int], float] = field(default_factory=dict)
    params: ToxicityParams = field(default_factory=ToxicityParams)
    near_entries: dict[tuple[int, int], float] = field(default_factory=dict)
    near_forms: dict[str, float] = field(default_factory=dict)


class Matcher:
    """Trie of the lexicon, intersected with Levenshtein automata of growing words; deterministic states are made when first met."""

    def __init__(self, lexicon: Lexicon):
        p = lexicon.params
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.budget: list[int] = [0]
        self.entries = lexicon.entries
        self.near = lexicon.near
        self.near_entries = lexicon.near_entries
        self.near_forms = lexicon.near_forms
        for k, (text, stem, _) in enumerate(lexicon.entries):
            edits = (2 if len(text) >= p.fuzzy2_from else 1 if len(text) >= p.fuzzy_from else 0) - stem
            node = 0
            self.budget[0] = max(self.budget[0], edits)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], edits)
            self.ends[node] = k
        self.limit = [max(0, (2 if len(t) >= p.fuzzy2_from else 1 if len(t) >= p.fuzzy_from else 0) - s) for t, s, _ in lexicon.entries]
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})
        self.dead = self._state(set())

    def _state(self, items: set[tuple[int, int]]) -> int:
        """Number of the state set; nodes reached by dropping letters of the lexicon word join it, costlier twins go."""
        todo, low = list(items), {}
        while todo:
            node, e = todo.pop()
            if low.get(node, 99) <= e:
                continue
            low[node] = e
            if node >= 0 and e < self.budget[node]:
                todo += [(child, e + 1) for child in self.children[node].values() if e < self.budget[child]]
        # A stem that is complete stays so, whatever follows: negative nodes.
        for node, e in list(low.items()):
            k = self.ends[node] if node >= 0 else -1
            if k >= 0 and self.entries[k][1] and e <= self.limit[k]:
                low[-1 - k] = min(e, low.get(-1 - k, 99))
        key = frozenset(low.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if node < 0:
                out.add((node, e))
                continue
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, e))
            if e < self.budget[node]:
                out.add((node, e + 1))
                out.update((x, e + 1) for x in self.children[node].values() if e < self.budget[x])
        self.moves[state][c] = to = self._state(out)
        return to

    def within(self, word: str) -> dict[int, int]:
        """Edits by entry, of all entries within their distance."""
        state, moves, out = self.start, self.moves, {}
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == self.dead:
                return out
        for node, e in self.sets[state]:
            k = -1 - node if node < 0 else self.ends[node]
            if k >= 0 and e <= min(self.limit[k], out.get(k, 99)):
                out[k] = e
        if len(self.sets) > 200_000:  # keeps memory bounded
            self.ids.clear()
            self.sets.clear()
            self.moves.clear()
            self.start, self.dead = self._state({(0, 0)}), self._state(set())
        return out

    def __call__(self, word: str) -> tuple[float, int, int] | None:
        """(weight, entry, edits) of the best entry within its distance; None if there is none."""
        best, form = None, self.near_forms.get(word)
        for k, e in self.within(word).items():
            _, stem, weight = self.entries[k]
            if e:
                weight = min(weight, self.near_entries.get((k, e), self.near.get((stem, e), 0.0)) if form is None else form)
            if best is None or (weight, -e, -k) > (best[0], -best[2], -best[1]):
                best = (weight, k, e)
        return best


def pieces(text: str) -> Iterator[str]:
    """The whole text in pieces cut at blanks; a piece without any is longer."""
    at = 0
    while len(text) - at > PIECE:
        end = text.find(" ", at + PIECE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.match = Matcher(lexicon)
        self.params = lexicon.params
        self.clean: set[str] = set()
        self.found: dict[str, float] = {}
        self.exact: set[str] = set()

    def __call__(self, text: str) -> tuple[float, int, int]:
        """(score, hits, quoted hits) of a whole text."""
        rest, hits, quoted = 1.0 - self.params.prior, 0, 0
        near: dict[str, float] = {}
        for piece in pieces(text):
            low = piece.lower()
            words = set(TOKEN.findall(low))
            unknown = words - self.clean
            if not unknown:
                continue
            there = {}
            for w in unknown:
                weight = self.found.get(w)
                if weight is None:
                    m = self.match(w)
                    weight = m[0] if m else 0.0
                    if m and m[2] == 0:
                        self.exact.add(w)
                    if weight < self.params.least_weight:
                        self.clean.add(w)
                        continue
                    self.found[w] = weight
                there[w] = weight
            if len(self.clean) > 600_000:
                self.clean = set()
            if not there:
                continue
            for m in re.finditer(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(there, key=len, reverse=True))) + r")(?![^\W_])", low):
                a, b = m.span()
                weight = there[m[0]]
                hits += 1
                if self.is_quoted(low, a, b):
                    quoted += 1
                    weight *= self.params.quoted
                if m[0] in self.exact:
                    rest *= 1.0 - weight
                else:
                    near[m[0]] = max(near.get(m[0], 0.0), weight)
        return 1.0 - rest * math.prod(1.0 - w for w in near.values()), hits, quoted

    def is_quoted(self, low: str, a: int, b: int) -> bool:
        n = self.params.window
        before, after = low[max(0, a - n) : a], low[b : b + n]
        if len(QUOTES.findall(before)) % 2 and QUOTES.search(after):
            return True
        return not REPORTING.isdisjoint(TOKEN.findall(before)[-4:])


def _contexts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Distinct (word, word before, label) of a batch, for words of `least` characters or more."""
    for batch in batches:
        seen = set()
        for text, toxic in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = [w for piece in pieces(text.decode()) for w in TOKEN.findall(piece.lower())]
            seen.update((w, v, toxic) for v, w in zip(["", *words], words, strict=False) if len(w) >= least)
        rows = list(seen)
        for at in range(0, len(rows), 100_000):
            part = rows[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["word", "prev", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> Lexicon:
    """Lexicon from documents (doc_id, text) with labels (doc_id, toxic 0/1) outside the held-out third.

    Only rows whose crc32(doc_id as text) mod 3 is not 1 are read; of these at most about max_rows, chosen by a
    hash of doc_id. Repeated labels of a document count as toxic if one is. Null labels, ids and texts teach nothing;
    without labelled rows, or without toxic ones, the lexicon is empty and every text scores `prior`.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(crc_mod("doc_id", 3) != 1)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    part = min(1.0, params.max_rows / max(1, n))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000)) if part < 1 else usable
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rows rows of two numbers
    words = train.select("text", "toxic").mapInArrow(lambda b: _contexts(b, params.least_chars), "word string, prev string, toxic int").distinct()
    words = words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).persist()
    try:
        total = words.agg(F.sum("bad"), F.sum("good")).first()
        bad, good = (total[0] or 0), (total[1] or 0)
        if not bad:
            return Lexicon([], {}, params)
        rate = bad / (bad + good)
        stems = words.select(F.explode(F.array(*(F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in params.stem_lengths))).alias("word"), "bad", "good").where("word is not null")
        stems = stems.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum((F.col("bad") > 0).cast("int")).alias("forms")).where(f"forms >= {params.stem_forms}")
        both = words.select(F.lit(False).alias("stem"), "word", "bad", "good").unionByName(stems.select(F.lit(True).alias("stem"), "word", "bad", "good")).where(f"bad + good >= {params.min_contexts}").persist()
        tests = both.count()
        share = F.col("bad") / (F.col("bad") + F.col("good"))
        evidence = (F.col("bad") + F.col("good")) * (share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
        # A bound on the chance that any of the candidates is so one-sided by luck.
        found = both.where((share >= params.purity) & (evidence >= math.log(max(1, tests) / params.alpha))).collect()
        both.unpersist()
        weight = lambda b, g: (b + 1) / (b + g + 2)
        short: list[tuple[str, bool, float]] = []
        for r in sorted((r for r in found if r["stem"]), key=lambda r: (len(r["word"]), r["word"])):
            if not any(r["word"].startswith(s) for s, _, _ in short):
                short.append((r["word"], True, weight(r["bad"], r["good"])))
        plain = {r["word"]: weight(r["bad"], r["good"]) for r in found if not r["stem"]}
        lexicon = Lexicon([*short, *((w, False, x) for w, x in sorted(plain.items()) if not any(w.startswith(s) for s, _, _ in short))], {}, params)
        return _with_near_weights(words, lexicon)
    finally:
        words.unpersist()


def near_weights(lexicon: Lexicon, found: list[tuple[str, int, int, int, int]]) -> Lexicon:
    """The lexicon with near misses weighted by found: (form, entry, edits, bad, good contexts), each form at each entry that it misses."""
    p, kinds, entries = lexicon.params, {}, {}
    # A form counts once for its entries and kind, however frequent: a frequent harmless one says little of others.
    for form, k, e, b, g in found:
        kinds.setdefault((lexicon.entries[k][1], e), {})[form] = b / (b + g)
        entries.setdefault((k, e), []).append(b / (b + g))
    near = {kind: (sum(x.values()) + 0.5) / (len(x) + 1) for kind, x in kinds.items()}
    by_entry = {(k, e): (sum(x) + p.near_entry * near[lexicon.entries[k][1], e]) / (len(x) + p.near_entry) for (k, e), x in entries.items()}
    forms: dict[str, float] = {}
    for form, k, e, b, g in found:
        forms[form] = max(forms.get(form, 0.0), (b + p.near_form * by_entry[k, e]) / (b + g + p.near_form))
    near, by_entry, forms = ({x: min(w, p.near_most) for x, w in weights.items()} for weights in (near, by_entry, forms))
    return Lexicon(lexicon.entries, near, p, by_entry, forms)


def _with_near_weights(words: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Weighs near misses by the training words that are some; these are collected, and a small part of the words of max_rows rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(lexicon)
        for batch in batches:
            rows = []
            for w, b, g in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = match.within(w)
                if at and min(at.values()):
                    rows += [(w, k, e, b, g) for k, e in at.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["word", "entry", "edits", "bad", "good"])

    rows = words.select("word", "bad", "good").mapInArrow(run, "word string, entry int, edits int, bad long, good long").collect()
    return near_weights(lexicon, [tuple(r) for r in rows])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits, quoted) for every row of docs (doc_id, text).

    score is 0 to 1. A null or empty text has no hit and the score `prior`. predicted is 1 from the threshold up, equal
    to it included. A text over PIECE characters is read whole, in pieces cut at blanks; a quotation across a cut isn't seen.
    Repeated rows and null ids each give a row (a null id isn't held out); other columns are ignored; no rows give none.
    """
    threshold = lexicon.params.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            out = [scorer(t.decode()) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.float64()), pa.array([int(x[0] >= threshold) for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["doc_id", "held_out", "score", "predicted", "hits", "quoted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, hits long, quoted long")


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns, in one pass.

    Null and empty texts stay, rows without an id too; repeated rows stay or go together; a score equal to the threshold goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([scorer(t.decode())[0] < lexicon.params.threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
