"""The pipeline's stages against brute force on a small table."""

import base64
import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import tiktoken

from tidewick.llm import toxicity
from tidewick.llm.queries import ORACLES, QUERIES

def brute(rows, k, num, den):
    """(id, shingles, smallest id of the component) by comparing all pairs of texts."""
    low = {i: i + 32 for i in range(65, 91)}
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for _, t in rows]
    sets = [frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset() for w in words]
    root = list(range(len(rows)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and den * len(x & y) >= num * len(x | y):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for a, (i, _) in enumerate(rows):
        least[root[a]] = min(i, least.get(root[a], i))
    return [(i, len(sets[a]), least[root[a]] if sets[a] else i) for a, (i, _) in enumerate(rows)]


def reference():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    item = text(30) + ". " + text(6)
    clean = [(i, text(80)) for i in range(30)]
    clean += [(200 + i, text(60)) for i in range(60)]
    learned = [(300 + i, f"{text(20)} grunlok {text(20)} grunlok {text(20)}") for i in range(60)]
    rows = [*clean, *learned, (100, clean[0][1]), (101, clean[1][1] + " tail"), (102, f"{text(50)} {item} {text(20)}"), (103, f"{text(5)} grunlok {text(40)}"), (104, text(30) + ' password = "abcdefghijklmnop" ' + text(5)), (105, None), (106, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*((i, 1, 1) for i, _ in learned), *((i, 1, 0) for i, _ in clean)], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, d)
        assert left.columns == docs.columns, name
    got = {r["doc_id"]: r for r in left.collect()}
    assert set(got) == {i for i, _ in clean} | {104, 105, 106}
    assert "[SECRET]" in got[104]["text"] and got[104]["n_chars"] == len(got[104]["text"])
    final = corpus_pipeline.run(spark, d)
    # The stages again, in plain Python.
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
    want = [(i, t) for i, t in rows if toxicity.Scorer(lexicon)(t or "")[0] < 0.7]
    kept = {i for i, _, c in brute(want, 5, 80, 100) if i == c}
    want = [(i, t) for i, t in want if i in kept and item not in (t or "")]
    _, encoding = reference()
    digests = {}
    for i, t in want:
        t = re.sub(r'password = "[A-Za-z]{12,}', "[SECRET]", t or "")
        ids = encoding.encode_ordinary(t)
        digests[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in final.collect()} == digests


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, clashing names, and no rows at all."""
    d = str(tmp_path)
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (2, ""), (None, "a null id has words"), (None, None), (3, long), (4, "plain words here"), (4, "plain words here"), (4, "other text of this id")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "b", "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, blob string, spans string")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for table in (docs, docs.where("false")):
        left = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, d)
            assert left.columns == docs.columns
        got = sorted(((r["doc_id"], len(r["text"] or "")) for r in left.collect()), key=str)
        kept = [(1, 0), (2, 0), (None, 19), (None, 0), (3, len(long)), (4, 16), (4, 21)]
        assert got == (sorted(kept, key=str) if table is docs else [])
        final = corpus_pipeline.STAGES[-1][1](spark, left, d)
        assert final.count() == len(got)


def test_each_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
