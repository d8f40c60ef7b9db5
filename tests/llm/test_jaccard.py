import random
import re

import pytest

from tidewick.llm.graph import components
from tidewick.llm.jaccard import link_components, one_of_each

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, num, den):
    """Link components over all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        r = root(a)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, len(x), least[root(a)] if x else i) for a, (i, x) in enumerate(sets)), key=str)


def run(spark, rows, **kw):
    return sorted((tuple(r) for r in link_components(spark.createDataFrame(rows, SCHEMA), **kw).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def family(rng, base, n, most, start):
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(40)}"
        rows.append((start + i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "num", "small_list", "seed"), [(3, 90, 8, 1), (5, 80, 6, 3), (1, 70, 10_000, 4)])
def test_families_equal_brute_force(spark, k, num, small_list, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(200)}" for _ in range(70)]
    other = base[:60] + [f"v{i}" for i in range(10)]
    rows = family(rng, base, 50, 5, 0) + family(rng, other, 30, 4, 1000)
    rows += [(2000 + i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rows += [(3000 + i, rows[i][1].upper()) for i in range(20)]
    rng.shuffle(rows)
    assert run(spark, rows, k=k, num=num, den=100, small_list=small_list) == brute(rows, k, num, 100)


def test_variants_of_variants_equal_brute_force(spark):
    """Families whose classes are mostly not linked with a centre: differences go through several levels."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for v in range(4):
        mid = list(base)
        for _ in range(3 + v):
            mid[rng.randrange(60)] = f"v{v}"
        for s in range(12):
            w = list(mid)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(60)] = f"e{rng.randrange(4)}"
            rows.append((v * 100 + s, " ".join(w)))
    for num, k in ((80, 2),):
        assert run(spark, rows, k=k, num=num, small_list=3) == brute(rows, k, num, 100)


def fringed(rng, n, most):
    """A large family: half of its texts have few edits, half up to `most`; edits take one of few words, so they are shared."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(1, 3) if i % 2 else rng.randint(4, most)):
            p, u = rng.randrange(len(w)), rng.random()
            if u < 0.15:
                del w[p]
            elif u < 0.2:
                w.insert(p, f"e{rng.randrange(4)}")
            else:
                w[p] = f"e{rng.randrange(4)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "num", "seed"), [(3, 90, 41), (5, 80, 42)])
def test_large_family_equals_brute_force_in_few_levels(spark, monkeypatch, k, num, seed):
    """Texts at the border of a family don't take a level for each few of them."""
    import tidewick.llm.jaccard as j

    levels = []
    write = j.cut
    monkeypatch.setattr(j, "cut", lambda df, name, by=None: levels.append(name) or write(df, name, by))
    rows = fringed(random.Random(seed), 240, 14)
    assert run(spark, rows, k=k, num=num, small_list=8) == brute(rows, k, num, 100)
    assert sum(x.startswith("lists-") for x in levels) <= 2


def test_differences_from_what_most_have(spark):
    """A pivot that lacks what nearly all have gives way to a nearer one, and no token is a difference of more than half."""
    import tidewick.llm.jaccard as j

    few = list(range(10, 40))
    sets = {1: few[3:], 2: few + [50], 3: few + [51], 4: few + [52, 53, 54], 5: few[1:] + [55]}
    sy = spark.createDataFrame([(y, len(v), v) for y, v in sets.items()], "y long, ny long, ky array<long>")
    first = [(x, 1, len(v), len(sets[1]), [t for t in v if t not in sets[1]], [t for t in sets[1] if t not in v], len(v), len(sets[1]), True) for x, v in sets.items() if x != 1]
    df = spark.createDataFrame(first, "x long, y long, nx long, ny long, plus array<long>, minus array<long>, sx int, sy int, same boolean")
    (got,) = j._centres(df, sy).collect()
    assert (got["of"], got["c"], sorted(got["km"])) == (1, 2, few)


def test_finer_ranges_by_several_exchanges(spark, monkeypatch):
    import tidewick.llm.jaccard as j

    rng = random.Random(22)
    base = [f"w{rng.randrange(200)}" for _ in range(70)]
    rows = family(rng, base, 40, 5, 0) + [(2000 + i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    monkeypatch.setattr(j, "FAN_OUT", 3)
    monkeypatch.setattr(j, "SPLIT_BYTES", 500)
    monkeypatch.setattr(j, "ranges_for", lambda docs: 20)
    assert run(spark, rows) == brute(rows, 3, 90, 100)


def test_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (4, ""), (5, "x y z u v w")]
    df = spark.createDataFrame([(*r, n, "k") for n, r in enumerate(rows)], "doc_id long, text string, said int, kept string")
    got = one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, rows[1][1], 1, "k"), (None, rows[3][1], 3, "k"), (2, None, 4, "k"), (4, "", 5, "k"), (5, rows[6][1], 6, "k")], key=str)
    assert one_of_each(df.where("false")).count() == 0


def test_nulls_short_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (5, "one two"), (None, "one two"), (6, "one"), (7, "a b c d"), (None, "x y z w"), (8, "É b c"), (9, "é b c")]
    assert run(spark, rows) == brute(rows, 3, 90, 100)


def test_empty_and_extra_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b c", "q", 1), (2, "a b c", "r", 2)], "doc_id long, text string, digest string, n int")
    assert sorted(tuple(r) for r in link_components(df).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_long_text_is_cut_at_blanks(spark, monkeypatch):
    import tidewick.llm.common as c

    text = " ".join(f"word{i}" for i in range(400))
    whole, off = c.word_hashes([b"a b", text.encode(), b""])
    monkeypatch.setattr(c, "STEP_BYTES", 64)
    pieces, off2 = c.word_hashes([b"a b", text.encode(), b""])
    assert off.tolist() == off2.tolist() == [0, 2, 402, 402]
    assert whole.tolist() == pieces.tolist()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(50)] + [(5, 5), (None, 3), (1000, 2000)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0}
    assert {got[2000 + i] for i in range(50)} == {got[1000]} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
