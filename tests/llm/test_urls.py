import random
import re

import pytest
from pyspark.sql import functions as F

from tidewick.llm import urls
from tidewick.llm.urls import Cascade, CascadeParams

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(url, rules, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fits = lambda h, p: ("." + host).endswith("." + h) and path.startswith(p)
    best = max(((len(h + (p or "")), v == "block", h + (p or "")) for h, p, v in rules if v in ("allow", "block") and h and fits(h, p or "")), default=None)
    key = max(((len(h + (p or "")), h + (p or "")) for h, p in listed if h and fits(h, p or "")), default=None)
    verdict = ("block" if best[1] else "allow") if best else "block" if key else "allow"
    return host, path, best and best[2], key and key[1], verdict


def made(seed):
    rng = random.Random(seed)
    label = lambda: rng.choice(["a", "b", "www", "é", "x-y"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4))) + rng.choice([".net", ".org"])
    path = lambda: rng.choice(["", "/", "/en/", "/en", "/en/x", "/de/a/b/", "//"])
    pages = [(i, f"{rng.choice(['http', ''])}://{host().upper() if i % 3 else host()}{path()}{rng.choice(['', '?q=/en/', '#x', 'tail'])}") for i in range(250)]
    pages += [(900, None), (901, ""), (902, "no scheme"), (903, "://"), (904, "http://?x://b.net/en/"), (None, "http://b.net/en/"), (905, "http://a.net\n/en/"), (1, pages[1][1]), (906, "http://a.net/en/" + "y" * 100_000), (907, "http://" + "a." * 2000 + "net/en/")]
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(25)] + [("net", "/", "block"), ("NET", "/en/", "allow"), ("org", None, "block"), ("b.org", "", None), (None, "/", "block"), ("a.net", "/en/x", "odd"), ("org", "/", "allow"), ("org", "/", "block")]
    listed = [(host(), path()) for _ in range(25)] + [(None, None), ("x-y.net", None), ("x-y.net", "/en")]
    return pages, rules, listed


@pytest.mark.parametrize(("seed", "params"), [(1, CascadeParams()), (2, CascadeParams(bits=3, hashes=1)), (3, CascadeParams(max_bits=64))])
def test_verdicts_equal_brute_force(spark, seed, params):
    """With wide bitmaps, with some so narrow that there are many levels, and by joins where a bitmap would be too large."""
    pages, rules, listed = made(seed)
    frame = spark.createDataFrame([(*p, "clash", "x", 1) for p in pages], "page_id long, url string, host string, rule string, key_0 int")
    got = urls.judge(frame, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame(listed, "host string, path string"), params)
    assert got.columns == ["page_id", "host", "path", "rule", "listed_key", "verdict"]
    rules = [(h and h.translate(LOWER), p, v) for h, p, v in rules]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *brute(u, rules, listed)) for i, u in pages), key=str)


def test_cascade_is_exact(spark):
    """Half of the universe is listed, one bit a key: level after level, no key of either sort is taken for the other."""
    universe = spark.range(300).select(F.col("id").cast("string").alias("key")).union(spark.sql("select string(null)"))
    listed = universe.where("key % 2 = 0").union(universe.where("key = 4"))
    c = Cascade(listed, universe.union(universe.where("key = 3")), CascadeParams(bits=1, hashes=1))
    assert len(c.levels) > 2
    rows = universe.where("key is not null").select("key", c.bitmaps().scalar().alias("words"))
    assert rows.where(c.has(F.col("key"), F.col("words")) != (F.col("key") % 2 == 0)).count() == 0
    with pytest.raises(ValueError, match="bound"):
        Cascade(listed, universe, CascadeParams(max_bits=64))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules, listed = spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "host string, path string")
    assert [tuple(r) for r in urls.judge(pages, rules, listed).collect()] == [(1, "a.net", "/", None, None, "allow")]
    assert urls.judge(pages.limit(0), rules, listed).count() == 0
    assert urls.judge(pages.limit(0), urls.rule_table(spark, [("net", "/", "block")]), listed).count() == 0
    assert urls.named_hosts(pages, ("a",)).collect()[0]["host"] == "a.net"
