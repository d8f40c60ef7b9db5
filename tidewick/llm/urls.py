"""URL filters by a cascade of Bloom filters, in DataFrame operations only.

Level 0 holds the listed keys, level 1 the keys of the corpus that pass it without being listed, level 2 the listed keys
that pass level 1, and so on until no key passes wrongly. Walking down the levels then answers exactly, for every listed
key and every key that occurs in the corpus, from a few bits a key and without a join. A level is a bitmap in one row of a
table in the shared folder; expressions read it as a scalar subquery.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Kinds of listed keys; a kind is written before its key, so that one cascade tells them apart.
_RULES, _LIST = {ALLOW: "+ ", BLOCK: "- "}, "* "


@dataclass(frozen=True)
class CascadeParams:
    """bits and hashes: bitmap bits and hash functions of a key. max_bits: largest bitmap that is sent to all tasks (8 MB);
    a list that needs more is joined instead."""

    bits: int = 8
    hashes: int = 4
    max_bits: int = 1 << 26


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first "://" up to "/", "?", "#" or the end, A-Z in lower case) and path (from there up to "?", "#" or
    the end); both empty without "://" or for null."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


class Cascade:
    """Exact membership, among the keys that it was built over, of the listed ones."""

    def __init__(self, listed: DataFrame, universe: DataFrame, params: CascadeParams = CascadeParams()) -> None:
        """Both tables have a column `key`; nulls are no keys, repeated ones count once. Raises ValueError beyond max_bits."""
        self.params = params
        self.levels: list[tuple[DataFrame, int]] = []
        listed = listed.select("key").where("key is not null")
        self._add(listed, listed.agg(F.count_distinct("key")).first()[0])
        # Keys of either sort that pass level 0 meet once each; which of them are listed is part of the same aggregation.
        passed = universe.select("key").where(F.col("key").isNotNull() & self._hit(0, F.col("key")))
        flagged = passed.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
        keys = cut(flagged.groupBy("key").agg(F.max("listed").alias("listed")), "cascade-keys")
        while n := (left := self._wrong(keys)).count():
            self._add(left, n)

    def _wrong(self, keys: DataFrame) -> DataFrame:
        """Keys that all levels of the other sort let pass: those that the next level must hold."""
        odd = len(self.levels) % 2
        hits = F.lit(True)
        for i in range(1 - odd, len(self.levels), 2):
            hits = hits & self._hit(i, F.col("key"))
        return keys.where((~F.col("listed") if odd else F.col("listed")) & hits).select("key")

    def _positions(self, level: int, key: Column, size: int) -> list[Column]:
        """Bits of a key: each level has hash functions of its own."""
        return [F.pmod(F.xxhash64(F.lit(level * self.params.hashes + j), key), F.lit(size)) for j in range(self.params.hashes)]

    def _add(self, keys: DataFrame, n: int) -> None:
        level, size = len(self.levels), -(-max(n, 1) * self.params.bits // 64) * 64
        if size > self.params.max_bits:
            raise ValueError(f"a bitmap of {size} bits is over the bound of {self.params.max_bits}")
        at = keys.select(F.explode(F.array(*self._positions(level, F.col("key"), size))).alias("at"))
        masks = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("mask"))
        empty = keys.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
        words = masks.unionByName(empty).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        # One row of max_bits / 64 numbers at most.
        row = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("words"))
        self.levels.append((cut(row, f"cascade-{level}"), size))

    def _hit(self, level: int, key: Column) -> Column:
        row, size = self.levels[level]
        found = F.lit(True)
        for p in self._positions(level, key, size):
            found = found & (F.getbit(F.get(row.scalar(), F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
        return found

    def bitmaps(self) -> DataFrame:
        """One row: the words of all levels, end to end."""
        rows = None
        for i, (row, _) in enumerate(self.levels):
            row = row.select(F.lit(i).alias("level"), "words")
            rows = row if rows is None else rows.unionByName(row)
        words = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("level", "words"))), lambda x: x["words"]))
        return cut(rows.agg(words.alias("words")), "cascade")

    def has(self, key: Column, words: Column) -> Column:
        """Whether a key of the universe, or a listed one, is listed; words is what bitmaps() holds.

        The levels that it passes in a row are counted: listed keys pass an odd number. Words is named once, so that
        the optimizer puts the subquery here instead of copying the bitmaps to every row.
        """
        offsets = [sum(size for _, size in self.levels[:i]) // 64 for i in range(len(self.levels))]
        levels = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(size).alias("size"), F.lit(first).alias("first")) for i, ((_, size), first) in enumerate(zip(self.levels, offsets, strict=True))))
        tries = F.sequence(F.lit(0), F.lit(self.params.hashes - 1))

        def set_bit(level: Column, j: Column) -> Column:
            at = F.pmod(F.xxhash64(level["level"] * F.lit(self.params.hashes) + j, key), level["size"].cast("long"))
            return F.getbit(F.get(words, level["first"] + F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1

        passed = F.aggregate(levels, F.lit(0), lambda n, level: F.when((n == level["level"]) & F.forall(tries, lambda j: set_bit(level, j)), n + 1).otherwise(n))
        return passed % 2 == 1


def key_shapes(entries: DataFrame) -> list[tuple[str, int, int, int]]:
    """Distinct (kind, labels, slashes, tail) of keys: host labels, slashes of the path, characters after its last slash.

    There are as many as ways to cut a key, not as keys: a few for lists of hosts and folders.
    """
    made = entries.select("kind", F.size(F.split("host", r"\.")).alias("labels"), (F.length("path") - F.length(F.translate("path", "/", ""))).alias("slashes"), F.length(F.substring_index("path", "/", -1)).alias("tail"))
    return sorted(tuple(r) for r in made.distinct().collect())


def candidate(host: Column, path: Column, labels: int, slashes: int, tail: int) -> Column:
    """The key of this shape that would fit a URL: its last labels, then the start of its path; null if it is shorter."""
    dots = F.length(host) - F.length(F.translate(host, ".", ""))
    start = F.concat(F.substring_index(path, "/", slashes), F.lit("/")) if slashes else F.lit("")
    key = F.substring(path, F.lit(1), F.length(start) + tail)
    fits = (dots >= labels - 1) & (F.length(path) - F.length(F.translate(path, "/", "")) >= slashes) & (F.length(path) >= F.length(start) + tail)
    return F.when(fits, F.concat(F.substring_index(host, ".", -labels), key))


def _entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(kind, host, path) of both lists; rows without a host, and rules without a known verdict, are none."""
    parts = [F.translate(F.col("host"), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")]
    kind = F.when(F.col("verdict") == ALLOW, _RULES[ALLOW]).when(F.col("verdict") == BLOCK, _RULES[BLOCK])
    return rules.select(kind.alias("kind"), *parts).unionByName(listed.select(F.lit(_LIST).alias("kind"), *parts)).where("kind is not null and host > ''").distinct()


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, params: CascadeParams = CascadeParams()) -> DataFrame:
    """(page_id, host, path, rule, listed_key, verdict) of every row of pages (page_id, url).

    rules has (host, path, verdict: allow or block), listed (host, path) of further blocked keys. An entry fits its host and
    all subdomains if the URL's path starts with the entry's. The longest fitting rule decides; of equal ones block. Without
    a rule, a URL is blocked if a listed entry fits (the longest is listed_key), else allowed. A null URL, or one without
    "://", has an empty host and path, which nothing fits. Null page_ids and repeated rows are kept, each judged by itself;
    empty lists judge everything allowed. An entry without a host, or a rule without one of the two verdicts, is ignored; a
    null path is empty. Very long URLs are compared whole. Extra columns are ignored.
    """
    entries = cut(_entries(rules, listed), "cascade-entries")
    shapes = key_shapes(entries)
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    made = [(kind, candidate(F.col("host"), F.col("path"), *shape)) for kind, *shape in shapes]
    option = [F.when(key.isNotNull(), F.struct(F.length(key).alias("size"), F.lit(kind).alias("kind"), key.alias("key"))) for kind, key in made]
    none = F.array().cast("array<struct<size:int,kind:string,key:string>>")
    urls = urls.select("*", F.array_compact(F.array(*option) if option else none).alias("options"))
    known = entries.select(F.concat("kind", "host", "path").alias("key"))
    if known.count() * params.bits > params.max_bits:
        urls = _joined(urls, known)
    else:
        cascade = Cascade(known, urls.select(F.explode("options").alias("o")).select(F.concat("o.kind", "o.key").alias("key")), params)
        urls = urls.select("*", cascade.bitmaps().scalar().alias("words"))
        urls = urls.select("page_id", "host", "path", F.filter("options", lambda o: cascade.has(F.concat(o["kind"], o["key"]), F.col("words"))).alias("hits"))
    best = lambda kinds: F.array_max(F.filter("hits", lambda o: o["kind"].isin(*kinds)))
    urls = urls.select("*", best(_RULES.values()).alias("rule_hit"), best([_LIST]).alias("list_hit"))
    verdict = F.when(F.col("rule_hit.kind") == _RULES[BLOCK], BLOCK).when(F.col("rule_hit").isNotNull(), ALLOW).when(F.col("list_hit").isNotNull(), BLOCK).otherwise(ALLOW)
    return urls.select("page_id", "host", "path", F.col("rule_hit.key").alias("rule"), F.col("list_hit.key").alias("listed_key"), verdict.alias("verdict"))


def _joined(urls: DataFrame, known: DataFrame) -> DataFrame:
    """The same hits by joins, for lists whose bitmap would be over the bound: distinct URLs meet the list key by key."""
    rows = urls.select("host", "path", "options").distinct().select("host", "path", F.explode("options").alias("hit"))
    rows = rows.join(known.select(F.col("key").alias("tagged")), F.concat("hit.kind", "hit.key") == F.col("tagged"), "left_semi")
    rows = rows.groupBy("host", "path").agg(F.collect_list("hit").alias("hits"))  # an entry a shape at most
    return urls.join(rows, ["host", "path"], "left")


def named_hosts(pages: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(host, path) of the distinct hosts of pages with one of the words as a whole part of a label; the path is empty."""
    host, _ = url_parts(F.col("url"))
    pattern = rf"(^|[.-])({'|'.join(words)})([.-]|$)"
    return pages.select(host.alias("host")).where(F.col("host").rlike(pattern)).distinct().select("host", F.lit("").alias("path"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table; a user's list is read from files instead."""
    rows = ", ".join("('{}', '{}', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in r)) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")
