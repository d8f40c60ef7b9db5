"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is a blob, named by its SHA-256. The ledger holds one row of findings for
each (blob, rule version) that was ever scanned. A scan takes the blobs of the given versions,
removes those that the ledger has for the current rules, reads the text of one version of each of
the others, appends the findings, and joins them back to all versions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import cut, text_bytes

#: Base kinds in the order that breaks ties, then the added ones.
KINDS = ("assign", "access", "hex", "jwt", "pem", "url")
BASE = 3
RULE_VERSION = "4"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
# Header lines, then the body up to its END line, or the base64 lines of a key that is cut off.
_PEM = re.compile(r"""-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:\s*\n[A-Za-z][A-Za-z0-9-]*:[^\n]*)*+
    (?:[A-Za-z0-9+/=\s]*+-----END [A-Z ]*PRIVATE KEY-----|(?:\s*\n[A-Za-z0-9+/=]{16,}[ \t\r]*(?=\n|\Z))+(?:\n(?:[A-Za-z0-9+/]+={1,2}|[A-Za-z0-9+/=]+\Z))?))?""".replace("\n    ", ""))
# What follows a scheme; the scheme is then read backwards, so that a long run of its characters is read once.
_URL = re.compile(r"://[^\s/:@]*:[^\s/@]{4,}@[A-Za-z0-9.-]+")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")

FINDINGS = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all secrets of a text in code points, by start and kind."""
    raw = text.encode() if raw is None else raw
    low = raw.lower()
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    # The maximal runs of 16 or more are the leftmost runs that are long enough.
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    if b"eyJ" in raw:
        out += [(m.start(), m.end(), 3) for m in _JWT.finditer(text)]
    if b"-----BEGIN " in raw:
        out += [(m.start(), m.end(), 4) for m in _PEM.finditer(text)]
    if b"://" in raw and b"@" in raw:
        out += [(a, b, 5) for a, b in _urls(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _urls(text: str) -> list[tuple[int, int]]:
    """URLs with a password; a scheme of any length begins with a letter and has two characters or more."""
    out, done = [], 0
    for m in _URL.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in _SCHEME:
            a -= 1
        while a < m.start() and not "a" <= text[a] <= "z":
            a += 1
        if m.start() - a >= 2:
            out.append((a, m.end()))
            done = m.end()
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        rows = []
        for blob, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            if blob == last:  # a repeated row; the join has brought equal ones together
                continue
            last = blob
            spans = find_spans(raw.decode(), raw)
            base = [s for s in spans if s[2] < BASE]
            rows.append((blob, RULE_VERSION, *(sum(s[2] == k for s in base) for k in range(BASE)), hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All findings so far; an empty table if the ledger doesn't exist yet."""
    try:
        return spark.read.schema(FINDINGS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], FINDINGS)


def scan(docs: DataFrame, path: str) -> DataFrame:
    """Scans the unseen blobs of docs (doc_id, text), extends the ledger at path, and returns findings for every row.

    (doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans). A row is one historical version: ids and texts may
    repeat, each row gives a row. A null text is the empty blob, without findings; ids may be null; other columns are
    ignored. Texts are read whole, however long. Spans that begin together go in the order of KINDS; spans of different
    kinds may overlap. A blob that two runs scan at once is in the ledger twice and counts once. No rows give none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rules = ledger(spark, path).where(F.col("rule_version") == RULE_VERSION)
    version = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    # The one version of a blob whose text is read; hot blobs are combined before the shuffle.
    reps = rows.groupBy("blob").agg(F.min(version).alias("version")).join(rules.select("blob"), "blob", "left_anti")
    texts = rows.withColumn("version", version).join(reps, ["blob", "version"]).select("blob", "text")
    texts.mapInArrow(_scan, FINDINGS).write.mode("append").parquet(path)
    # Written, so that nothing but the join shares its exchange: a hot blob's versions can be split between tasks.
    found = cut(ledger(spark, path).where(F.col("rule_version") == RULE_VERSION).dropDuplicates(["blob"]).drop("rule_version"), "findings")
    return rows.select("doc_id", "blob").join(found, "blob").select("doc_id", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def redact(docs: DataFrame, path: str, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret span of text replaced by a mark (overlapping spans as one) and n_chars, if there, renewed.

    Findings come from the ledger at path, which a scan of docs extends first. Null texts stay null; all columns stay,
    whatever their names; repeated rows stay; no rows give none.
    """
    scan(docs, path)
    names = docs.columns
    blob, found_spans = ("_" * (1 + max(map(len, names))) + c for c in ("blob", "spans"))  # no column has so long a name
    found = ledger(docs.sparkSession, path).where((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != "")).dropDuplicates(["blob"]).select(F.col("blob").alias(blob), F.col("spans").alias(found_spans))
    found = cut(found, "secrets")
    rows = docs.withColumn(blob, F.unhex(F.sha2(F.col("text").cast("string").cast("binary"), 256))).join(found, blob, "left").select(*(F.col(f"`{c}`") for c in names), found_spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, n = batch.schema.get_field_index("text"), batch.num_columns - 1
            if batch.column(n).null_count < batch.num_rows:
                texts = [t if not spans else _masked(t, spans, mark) for t, spans in zip(batch.column(i).to_pylist(), batch.column(n).to_pylist(), strict=True)]
                columns = [pa.array(texts, batch.schema.field(i).type) if k == i else c for k, c in enumerate(batch.columns[:n])]
            else:
                columns = batch.columns[:n]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def _masked(text: str, spelled: str, mark: str) -> str:
    out, at, end = [], 0, -1
    for s in spelled.split(","):
        _, a, b = s.split(":")
        a, b = int(a), int(b)
        if a >= end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:a])
        end = max(end, b)
    return "".join([*out, mark, text[end:]])
