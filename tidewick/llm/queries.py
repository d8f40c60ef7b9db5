"""Queries of the corpus operators: production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, bpe, chat, lm, negatives, periods, repeats, secrets, sketch, toxicity, urls, warc
from .common import read, shared_path
from .jaccard import link_components

#: The vocabulary of op9; a parameter, not a file of this repository.
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Rules (host, path, verdict) of op12, and the words in host names that make its list of blocked hosts.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
HOST_WORDS = ("ads?", "adult", "bets?", "casino", "pills?", "spam")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, from a lexicon learned outside the held-out third."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled sketches of all documents and of their edited texts."""
    return sketch.edited_fingerprints(read(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents, through a new ledger in the shared folder."""
    return secrets.scan(read(spark, sf_dir, "documents"), shared_path(spark, "blob-ledger"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents under the interpolated model of the training documents."""
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of the pairs of conversations 2k and 2k + 1; masks as from:to, comma-joined."""
    conversations = read(spark, sf_dir, "conversations")
    pairs = chat.assemble(chat.preference_segments(conversations, chat.neighbour_pairs(conversations)))
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[0].cast("string"), x[1].cast("string"))), ",")
    return pairs.select("pair_id", "prompt", "chosen", "rejected", spelled("chosen_loss").alias("chosen_loss"), spelled("rejected_loss").alias("rejected_loss"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return bm25.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that no 400-byte string covers which starts twice in the corpus, with the removed spans and what is left."""
    return repeats.digests(repeats.remove_repeats(read(spark, sf_dir, "documents"), length=400))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    return warc.round_trip(read(spark, sf_dir, "pages"), shared_path(spark, "warc"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents, encoded and decoded."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), RANK_FILE)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 3-word shingle Jaccard of 0.9 or more, as one component id per document."""
    return link_components(read(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of five positives of every hundredth vector; labels of every seventh are moved on by one."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages: the rules, then a list of hosts whose names hold a listed word."""
    pages = read(spark, sf_dir, "pages")
    return urls.judge(pages, urls.rule_table(spark, URL_RULES), urls.named_hosts(pages, HOST_WORDS))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in all documents, with repetitions written into a tenth of them, and the collapsed texts."""
    return periods.digests(periods.periodic_runs(periods.planted(read(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_secret_scans": op3_secret_scans,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_warc": op8_warc,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filters": op12_url_filters,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op5_chat_formatting": """
WITH t AS (
  SELECT conv_id, turn, min({'role': role, 'text': text}) AS said FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), s AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, said FROM t),
met AS (
  SELECT pair_id, turn, max(said) FILTER (side = 0) AS a, max(said) FILTER (side = 1) AS b FROM s GROUP BY pair_id, turn
), split AS (SELECT pair_id, min(turn) AS cut FROM met WHERE a IS DISTINCT FROM b GROUP BY pair_id),
parts AS (
  SELECT pair_id, turn, 'prompt' AS part, a AS said FROM met LEFT JOIN split USING (pair_id) WHERE cut IS NULL OR turn < cut
  UNION ALL SELECT pair_id, turn, 'chosen', a FROM met JOIN split USING (pair_id) WHERE turn >= cut AND a IS NOT NULL
  UNION ALL SELECT pair_id, turn, 'rejected', b FROM met JOIN split USING (pair_id) WHERE turn >= cut AND b IS NOT NULL
), r AS (SELECT pair_id, part, turn, coalesce(said.role, 'unknown') AS role, coalesce(said.text, '') AS body FROM parts),
t2 AS (
  SELECT *, '<|' || role || '|>' || chr(10) || body || chr(10) || '<|end|>' || chr(10) AS rendered, length(role) + length(body) + 14 AS size FROM r
), pos AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY pair_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t2
), m AS (
  SELECT *, CAST(start + length(role) + 5 AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS span, part <> 'prompt' AND role = 'assistant' AS loss FROM pos
)
SELECT pair_id,
  coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen,
  coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn) FILTER (part = 'chosen' AND loss), '') AS chosen_loss,
  coalesce(string_agg(span, ',' ORDER BY turn) FILTER (part = 'rejected' AND loss), '') AS rejected_loss
FROM m GROUP BY pair_id
""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, payload, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
bits AS (SELECT *, list_reduce(list_transform(range(40), lambda i: lpad(bin(strpos('123456789abcdef', substr(h, i + 1, 1))), 4, '0')), lambda a, b: a || b) AS b FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_reduce(list_transform(range(5), lambda j: CAST(substr(b, i * 5 + j + 1, 1) AS INTEGER)), lambda x, y: x * 2 + y) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
""",
    "op11_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> p.anchor_label AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
""",
    "op12_url_filters": r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), r(rule_host, rule_path, said) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT DISTINCT host, path, rule_host || rule_path AS rule, said FROM (SELECT DISTINCT host, path FROM p), r WHERE ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path)),
b AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said FROM f GROUP BY host, path),
l AS (SELECT DISTINCT host AS listed FROM p WHERE regexp_matches(host, '(^|[.-])(ads?|adult|bets?|casino|pills?|spam)([.-]|$)')),
h AS (SELECT host, max_by(listed, length(listed)) AS listed_key FROM (SELECT DISTINCT host FROM p), l WHERE ends_with('.' || host, '.' || listed) GROUP BY host)
SELECT page_id, host, path, rule, listed_key, coalesce(said, CASE WHEN listed_key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b USING (host, path) LEFT JOIN h USING (host)
""",
}
