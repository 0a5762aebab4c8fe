"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, jaccard_join, lines, mixing, pii, substrings, tokenfile, tokens, toxicity
from .common import table_path

#: Appended to each document by op1.
END = 2


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "tokens")
    tokenfile.write_tokens(_read(spark, sf_dir, "documents"), path, tokens.tokenizer_path(), END)
    return tokenfile.read_tokens(spark, path, digests_only=True)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.col("copies.shard").alias("shards"), F.col("copies.rank").alias("ranks"), F.col("copies.place").alias("places"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "text_id", "copies")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"), tokens.tokenizer_path())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, scorer)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_token_output, op2_source_mix, op3_jaccard_join, op4_substring_dedup, op5_token_counts, op6_line_dedup, op7_pii, op8_decontamination, op9_fingerprints, op10_toxicity)}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL = {
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS i, w FROM d),
g AS (SELECT doc_id, i, hash(w[i:i+19]) AS h, md5(array_to_string(w[i:i+19], ' ')) AS m FROM p),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h, m ORDER BY doc_id, i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE k > 1),
r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)""",
    "op8_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(win) AS k FROM bw),
p AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, n WHERE len(w) >= k),
h AS (SELECT p.doc_id, p.i, p.k, bw.item_id FROM p JOIN bw ON p.w[p.i:p.i + p.k - 1] = bw.win),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
