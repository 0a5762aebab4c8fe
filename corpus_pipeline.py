"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

All stages but the last return the columns of documents. Columns are renamed by place inside a stage, so further columns of documents,
whatever their names, keep their names and values. Null and empty texts aren't toxic, have no benchmark windows and no words, and are near copies of
each other; null sources are one source; rows with a null doc_id are documents; repeated rows are copies; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import decontaminate, jaccard_join, mixing, tokenfile, tokens, toxicity
from meridia.llm.common import scratch, table_path
from meridia.llm.queries import END


def _inside(docs: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """docs with columns c0, c1, ..., these names, and where doc_id, text and source are."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, inner, strict=True))
    return docs.toDF(*inner), inner, {"key": at["doc_id"], "text": at["text"], "source": at.get("source")}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below one half."""
    rows, inner, at = _inside(docs)
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(rows, scorer, text=at["text"]).where("score < 0.5").select(*inner).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each near-duplicate class."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    rows, inner, at = _inside(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias(at["text"]))
    found = decontaminate.contamination(rows, benchmark, text=at["text"], key=at["key"])
    return found.where(~F.col("contaminated")).select(*inner).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their targets; every copy is a row."""
    rows, inner, at = _inside(docs)
    return mixing.mix(rows, **at).select(*inner).toDF(*docs.columns)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file set of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    path = table_path(spark, "pipeline-tokens")
    tokenfile.write_tokens(docs, path, tokens.tokenizer_path(), END)
    return tokenfile.read_tokens(spark, path, digests_only=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_ids),
]

#: Toxicity, mixing and tokenising can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
