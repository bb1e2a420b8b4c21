"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, token ids.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's docs. All but the last return the
columns of ``docs``; the last adds the token ids to the key columns.

Defined results: rows with a null text are rejected by the quality rules; a
null key takes no part in the near-duplicate join and stays; an empty table
gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeweave.llm import bpe, jaccard, mixing, quality, secrets
from gradeweave.llm.common import materialize
from gradeweave.llm.sieve import sieve


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.decide(docs, rules).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest key.

    Sets of five-word shingles at a Jaccard similarity of 0.8. Documents are
    told apart by key and text, so different texts under one key are decided
    one by one.
    """
    linked = jaccard.link(docs, width=5, percent=80, degrees=False).where(F.col("first_text_id").isNotNull())
    first = (F.col("component_id") == F.col("doc_id")) & (F.col("first_text_id") == F.col("text_id"))
    marks = linked.groupBy(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text")).agg(F.max(~first).alias("__gone"), F.count("*").alias("__rows"))
    marks = materialize(marks.where("__gone or __rows > 1").withColumn("__h", F.xxhash64("__id", "__text")), "pipeline-marks")
    twice = materialize(marks.where("not __gone"), "pipeline-repeats")
    row = F.xxhash64("doc_id", F.xxhash64(F.coalesce(docs.text, F.lit(""))))
    same = lambda df, m: (df.doc_id == m["__id"]) & (F.xxhash64(F.coalesce(df.text, F.lit(""))) == m["__text"])
    # texts of documents that surely bear no mark are not shuffled
    marked = sieve(marks, "__h")(row)
    met, again = docs.where(marked), docs.where(sieve(twice, "__h")(row))
    alone = met.join(marks, same(met, marks), "left_anti")
    # rows that repeat key and text are few as a rule, and only they are compared as a whole
    repeated = again.join(twice, same(again, twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.where(~marked).unionByName(alone).unionByName(repeated).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; the documents stay."""
    found = secrets.scan(docs, redacted=True)
    text = F.when(F.size("spans") > 0, F.col("redacted")).otherwise(F.col("text"))
    out = found.withColumns({"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)})
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order."""
    return mixing.mix(docs, mixing.schedule(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids, decoded again; the decoded bytes are the text's."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources", mix_sources),
    ("byte-level BPE", token_ids),
]

#: The learned rules, the similarity join and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "pipeline")
    return docs
