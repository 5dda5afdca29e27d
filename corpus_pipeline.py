"""The corpus pipeline: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlake.llm import ngram_join, packing, secrets, substrings, toxicity
from spreadlake.llm.common import held_out, read, table, tune
from spreadlake.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with a new text, and n_chars to match."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score under its threshold).

    Rows are judged one by one, by text: null and empty texts score as their model's intercept says,
    repeated rows alike.  Null ids take no part in training, and are scored all the same.
    """
    tune(spark)
    labels = read(spark, sf_dir, "labels")
    model = toxicity.train(docs.filter(~held_out(F.col("doc_id"))), labels.filter(~held_out(F.col("doc_id"))))
    return toxicity.score(docs.select(*COLUMNS), model, keep=True).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id; rows that repeat an id stay together.

    Only the ids to leave out travel: they are broadcast where Spark finds them small, and shuffled where not.
    """
    tune(spark)
    copies = ngram_join.join(docs).filter("component <> id").select(F.col("id").alias("doc_id")).distinct()
    return docs.select(*COLUMNS).join(table(spark, copies, "copies"), "doc_id", "left_anti").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages that documents with smaller ids have."""
    tune(spark)
    out = substrings.remove(docs.select(*COLUMNS))
    return _with_text(out, F.col("text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the spans of secrets replaced by a mark.

    A row meets the spans of its own text by blob, so null and repeated ids get theirs, one match a row.
    """
    tune(spark)
    ledger = table(spark, secrets.scan_unseen(docs), "ledger")
    joined = docs.select(*COLUMNS, secrets.blob("text")).join(secrets.hits(ledger), "blob", "left")
    return _with_text(joined, secrets.masked(F.col("text"), F.col("spans")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; a null or empty text is its end id alone, a repeated row is packed again."""
    tune(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]
# A trained classifier and a tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(spark, docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs
