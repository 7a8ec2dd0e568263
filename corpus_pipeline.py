"""A cleaning pipeline over the documents table: toxicity, line dedup, near-duplicates, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import linededup, packing, secrets, simhash_texts, toxicity
from quillon.llm.common import Scratch, table


def _with_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars as the text now is."""
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))
    return df.select(*[f"`{c}`" for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that are not held out, does not take for toxic."""
    model = toxicity.fit_labels(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(spark, docs.select(*[F.col(f"`{c}`").alias(f"__d_{c}") if c in ("score", "predicted", "n_sentences", "n_offending") else F.col(f"`{c}`") for c in docs.columns]), model)
    kept = scored.where("predicted = 0")
    return kept.select(*[F.col(f"`__d_{c}`").alias(c) if f"__d_{c}" in kept.columns else F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; none is dropped, some may become empty."""
    return _with_text(linededup.dedup_lines(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; rows without a doc_id stay.

    Near-duplicates have a Jaccard likeness of 0.8 or more of their five-word shingles, or are linked by such. Different
    texts of one doc_id are judged apart: of those in a group one stays, of the least hash; of rows equal in doc_id and
    text any one.
    """
    scratch = Scratch(spark, "groups")
    groups = simhash_texts.near_duplicates(spark, docs.where("doc_id is not null"))
    rows = groups.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    one = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("r")).select(F.col("r.doc_id").alias("__id"), F.col("r.text_hash").alias("__hash"), F.col("r.n").alias("__n"))
    one = scratch.put(one, "one")
    named = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": simhash_texts.text_hash()})
    columns = [f"`{c}`" for c in docs.columns]
    kept = named.join(one, ["__id", "__hash"])  # one row of `one` at most for each
    if not one.where("__n > 1").isEmpty():
        kept = kept.where("__n = 1").unionByName(kept.where("__n > 1").dropDuplicates(["__id", "__hash"]))
    return kept.select(*columns).unionByName(docs.where("doc_id is null"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with `[secret]` in the place of each secret."""
    ledger = secrets.Ledger(spark, f"{Scratch(spark, 'ledger').root}/ledger")
    ledger.add(docs.select(secrets.blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")), secrets.BASE + secrets.MORE)
    return _with_text(secrets.redact(docs, ledger), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near-duplicates", drop_near_duplicates), ("secrets", hide_secrets), ("packing", pack)]

#: The stages learn, link and tokenize, which SQL does not express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before it wrote."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.put(docs, f"{k}")
            if k:
                scratch.drop(f"{k - 1}")
    return docs
