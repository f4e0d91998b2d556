"""From raw documents to token ids in five stages, each written and read again.

Quality classifier, exact dedup, MinHash near-dedup, mixing to target weights
and byte-level BPE. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.llm import bpe, exact_dedup, mixing, near_dedup, quality, token_counts
from screenlake.llm.common import SharedTables, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on docs, keeps.

    Null, empty and blank texts score 0 and go; very long texts count whole;
    repeated rows and rows with a null doc_id stay or go by their text.
    """
    return quality.QualityModel.fit(docs).keep(docs)


def _rows(docs: DataFrame, *more) -> DataFrame:
    """docs as one struct, so that no helper column can clash with theirs."""
    return docs.select(F.struct("*").alias("row"), *more)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest doc_id, null last.

    Null counts as the empty text, of which one row stays. Of rows that agree in
    doc_id and length and are both best, one stays.
    """
    plain = "".join(chr(x) for x in exact_dedup.IGNORED)
    text = F.coalesce(F.col("text"), F.lit(""))
    # one key for join and distinct rows, so that texts move once
    key = lambda sha, size, doc_id: F.concat_ws("|", sha, size, F.coalesce(doc_id.cast("string"), F.lit("none")))
    best = exact_dedup.exact_dedup(docs).filter("kept").select(key(F.col("text_sha256"), F.col("keep_len"), F.col("keep_id")).alias("key")).distinct()
    keyed = _rows(docs, key(F.sha2(F.translate(text, plain, ""), 256), F.length(text), F.col("doc_id")).alias("key"))
    return keyed.join(best, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates.

    Documents without words link with nothing and stay, as do those with a null
    doc_id. Rows that repeat the doc_id that stays all stay.
    """
    kept = near_dedup.near_dedup(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = _rows(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(kept, "doc_id", "left_semi").select("row.*").unionByName(docs.filter("doc_id IS NULL"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come closer to even shares.

    Nulls in source or lang are values of their own; texts without tokens are
    drawn like the others of their cell; repeated ids are drawn or left together.
    """
    count = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    return mixing.with_draw(docs, power=0.7, keep_share=0.8, seed=11, tokens=lambda texts: count(texts)[1]).filter("mix.kept").select("row.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the decoded bytes.

    Null counts as the empty text, which has no ids; every row gives one row.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).drop("exact")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level BPE", encode_stage),
]

#: The classifier is trained and the draw depends on it, so SQL can't give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each reads what the one before has written."""
    store, docs = SharedTables(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = store.write(stage(spark, docs, sf_dir), f"stage_{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
