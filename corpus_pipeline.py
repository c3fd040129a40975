"""From documents to token digests: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm import bpe, mixing, near_text, secret_scan, toxicity
from lodestar.llm.queries import BYTE_RANKS, TOKEN_PATTERN, WORD_VOCABULARY
from lodestar.session import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the severity model does not reject.

    Each row is judged by its own text, so repeated rows go or stay together; null and empty
    texts have no features and stay, and so does a null doc_id. Without toxic or clean labels
    all stay. An empty table stays empty; other columns are kept and not read.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of least id.

    Rows that share an id are one document, of which one row stays: the first by a hash of its
    columns. Rows without an id stay. Null and empty texts are copies of each other. An empty
    table stays empty; other columns are kept.
    """
    kept = near_text.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64(*(c for c in docs.columns if c != "doc_id")))
    (row,) = mixing.own_names(docs, "row")
    one = docs.join(kept, "doc_id", "left_semi").withColumn(row, F.row_number().over(same)).filter(F.col(row) == 1)
    return one.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and ``n_chars`` that of the masked text.

    Secrets that overlap share one mask. A null text and its ``n_chars`` stay; repeated rows
    are masked alike; an empty table stays empty; other columns are kept and not read.
    """
    masked = secret_scan.mask(docs, BYTE_RANKS, TOKEN_PATTERN)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight buys them.

    Null sources are one source; texts without a token cost nothing, but a source without any
    token goes. Rows that share id and source share their copies as evenly as they can, in
    the order of a hash of their texts. An empty table stays empty; other columns are kept.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, a row for each row.

    Null and empty texts have no tokens; repeated rows give repeated results; an empty table
    gives no rows; other columns are not read.
    """
    return bpe.encoding_digests(docs, WORD_VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("source mix", mix_sources),
    ("tokens", encode),
]

#: Models, sketches and vocabularies are beyond SQL; tests hold each stage against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
