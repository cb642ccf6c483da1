"""The corpus pipeline: documents in, token ids out, one operator of ``quillspark.llm`` a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import jaccard, mixing, pieces, quality, secrets
from quillspark.llm.common import discard, scratch, table, temporary_tables
from quillspark.llm.queries import tokenizer_file

#: Near copies share 80 in 100 of their runs of five words.
NEAR_COPY = jaccard.Rule(5, 80)


# All stages take a null text for an empty one, keep all columns of ``documents`` and any others, whatever
# their names, treat rows that repeat alike, take texts of any length whole, and turn an empty table into an empty one.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and so do null and empty texts; rows that share a doc_id are judged each."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id, then the smallest hash. Texts without words stay."""
    return jaccard.drop_near_copies(docs, NEAR_COPY)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind, the first of overlapping ones naming them; n_chars is that of the new text. Null texts stay null."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go so that sources come to their target shares of words. A null source is a source; texts without words go."""
    return mixing.apply_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix; a null or empty text has none."""
    return pieces.encode_documents(docs, tokenizer_file())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", encoding),
]

#: SQL has no merge-type tokenizer, covariance determinants or R-trees; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each is written as Parquet and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        keep: list[DataFrame] = []
        with temporary_tables(keep):
            docs = scratch(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name.lower()))
            keep.append(docs)
        discard(*before)
        before = keep
    return STAGES[-1][1](spark, docs, sf_dir)
