"""The training-corpus pipeline: five stages from raw documents to tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet
below the shared checkpoint folder and reads it again as the next stage's ``docs``. The first
four return the columns of ``docs``, the last one the tokens.

Defined results: rows are judged by their text, not by their doc_id, so a row stays if its own
text is good and clean whatever other rows with its doc_id hold; a null doc_id is kept by the
near-duplicate stage always; of repeated rows with one doc_id and near-equal texts all stay or
all go; extra columns are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import bpe, decontaminate
from agora.llm.common import read_table, stage, without_rows
from agora.llm.linededup import drop_repeated_lines
from agora.llm.quality import fit_quality, fold
from agora.llm.queries import bpe_digests, tokenizer_path
from agora.llm.simhash import near_copies


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least 0.3)."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"), train=fold(F.col("doc_id")) != 0)
    return model.keep(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated in three documents or more stay in the one of largest doc_id; ``n_chars``
    follows the text. Documents stay, even if no line is left."""
    return drop_repeated_lines(docs, carry=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays. Texts without words (empty
    ones too) share one fingerprint and thus one group."""
    return without_rows(docs, near_copies(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), unnamed=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ``ids`` (little-endian unsigned 32-bit integers), with their number and hash
    and that of the decoded text, as the BPE query has them."""
    return bpe_digests(docs, bpe.BytePairEncoder.load(tokenizer_path("byte_bpe_50k.json")), keep_ids=True)


STAGES = [("quality classifier", keep_good), ("line dedup", drop_lines), ("simhash near dedup", drop_near_copies),
          ("benchmark decontamination", drop_leaks), ("bpe encoding", tokenize)]

#: SQL cannot express the trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
