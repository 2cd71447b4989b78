"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token-id output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents, also further ones, whatever their names.

Defined cases, for every stage: null or empty text, null doc_id, lang or source, repeated rows and rows of one doc_id are
documents like others and none is merged unless it is a near duplicate; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.llm import decontaminate, language_id, minhash, mixing, token_file
from genomill.llm.common import shielded, stash, table
from genomill.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter are rejected; the others keep their rows as they are.

    The model is learned as in op7: from the labelled documents of the stage's input that aren't held out.
    """
    model = language_id.learn(language_id.training_rows(docs)[1])
    plain, own = shielded(docs.withColumn("text", docs["text"].cast("string")), ("lang_pred", "score"))
    return language_id.identify(plain, model).where(F.col("lang_pred") != language_id.UND).select(own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of lowest doc_id; of several rows of that doc_id, one.

    A document without words is no duplicate of any other.
    """
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of benchmark items on a twentieth of their words or more go; others with hits lose the matched spans of 13 words or more."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove_spans=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times); a null source is a source, a document without words is drawn like others."""
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the token file; rows of one doc_id follow each other by a hash of their text."""
    return token_file.token_file(docs, tokenizer("byte_bpe_50k.json"), remembered=PIECES)


#: Pieces that a worker of the last stage keeps in mind; executors still hold memory of the stages before.
PIECES = 150_000

STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: Language models, the cube draw and the tokenizer can't be put into SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
