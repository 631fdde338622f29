"""A corpus pipeline of five operators: from raw documents to token ids.

``run`` applies the stages in order; between stages the documents are written as Parquet in the shared checkpoint
folder and read again, so no stage computes an earlier one twice and a lost executor costs one stage's tasks.

Stages: toxicity (documents predicted toxic go), line dedup (repeated lines go, ``n_chars`` follows the text), SimHash
near-dedup (of each component the smallest doc_id stays), benchmark decontamination (contaminated documents go), and
byte-level BPE encoding with decoding. All but the last return the columns of ``documents``; the last returns doc_id,
n_tokens, ids and the decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import bpe, decontaminate, linededup, simhash, toxicity
from tallystone.llm.checkpoints import stored
from tallystone.llm.queries import toxicity_model
from tallystone.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity_model(spark, docs, sf_dir))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    kind = docs.schema["n_chars"].dataType
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe_encode", encode),
]

#: SQL can't express compression distances or merges; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
