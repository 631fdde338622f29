"""The registered queries of this subpackage: thin digests over the operators, in the agreed column form."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import ann, bpe, decontaminate, infill, langid, linededup, pii, resample, secrets, simhash, tokenfile, toxicity
from tallystone.llm.checkpoints import new_folder
from tallystone.session import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"), "doc_id")
    return found.select(
        "doc_id",
        *(secrets.count_kind(F.col("base"), i).alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS[:3])),
        F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op4_token_count(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    found = bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_nearest(spark: SparkSession, sf_dir: str, every: int = 50, k: int = 5) -> DataFrame:
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % every == 0), k, ann.fit(vectors))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), digests=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.with_kept_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.encode("_kept", "UTF-8"), 256).alias("kept_sha256")
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(langid.fold(F.col("doc_id"), 3) == 1, F.lit(False)))
    model = langid.fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return langid.predict(docs, model, "doc_id", "held_out")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(langid.fold(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    return toxicity.fit(docs.select("doc_id", "text"), labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(langid.fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    return toxicity.score(docs, toxicity_model(spark, docs, sf_dir), "doc_id", "held_out")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str, end: int = 1) -> DataFrame:
    path = new_folder(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end)
    return tokenfile.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(infill.restored(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_count": op4_token_count,
    "op5_nearest": op5_nearest,
    "op6_bpe_roundtrip": op6_bpe_roundtrip,
    "op7_line_dedup": op7_line_dedup,
    "op8_language": op8_language,
    "op9_toxicity": op9_toxicity,
    "op10_personal_data": op10_personal_data,
    "op11_token_files": op11_token_files,
    "op12_resample": op12_resample,
    "op13_fill_in_middle": op13_fill_in_middle,
}
