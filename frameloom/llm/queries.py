"""The queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, decontam, line_dedup, mixing, pii, quality, secrets, sharding, simhash, tokens
from .common import read

#: Vocabulary of the token output; any file of ranks serves.
TOKENIZER = "byte_bpe_50k.tiktoken"


def op1_line_dedup(spark, sf_dir):
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_decontamination(spark, sf_dir):
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_sharding(spark, sf_dir):
    return sharding.digest(read(spark, sf_dir, "documents"))


def op4_secret_scan(spark, sf_dir):
    return secrets.digest(read(spark, sf_dir, "documents"))


def op5_personal_data(spark, sf_dir):
    return pii.digest(read(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_nearest(spark, sf_dir):
    return ann.search(read(spark, sf_dir, "embeddings"))


def op8_simhash(spark, sf_dir):
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark, sf_dir):
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_token_output(spark, sf_dir):
    import public_tokenizers

    return tokens.digest(read(spark, sf_dir, "documents"), f"file://{public_tokenizers.path(TOKENIZER)}", public_tokenizers.PATTERN)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = (
        op1_line_dedup, op2_decontamination, op3_sharding, op4_secret_scan, op5_personal_data, op6_quality, op7_nearest, op8_simhash,
        op9_mixing, op10_token_output, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op1_line_dedup": line_dedup.ORACLE}
