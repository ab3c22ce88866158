"""The queries of this subpackage, each over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from fiscalframe.llm import byte_bpe, decontamination, exact_dedup, language, licenses, merkle, mixing, pseudonyms, quality, secret_scan, simhash, substring_dedup, vector_codes
from fiscalframe.llm.common import held_out, table
from fiscalframe.llm.sql import oracle_sql  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]

# In production the key comes from a secret store.
EXAMPLE_KEY = b"example key, not a secret"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), EXAMPLE_KEY)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.findings_by_path(versions, secret_scan.scan(versions))
    kinds = [r.kind for r in secret_scan.BASE]
    counts = [F.size(secret_scan.of_kinds(F.col("findings"), k)).cast("long").alias(f"n_{k}") for k in kinds]
    base = F.sha2(secret_scan.spans_text(secret_scan.of_kinds(F.col("findings"), *kinds)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secret_scan.spans_text(F.col("findings")).alias("spans"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.mark(docs, decontamination.find(docs, table(spark, sf_dir, "benchmark")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~held_out(F.col("doc_id"))))
    found = language.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = ~held_out(F.col("doc_id"))
    model = quality.fit(docs.filter(learned), table(spark, sf_dir, "labels").filter(learned))
    found = quality.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # of the environment; no other query needs it

    vocabulary = byte_bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary)
    decoded = byte_bpe.decode(encoded, vocabulary, ("doc_id", "ids"))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes_and_errors(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    whole = merkle.leaf(*columns, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claimed = F.when(tampered, merkle.leaf(*columns, merkle.lower_ascii(F.col("text")))).otherwise(whole)
    leaves = docs.select("doc_id", "lang", whole.alias("leaf"), claimed.alias("claimed"))
    return merkle.manifest(leaves, "lang", ["doc_id"], ["doc_id"])


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_pii": op2_pii,
        "op3_secrets": op3_secrets,
        "op4_licenses": op4_licenses,
        "op5_decontamination": op5_decontamination,
        "op6_mixing": op6_mixing,
        "op7_language": op7_language,
        "op8_simhash": op8_simhash,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_quality": op10_quality,
        "op11_bpe": op11_bpe,
        "op12_vector_codes": op12_vector_codes,
        "op13_merkle": op13_merkle,
        "pipeline": corpus_pipeline.run,
    }
