"""The registered query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, bpe, decontaminate, divergence, html, katz, licenses, minhash, periods, quality, sharding, suffixes, token_counts
from .common import table

#: Names of the rank file and of the tokenizer among the public vocabularies.
RANK_FILE = "byte_bpe_50k.tiktoken"
TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer(name: str = RANK_FILE) -> tuple[str, str]:
    """Path of a public rank file and the pattern that splits text before its merges."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=0.8)


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(licenses.scan(table(spark, sf_dir, "documents")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Names of the shards that documents are placed on.
SHARDS = [f"shard-{k:03d}" for k in range(256)]


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS)
    return placed.select("doc_id", "slot", "shard")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), *tokenizer())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        (~quality.verdict("base")).alias("base_failed"),
        quality.verdict("v1").alias("kept"),
        "fail_bits",
    )


def repeated(doc_id: int | None, text: str | None) -> list[bytes]:
    """Words of a text; those of every tenth document by checksum repeat themselves from some word on. Without an id none do."""
    words = periods.words_of(doc_id, text)
    checksum = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if checksum % 10 or not words:
        return words
    g, n = checksum // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic(table(spark, sf_dir, "documents"), periods.digest, periods.DIGESTS, words=repeated)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, top=50)


def op13_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = binary.token_files(table(spark, sf_dir, "documents"), tokenizer(TOKENIZER_FILE)[0])
    return binary.read_files(manifest).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_html": op1_html,
    "op2_minhash": op2_minhash,
    "op3_katz": op3_katz,
    "op4_bpe": op4_bpe,
    "op5_licenses": op5_licenses,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op8_suffixes": op8_suffixes,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_periods": op11_periods,
    "op12_divergence": op12_divergence,
    "op13_binary": op13_binary,
}
