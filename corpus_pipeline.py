"""From raw documents to tokens: five stages, each a function of (spark, docs, sf_dir) that works on what the one before
it kept. All but the last return the columns of ``documents``.

Defined results: documents with null text are rejected by the quality rules; a null id is a document without a name that
survives where no named document of its group does; of each group of near-duplicates exactly one row survives, whatever
ids are null or repeated; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, decontaminate, minhash, quality, suffixes
from tagloom.llm.common import table, written
from tagloom.llm.queries import tokenizer

#: Policy of the quality rules, and words in a shingle of the near-duplicate stage.
POLICY = "v1"
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality.passing(docs, POLICY)


def rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first stage measures of every document, and the bits of the rules that fail; to be written once and asked
    for other policies."""
    return quality.ledger(table(spark, sf_dir, "documents"))


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the first stage's policy costs."""
    return quality.ablation(written(rule_ledger(spark, sf_dir)), POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of those with the smallest id, the first in a written, numbered table;
    a row without an id only where all are. Where every row has an id of its own, ids do without that table."""
    odd = docs.groupBy("doc_id").count().where(F.col("doc_id").isNull() | (F.col("count") > 1))
    if odd.isEmpty():
        found = minhash.near_duplicates(docs.select("doc_id", "text"), size=SHINGLE)
        return docs.join(found.where("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    rows = written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")))
    name = F.struct(F.col("row.doc_id").isNull().alias("unnamed"), "row.doc_id", "number")
    found = minhash.near_duplicates(rows.select(name.alias("name"), "row.text"), size=SHINGLE, id_col="name")
    return rows.join(found.where("kept").select("name.number"), "number", "left_semi").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeat an earlier passage; a cut inside a character takes the character."""
    left = suffixes.remove_repeats(docs, as_text=True)
    text = F.col("kept")
    return left.select(*[text.alias("text") if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passages of the benchmark, or few words of them."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).where(~F.col("contaminated")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of them and of the bytes that they decode to."""
    path, pattern = tokenizer()
    return bpe.digests(bpe.encode(docs, path, pattern, decoded=True), also=["ids"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: Stages 2, 3 and 5 are beyond SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
