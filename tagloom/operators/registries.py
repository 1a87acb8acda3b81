"""Language, script, editor and Wikidata registries: statistics and derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import counters

ENTITY = r"^http://www\.wikidata\.org/entity/([PQ][0-9]+)$"


def language_stats(subtags: DataFrame, wikipedia_sites: DataFrame) -> DataFrame:
    """(key, value): subtags by type, and encyclopedia sites."""
    types = subtags.groupBy("stype").agg(F.count("*").alias("value")).select(F.concat(F.lit("subtag_"), "stype").alias("key"), "value")
    return types.unionByName(counters(wikipedia_sites, {"wikipedia_sites": F.count("*")}))


def deprecated_tags(mapping: DataFrame) -> DataFrame:
    """Distinct (key, value) of the old tags of a mapping; '*' stands for any value and becomes null."""
    rows = mapping.select(F.explode("old_tags").alias("key", "value"))
    return rows.select("key", F.nullif("value", F.lit("*")).alias("value")).distinct()


def sw_stats(deprecated: DataFrame, discardable: DataFrame) -> DataFrame:
    """(key, value): deprecated tags, discardable keys by source and in all."""
    by = discardable.groupBy("source").agg(F.count("*").alias("value")).select(F.concat(F.lit("discardable_tags_"), "source").alias("key"), "value")
    both = counters(deprecated, {"deprecated_tags_id": F.count("*")}).unionByName(counters(discardable, {"discardable_tags": F.countDistinct("key")}))
    return by.unionByName(both)


def wikidata_tables(keys: DataFrame, tags: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(keys, tags, labels, errors) from query results: item, prop and description, or item, label and lang.

    Items must be entities and tags of the form key=value with one equals sign; others are errors. Labels of other items
    are left out.
    """
    code = F.regexp_extract("item", ENTITY, 1)
    pair = r"^([^=]+)=([^=]+)$"
    k, t = keys.withColumn("code", code), tags.withColumn("code", code)
    good = (F.col("code") != "") & F.col("prop").rlike(pair)
    error = lambda df, p: df.select(
        F.lit(p).alias("wikidata"), "item", F.nullif("code", F.lit("")).alias("code"), F.col("prop").alias("propvalue"), "description", F.lit("Item has invalid format").alias("error")
    )
    split = [F.regexp_extract("prop", pair, n).alias(c) for n, c in ((1, "key"), (2, "value"))]
    return (
        k.where("code <> ''").select("code", F.col("prop").alias("key")),
        t.where(good).select("code", *split),
        labels.withColumn("code", code).where("code <> ''").select("code", "label", "lang"),
        error(k.where("code = ''"), "P13786").unionByName(error(t.where(~good), "P1282")),
    )


def wikidata_stats(keys: DataFrame, tags: DataFrame, labels: DataFrame, errors: DataFrame) -> DataFrame:
    """(key, value): entries, distinct keys and tags, labels, errors, and entries by kind of item."""
    kinds = lambda name: {f"wikidata_{name}_{k.lower()}code": F.count_if(F.col("code").startswith(k)) for k in "PQ"}
    return (
        counters(keys, {"wikidata_keys": F.count("*"), "wikidata_distinct_keys": F.countDistinct("key")} | kinds("keys"))
        .unionByName(counters(tags, {"wikidata_tags": F.count("*"), "wikidata_distinct_tags": F.countDistinct("key", "value")} | kinds("tags")))
        .unionByName(counters(labels, {"wikidata_labels": F.count("*")}))
        .unionByName(counters(errors, {"wikidata_errors": F.count("*")}))
    )
