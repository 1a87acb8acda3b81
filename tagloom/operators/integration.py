"""Tables that join the counts with documentation, projects and languages, and the statistics of all sources."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import COUNTS, fraction, number_prefix

def _zero():
    return F.lit(0).cast("long")



def sources(*registries: DataFrame) -> DataFrame:
    """Registry of sources with their order number."""
    numbered = [r.drop("no").withColumn("no", F.lit(n)) for n, r in enumerate(registries, 1)]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def master_stats(*stats: DataFrame) -> DataFrame:
    """Statistics (key, value) of all sources, each row once."""
    return functools.reduce(DataFrame.unionByName, [s.select("key", F.col("value").cast("long").alias("value")) for s in stats]).distinct()


def project_unique_keys(project_tags: DataFrame, wikipages_keys: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that projects use: number of projects, of languages documenting the key (in_wiki), and of objects."""
    found = project_tags.groupBy("key").agg(F.countDistinct("project_id").alias("projects"))
    found = found.join(wikipages_keys.select("key", F.col("lang_count").alias("in_wiki")), "key", "left")
    found = found.join(keys.select("key", "count_all"), "key", "left")
    return found.select("key", "projects", F.coalesce("in_wiki", _zero()).alias("in_wiki"), F.coalesce("count_all", _zero()).alias("count_all"))


def project_unique_tags(project_tags: DataFrame, wikipages_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """The same for tags; entries about a key alone do not count."""
    by = ["key", "value"]
    found = project_tags.where("value is not null").groupBy(*by).agg(F.countDistinct("project_id").alias("projects"))
    found = found.join(wikipages_tags.select(*by, F.col("lang_count").alias("in_wiki")), by, "left")
    found = found.join(tags.select(*by, "count_all"), by, "left")
    return found.select(*by, "projects", F.coalesce("in_wiki", _zero()).alias("in_wiki"), F.coalesce("count_all", _zero()).alias("count_all"))


def _documented(pages: DataFrame, by: list[str]) -> DataFrame:
    """One row for each documented key or tag, and whether in English too."""
    return pages.groupBy(*by).agg(F.lit(True).alias("in_wiki"), F.bool_or(F.col("lang") == "en").alias("in_wiki_en"))


def _flags() -> list:
    return [F.coalesce(c, F.lit(False)).alias(c) for c in ("in_wiki", "in_wiki_en")]


def enrich_keys(keys: DataFrame, wikipages: DataFrame, project_unique_keys: DataFrame) -> DataFrame:
    """Adds documented keys that no object has (count 0), in_wiki, in_wiki_en and projects (null without any)."""
    keys = keys.drop("in_wiki", "in_wiki_en", "projects")
    about_key = F.col("value").isNull()
    known = wikipages.where("key is not null").groupBy("key").agg(
        F.bool_or(about_key).alias("in_wiki"), F.bool_or(about_key & (F.col("lang") == "en")).alias("in_wiki_en")
    )
    joined = keys.join(known, "key", "full").join(project_unique_keys.select("key", "projects"), "key", "left")
    filled = {c: F.coalesce(c, F.lit(0).cast(keys.schema[c].dataType)) for c in keys.columns if c.startswith(("count_", "values_", "users_", "cells_"))}
    filled |= {"grade": F.coalesce("grade", F.lit("u"))} if "grade" in keys.columns else {}
    return joined.withColumns(filled).select(*keys.columns, *_flags(), "projects")


def _tag_pages(wikipages: DataFrame) -> DataFrame:
    return wikipages.where("value is not null and value <> '*'")


def enrich_tags(tags: DataFrame, wikipages: DataFrame) -> DataFrame:
    """Adds in_wiki and in_wiki_en."""
    tags = tags.drop("in_wiki", "in_wiki_en")
    known = _documented(_tag_pages(wikipages), ["key", "value"])
    return tags.join(known, ["key", "value"], "left").select(*tags.columns, *_flags())


def top_tags(tag_combinations: DataFrame, tags: DataFrame, wikipages: DataFrame, project_unique_tags: DataFrame) -> DataFrame:
    """Tags that occur in combinations, with counts, documentation flags and projects (null without any)."""
    side = lambda n: tag_combinations.select(F.col(f"key{n}").alias("key"), F.col(f"value{n}").alias("value"))
    by = ["key", "value"]
    found = side(1).union(side(2)).where("value <> ''").distinct()
    found = found.join(tags.select(*by, *COUNTS), by, "left").join(_documented(_tag_pages(wikipages), by), by, "left")
    found = found.join(project_unique_tags.select(*by, "projects"), by, "left")
    return found.select(F.col("key").alias("skey"), F.col("value").alias("svalue"), *COUNTS, *_flags(), "projects")


def popular_keys(keys: DataFrame, wikipages: DataFrame, min_count: int = 1000) -> DataFrame:
    """Frequent keys with users and the pages about them and their tags."""
    pages = wikipages.groupBy("key").agg(
        F.count("*").alias("wikipages"), F.lit(True).alias("in_wiki"), F.bool_or(F.col("lang") == "en").alias("in_wiki_en")
    )
    often = keys.where(F.col("count_all") > min_count).select("key", F.col("count_all").alias("count"), F.col("users_all").alias("users"))
    return often.join(pages, "key", "left").select("key", "count", "users", F.coalesce("wikipages", _zero()).alias("wikipages"), *_flags())


def popular_metadata(popular: DataFrame) -> DataFrame:
    ends = [f(c).alias(f"{c}_{n}") for c in ("count", "users") for n, f in (("min", F.min), ("max", F.max))]
    deltas = [(F.max(c) - F.min(c)).alias(f"{c}_delta") for c in ("count", "users")]
    return popular.agg(F.count("*").alias("keys"), *ends, *deltas)


def popular_scores(popular: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds counts, users and pages scaled to 0..1 and the score made of them; a key with a colon has the lower name
    scale. Where all keys are alike in a measure its scale, and so the score, is null."""
    most = popular.agg(F.max("wikipages").alias("wikipages_max"))
    one_row = F.broadcast(metadata.crossJoin(most))
    scaled = popular.crossJoin(one_row).select(
        *popular.columns,
        fraction(F.col("count") - F.col("count_min"), "count_delta", None).alias("scale_count"),
        fraction(F.col("users") - F.col("users_min"), "users_delta", None).alias("scale_users"),
        fraction("wikipages", "wikipages_max", None).alias("scale_wiki"),
        F.when(F.col("key").contains(":"), 0.0).otherwise(1.0).alias("scale_name"),
    )
    return scaled.withColumn("scale1", F.expr("10 * scale_count + 8 * scale_users + 2 * scale_wiki + 2 * scale_name"))


def language_pages(languages: DataFrame, wikipages: DataFrame) -> DataFrame:
    """Adds languages that only the pages know, and how many keys and tags are documented in each."""
    more = wikipages.where("lang is not null").select(F.col("lang").alias("code")).distinct().join(languages, "code", "left_anti")
    every = languages.drop("wiki_key_pages", "wiki_tag_pages").unionByName(more, allowMissingColumns=True)
    pages = wikipages.groupBy(F.col("lang").alias("code")).agg(
        F.countDistinct(F.when(F.col("value").isNull(), F.col("key"))).alias("wiki_key_pages"),
        F.countDistinct(F.when(F.col("value").isNotNull(), F.struct("key", "value"))).alias("wiki_tag_pages"),
    )
    counts = [F.coalesce(c, _zero()).alias(c) for c in ("wiki_key_pages", "wiki_tag_pages")]
    return every.join(pages, "code", "left").select(*every.columns, *counts)


def suggestions(keys: DataFrame, prevalent_values: DataFrame, wikipages: DataFrame, min_count: int = 10_000, min_values: int = 1000, min_wiki: int = 100) -> DataFrame:
    """Keys and tags for completion: frequent ones, or less frequent ones with documentation, which counts tenfold."""
    often = (F.col("count_all") >= min_count) | F.col("in_wiki") & (F.col("count_all") >= min_wiki)
    of_keys = keys.where(often).select("key", F.lit(None).cast("string").alias("value"), F.col("count_all").alias("count"), "in_wiki")
    by = ["key", "value"]
    known = wikipages.where("value is not null").select(*by).distinct().withColumn("in_wiki", F.lit(True))
    values = prevalent_values.join(known, by, "left").withColumn("in_wiki", F.coalesce("in_wiki", F.lit(False)))
    wanted = (F.col("count") >= min_values) | F.col("in_wiki") & (F.col("count") >= min_wiki)
    plain = (F.col("fraction") > 0.01) & (number_prefix("value") == 0.0) & (F.length("value") <= 20)
    of_tags = values.where(wanted & plain).select(*by, "count", "in_wiki")
    every = of_keys.unionByName(of_tags).distinct()
    return every.withColumn("score", F.col("count") * (1 + F.col("in_wiki").cast("long") * 9))


def stats_series(history_stats: DataFrame, key: str) -> DataFrame:
    """A statistic over days."""
    return history_stats.where(F.col("key") == key).select("udate", "value").orderBy("udate")


def search_index(tags: DataFrame) -> DataFrame:
    """(field, token, pos, key, value, count_all): the words of keys and values, for look-ups by word and phrase."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    part = lambda c: tags.select(F.lit(c).alias("field"), F.posexplode(words(c)).alias("pos", "token"), "key", "value", "count_all")
    return part("key").unionByName(part("value"))


def search_postings(index: DataFrame) -> DataFrame:
    """(token, field, key, value, count_all, positions): a row for each word of a tag, to be stored in buckets by word."""
    return index.groupBy("token", "field", "key", "value", "count_all").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
