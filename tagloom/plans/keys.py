"""Queries about keys. ``t`` maps table names to DataFrames; parameters that are left out do not filter."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import COUNTS, TYPES, check_type, fraction, matching, required, sorted_page, top_per_group
from ..operators.counting import both_ways

Tables = Mapping[str, DataFrame]

#: Values of a key that are given out without paging.
MOST_VALUES = 1000
TOTAL_OF = {"all": "objects", "nodes": "nodes_with_tags", "ways": "ways", "relations": "relations"}
RTL = ("ar", "arc", "az-arab", "bgn", "ckb", "dv", "fa", "ha-arab", "he", "khw", "ks", "ku-arab", "mzn", "nqo", "pnb", "ps", "sd", "syr", "ug", "ur", "uz-arab", "yi")


def narrow(t: Tables, name: str, whole: str) -> DataFrame:
    """The table with just the counts where there is one, else the table that has them among others."""
    return t[name] if name in t else t[whole]


def direction(lang: Column) -> Column:
    """Writing direction of a language code; unknown without a code."""
    return F.when(lang.isNull(), "auto").when(F.lower(lang).isin(*RTL), "rtl").otherwise("ltr")


def totals(object_stats: DataFrame) -> DataFrame:
    """One row: the number of objects that fractions of each type refer to."""
    return object_stats.agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"total_{t}") for t, k in TOTAL_OF.items()])


def with_fractions(rows: DataFrame, object_stats: DataFrame) -> DataFrame:
    """Adds the fraction of all objects for each count; the totals are a single row."""
    named = [fraction(f"count_{t}", f"total_{t}").alias(f"count_{t}_fraction") for t in TYPES]
    return rows.crossJoin(F.broadcast(totals(object_stats))).select(*rows.columns, *named)


def by_type(row: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Four rows (type, ...) from one row of counts; zeros without that row. ``columns``: output name to prefix."""
    one = row.agg(*[F.coalesce(F.max(f"{p}_{t}"), F.lit(0)).cast("long").alias(f"{p}_{t}") for p in columns.values() for t in TYPES])
    rows = F.array(*[F.struct(F.lit(t).alias("type"), *[F.col(f"{p}_{t}").alias(n) for n, p in columns.items()]) for t in TYPES])
    return one.select(F.inline(rows))


def type_stats(counted: DataFrame, object_stats: DataFrame) -> DataFrame:
    total = functools.reduce(lambda c, t: c.when(F.col("type") == t, F.col(f"total_{t}")), TYPES[1:], F.when(F.col("type") == "all", F.col("total_all")))
    return counted.crossJoin(F.broadcast(totals(object_stats))).withColumn("count_fraction", fraction(F.col("count"), total)).drop(*[f"total_{t}" for t in TYPES])


def key_combinations(t: Tables, key: str, query=None, T="all", sort=None, order="desc", page=None, rp=None) -> DataFrame:
    """Keys that occur together with the key: how often, and which part of either key's objects that is."""
    required(key=key)
    n = f"count_{check_type(T)}"
    pairs = t.pairs_of(key) if hasattr(t, "pairs_of") else both_ways(t["key_combinations"], key)
    rows = pairs.select(F.col("key2").alias("other_key"), F.col(n).alias("together_count"))
    rows = matching(rows, query, "other_key").where("together_count > 0")
    own = narrow(t, "key_counts", "keys").where(F.col("key") == key).agg(F.max(n).alias("this_count"))
    other = narrow(t, "key_counts", "keys").select(F.col("key").alias("other_key"), F.col(n).alias("other_count"))
    found = rows.join(other, "other_key", "left").crossJoin(F.broadcast(own)).select(
        "other_key", "together_count", fraction("together_count", "this_count").alias("to_fraction"), fraction("together_count", "other_count").alias("from_fraction")
    )
    spec = {"together_count": [], "other_key": [], "from_fraction": [], "to_count": ["together_count"], "from_count": ["from_fraction", "together_count", "other_key"]}
    return sorted_page(found, spec, sort, order, page, rp)


def key_similar(t: Tables, key: str, query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Keys that are spelt alike."""
    required(key=key)
    pairs = t["similar_keys"]
    side = lambda a, b: pairs.where(F.col(f"key{a}") == key).select(F.col(f"key{b}").alias("other_key"), F.col(f"count_all{b}").alias("count_all"), "similarity")
    rows = matching(side(1, 2).unionAll(side(2, 1)), query, "other_key")
    spec = {"similarity": ["similarity", "count_all"], "other_key": [], "count_all": ["count_all", "similarity"]}
    return sorted_page(rows, spec, sort, order, page, rp)


def key_distribution(t: Tables, key: str, kind: str = "nodes") -> DataFrame:
    """Occupied grid cells of a key for nodes or ways."""
    required(key=key)
    return t["key_grid"].where((F.col("key") == key) & (F.col("object_type") == kind[0])).select("x", "y", "count")


def key_stats(t: Tables, key: str) -> DataFrame:
    """Objects, their share of all objects, and distinct values, by type."""
    required(key=key)
    return type_stats(by_type(narrow(t, "key_counts", "keys").where(F.col("key") == key), {"count": "count", "values": "values"}), narrow(t, "object_stats", "stats"))


def key_values(t: Tables, key: str, lang: str = "en", query=None, T="all", sort=None, order="desc", page=None, rp=None) -> DataFrame:
    """Values of a key with the description of the tag in a language, else in English. More than 1000 need paging."""
    required(key=key)
    n = f"count_{check_type(T)}"
    rows = matching(t["tags"].where((F.col("key") == key) & (F.col(n) > 0)), query, "value")
    if page is None:  # decided where the query runs
        few = rows.limit(MOST_VALUES + 1).agg((F.count("*") <= MOST_VALUES).alias("few"))
        error = F.raise_error(F.lit(f"over {MOST_VALUES} values: page and rp are needed"))
        rows = rows.crossJoin(F.broadcast(few)).where(F.when(F.col("few"), True).otherwise(error.cast("boolean"))).drop("few")
    own = t["keys"].where(F.col("key") == key).agg(F.max(n).alias("key_count"))

    def described(code: str, name: str) -> DataFrame:
        pages = t["wikipages"].where((F.col("key") == key) & (F.col("lang") == code) & F.col("value").isNotNull())
        return pages.groupBy("value").agg(F.max("description").alias(name))

    found = rows.join(described(lang, "own"), "value", "left").join(described("en", "english"), "value", "left")
    used = F.when(F.coalesce("own", F.lit("")) != "", lang).when(F.coalesce("english", F.lit("")) != "", "en")
    found = found.crossJoin(F.broadcast(own)).select(
        "value", *COUNTS, F.col(n).alias("count"), fraction(n, "key_count").alias("fraction"), "in_wiki",
        F.coalesce(F.nullif("own", F.lit("")), F.nullif("english", F.lit(""))).alias("description"), used.alias("desclang"), direction(used).alias("descdir"),
    )
    spec = {"count_all": [], "value": [], "count_nodes": [], "count_ways": [], "count_relations": [], "in_wiki": ["in_wiki", "!value"], "count": ["count"]}
    return sorted_page(found, spec, sort, order, page, rp)


def key_prevalent_values(t: Tables, key: str, min_fraction: float = 0.01, T="all") -> DataFrame:
    """Values with more than a share of the key's objects, and a row without value for the rest if there is any."""
    required(key=key)
    if not 0.001 <= min_fraction <= 1:
        raise ValueError("min_fraction must be from 0.001 to 1")
    n = f"count_{check_type(T)}"
    own = t["keys"].where(F.col("key") == key).agg(F.coalesce(F.max(n), F.lit(0)).alias("total"))
    rows = t["tags"].where(F.col("key") == key).select("value", F.col(n).alias("count")).crossJoin(F.broadcast(own))
    often = rows.where(F.col("count") > F.floor(F.col("total") * min_fraction))
    shown = often.select("value", "count", fraction("count", "total").alias("fraction"))
    rest = often.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("sum")).crossJoin(own).where("total > sum")
    left = F.col("total") - F.col("sum")
    return shown.unionByName(rest.select(F.lit(None).cast("string").alias("value"), left.alias("count"), fraction(left, "total").alias("fraction")))


def pages_with_images(pages: DataFrame, t: Tables) -> DataFrame:
    """Pages with language names and the image as a struct."""
    images, languages = t["wiki_images"], t["languages"]
    rows = pages.join(images, "image", "left").join(languages.select(F.col("code").alias("lang"), "native_name", "english_name"), "lang", "left")
    name = lambda c: F.coalesce(c, F.lit("(unknown)"))
    return rows.select(
        "lang", direction(F.col("lang")).alias("dir"), name("native_name").alias("language"), name("english_name").alias("language_en"),
        "title", "description",
        F.struct("image", *[c for c in images.columns if c != "image"]).alias("image"),
        *[c for c in ("on_node", "on_way", "on_area", "on_relation", "tags_implies", "tags_combination", "tags_linked", "approval_status", "statuslink", "tgroup", "rendering") if c in pages.columns],
    )


def key_wiki_pages(t: Tables, key: str) -> DataFrame:
    required(key=key)
    return pages_with_images(t["wikipages"].where((F.col("key") == key) & F.col("value").isNull()), t)


def on_type(T: str) -> Column:
    """Whether a project entry is about a type of objects; areas are made of ways and relations."""
    flags = {"all": None, "nodes": ["on_node"], "ways": ["on_way", "on_area"], "relations": ["on_relation", "on_area"]}[check_type(T)]
    return F.lit(True) if flags is None else functools.reduce(Column.__or__, [F.col(f) for f in flags])


def key_projects(t: Tables, key: str, query=None, T="all", sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Entries of projects about the key or its tags."""
    required(key=key)
    rows = t["project_tags"].where((F.col("key") == key) & on_type(T))
    found = rows.drop("icon_url", "doc_url").join(t["projects"].where("status = 'OK'").select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "icon_url"), "project_id")
    found = matching(found, query, "project_name", "value")
    return sorted_page(found, {"project_name": ["lower(project_name)", "value"], "tag": ["value", "lower(project_name)"]}, sort, order, page, rp)


def key_chronology(t: Tables, key: str) -> DataFrame:
    required(key=key)
    return t["key_chronology"].where(F.col("key") == key).select("date", "nodes", "ways", "relations").orderBy("date")


def _descriptions(pages: DataFrame) -> DataFrame:
    entry = F.struct("lang", F.struct(F.col("description").alias("text"), direction(F.col("lang")).alias("dir")).alias("d"))
    rows = pages.where("description is not null and description <> '' and lang is not null")
    rows = rows.groupBy("lang").agg(F.min_by("description", "title").alias("description"))  # of several pages the first by title
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("description"))


def key_overview(t: Tables, key: str) -> DataFrame:
    """One nested row of everything about a key."""
    required(key=key)
    counts = key_stats(t, key).agg(F.collect_list(F.struct("type", "count", "count_fraction", "values")).alias("counts"))
    own = t["keys"].where(F.col("key") == key).agg(F.coalesce(F.max("users_all"), F.lit(0)).alias("users"), F.coalesce(F.max("count_nodes") + F.max("count_ways"), F.lit(0)).alias("mapped"))
    projects = t["project_tags"].where(F.col("key") == key).agg(F.countDistinct("project_id").alias("projects"))
    values = t["prevalent_values"].where(F.col("key") == key).agg(F.sort_array(F.collect_list(F.struct("count", "value", F.round("fraction", 4).alias("fraction"))), False).alias("prevalent_values"))
    pages = t["wikipages"].where((F.col("key") == key) & F.col("value").isNull())
    listed = pages.agg(F.array_sort(F.collect_list(F.struct("lang", "title", "status"))).alias("wiki_pages"))
    one = functools.reduce(DataFrame.crossJoin, [counts, own, projects, values, listed, _descriptions(pages)])
    return one.select(F.lit(key).alias("key"), "counts", "users", "projects", "prevalent_values", "wiki_pages", (F.col("mapped") > 0).alias("has_map"), "description")


KEY_FILTERS = {f"characters_{c}" for c in ("plain", "colon", "letters", "space", "problem", "rest")}


def keys_all(t: Tables, query=None, filters: list[str] = (), include: list[str] = (), sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """All keys with their fractions. Filters (all must hold): characters_plain, ..._colon, ..._letters, ..._space,
    ..._problem, ..._rest, in_wiki, not_in_db. ``include`` adds wikipages or prevalent_values (the ten most frequent)."""
    rows = matching(t["keys"], query, "key")
    for f in filters:
        if f in KEY_FILTERS:
            rows = rows.where(F.col("characters") == f.removeprefix("characters_"))
        elif f == "in_wiki":
            rows = rows.where("in_wiki")
        elif f == "not_in_db":
            rows = rows.where("count_all = 0")
        else:
            raise ValueError(f"unknown filter {f!r}")
    kept = ["key", *COUNTS, "values_all", "users_all", "in_wiki", "in_wiki_en", "projects"]
    found = with_fractions(rows.select(*kept), narrow(t, "object_stats", "stats"))
    if "wikipages" in include:
        pages = t["wikipages"].where("value is null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lang", "title", "status"))).alias("wikipages"))
        found = found.join(pages, "key", "left")
    if "prevalent_values" in include:
        found = found.join(top_values(t), "key", "left")
    spec = {n: [] for n in ["key", *COUNTS, "values_all", "users_all", "in_wiki"]} | {"projects": ["projects", "key"], "length": ["length(key)", "key"]}
    return sorted_page(found, spec, sort, order, page, rp)


def top_values(t: Tables, k: int = 10) -> DataFrame:
    row = F.struct("value", "count", F.round("fraction", 4).alias("fraction"))
    return top_per_group(t["prevalent_values"], ["key"], [F.desc("count"), F.asc("value")], k, row, "prevalent_values")


def keys_wiki_pages(t: Tables, query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Languages with pages about each key and their status."""
    rows = matching(t["wikipages_keys"], query, "key").select("key", "langs", "lang_count")
    return sorted_page(rows, {"key": []}, sort, order, page, rp)


def keys_similar(t: Tables, query=None, min_common: int = 10_000, sort=None, order="desc", page=None, rp=None) -> DataFrame:
    """Common keys with rare ones that are spelt alike."""
    rows = t["similar_keys_common_rare"].where((F.col("similarity") != 0) | (F.lower("key_common") == F.lower("key_rare")))
    rows = matching(rows.where(F.col("count_all_common") >= min_common), query, "key_common", "key_rare")
    spec = {
        "count_all_common": ["count_all_common", "!count_all_rare", "!similarity"],
        "key_common": ["key_common", "key_rare"],
        "key_rare": ["key_rare", "key_common"],
        "count_all_rare": ["count_all_rare", "!count_all_common", "similarity"],
        "similarity": ["similarity", "!count_all_common", "!count_all_rare"],
    }
    return sorted_page(rows, spec, sort, order, page, rp)


def keys_without_wiki_page(t: Tables, min_count: int = 10_000, english: bool = False, query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Frequent keys that no page (or no English page) describes; the fraction is not rounded."""
    missing = ~F.col("in_wiki_en") if english else ~F.col("in_wiki")
    rows = matching(t["keys"].where((F.col("count_all") > min_count) & missing), query, "key")
    total = totals(narrow(t, "object_stats", "stats")).select("total_all")
    found = rows.crossJoin(F.broadcast(total)).select("key", "count_all", fraction("count_all", "total_all", None).alias("count_all_fraction"), "values_all", "users_all", "in_wiki", "in_wiki_en")
    return sorted_page(found.join(top_values(t), "key", "left"), {"key": [], "count_all": [], "values_all": [], "users_all": []}, sort, order, page, rp)


def keys_discardable(t: Tables, wiki_status: tuple[str, ...] = ("discardable",), sources: tuple[str, ...] = ("id", "josm"), query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Keys that the wiki or an editor lists as discardable, and by whom."""
    wiki = t["wikipages_keys"].where(F.col("approval_status").isin(*wiki_status)).select("key", F.lit(True).alias("wiki"))
    editors = t["discardable_tags"].groupBy("key").agg(*[F.bool_or(F.col("source") == s).alias(s) for s in sources])
    both = wiki.join(editors, "key", "full").join(t["keys"].select("key", "count_all"), "key")
    rows = both.select("key", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("wiki", *sources)], "count_all")
    return sorted_page(matching(rows, query, "key"), {n: [] for n in ("key", "wiki", *sources, "count_all")}, sort, order, page, rp)
