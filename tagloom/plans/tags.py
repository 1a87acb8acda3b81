"""Queries about tags. ``t`` maps table names to DataFrames; parameters that are left out do not filter."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import COUNTS, check_type, fraction, matching, required, sorted_page
from ..operators.counting import both_ways
from .keys import Tables, _descriptions, by_type, direction, narrow, on_type, pages_with_images, type_stats, with_fractions


def _is(key: str, value: str):
    required(key=key, value=value)
    return (F.col("key") == key) & (F.col("value") == value)


def tag_combinations(t: Tables, key: str, value: str, query=None, T="all", sort=None, order="desc", page=None, rp=None) -> DataFrame:
    """Tags and keys (value '') that occur together with the tag. A tag partner is measured by the tag's objects, a key
    partner by the key's."""
    n = f"count_{check_type(T)}"
    own = t["tags"].where(_is(key, value)).agg(F.max(n).alias("this_count"))
    pairs = t.tag_pairs_of(key, value) if hasattr(t, "tag_pairs_of") else both_ways(t["tag_combinations"], key).where(F.col("value1") == value)
    rows = pairs.select(F.col("key2").alias("other_key"), F.col("value2").alias("other_value"), F.col(n).alias("together_count"))
    rows = matching(rows, query, "other_key", "other_value").where("together_count > 0")
    tags = t["tags"].select(F.col("key").alias("other_key"), F.col("value").alias("other_value"), F.col(n).alias("tag_count"))
    keys = t["keys"].select(F.col("key").alias("other_key"), F.col(n).alias("key_count"))
    found = rows.join(tags, ["other_key", "other_value"], "left").join(keys, "other_key", "left").crossJoin(F.broadcast(own))
    other = F.when(F.col("other_value") == "", F.col("key_count")).otherwise(F.col("tag_count"))
    found = found.select("other_key", "other_value", "together_count", fraction("together_count", "this_count").alias("to_fraction"), fraction(F.col("together_count"), other).alias("from_fraction"))
    spec = {"together_count": [], "other_key": [], "other_value": [], "from_fraction": [], "other_tag": ["other_key", "other_value"]}
    return sorted_page(found, spec, sort, order, page, rp)


def _grid(t: Tables, key: str, value: str) -> DataFrame:
    return t.tag_grid_of(key, value) if hasattr(t, "tag_grid_of") else t["tag_grid"].where(_is(key, value))


def tag_distribution(t: Tables, key: str, value: str, kind: str = "nodes") -> DataFrame:
    return _grid(t, key, value).where(F.col("object_type") == kind[0]).select("x", "y", "count")


def tag_stats(t: Tables, key: str, value: str) -> DataFrame:
    """Objects and their share of all objects, by type."""
    return type_stats(by_type(t["tags"].where(_is(key, value)), {"count": "count"}), narrow(t, "object_stats", "stats"))


def tag_wiki_pages(t: Tables, key: str, value: str) -> DataFrame:
    return pages_with_images(t["wikipages"].where(_is(key, value)), t)


def tag_projects(t: Tables, key: str, value: str, query=None, T="all", sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Per project its most specific entry: one about the tag if there is one, else the one about the key."""
    required(key=key, value=value)
    about = (F.col("key") == key) & (F.col("value").isNull() | (F.col("value") == value)) & on_type(T)
    rows = t["project_tags"].where(about)
    best = rows.groupBy(F.col("project_id").alias("best_id")).agg(F.max("value").alias("best"))
    exact = rows.join(best, (F.col("project_id") == F.col("best_id")) & F.col("value").eqNullSafe(F.col("best"))).drop("best_id", "best")
    found = exact.drop("icon_url", "doc_url").join(t["projects"].where("status = 'OK'").select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "icon_url"), "project_id")
    found = matching(found, query, "project_name", "value")
    return sorted_page(found, {"project_name": ["lower(project_name)", "value"], "tag": ["!value", "lower(project_name)"]}, sort, order, page, rp)


def tag_chronology(t: Tables, key: str, value: str) -> DataFrame:
    return t["tag_chronology"].where(_is(key, value)).select("date", "nodes", "ways", "relations").orderBy("date")


def tag_overview(t: Tables, key: str, value: str) -> DataFrame:
    """One nested row of everything about a tag."""
    counts = tag_stats(t, key, value).agg(F.collect_list(F.struct("type", "count", "count_fraction")).alias("counts"))
    projects = t["project_unique_tags"].where(_is(key, value)).agg(F.coalesce(F.max("projects"), F.lit(0)).alias("projects"))
    grid = _grid(t, key, value).limit(1).agg((F.count("*") > 0).alias("has_map"))
    pages = t["wikipages"].where(_is(key, value))
    listed = pages.agg(F.array_sort(F.collect_list(F.struct("lang", "title", "status"))).alias("wiki_pages"))
    one = functools.reduce(DataFrame.crossJoin, [counts, projects, grid, listed, _descriptions(pages)])
    return one.select(F.lit(key).alias("key"), F.lit(value).alias("value"), "counts", "projects", "wiki_pages", "has_map", "description")


def parse_tag_list(text: str) -> list[tuple[str, str | None]]:
    """Tags of a list such as ``k=v1,v2,k2=v3``; a value of * is the key itself."""
    out: list[tuple[str, str | None]] = []
    key = None
    for part in filter(None, text.split(",")):
        if "=" in part:
            key, _, part = part.partition("=")
        if key is None:
            raise ValueError(f"no key for {part!r}")
        out.append((key, None if part == "*" else part))
    return out


def tags_list(t: Tables, key: str | None = None, tags: str | None = None) -> DataFrame:
    """Listed tags (or all documented values of a key) with counts, and per language description and images; flags come
    from the English page, else from the first. Tags that neither objects nor pages have are left out."""
    if bool(key) == bool(tags):
        raise ValueError("either key or tags is needed")
    pages = t["wikipages"]
    if key:
        wanted = pages.where((F.col("key") == key) & F.col("value").isNotNull() & (F.col("value") != "*")).select("key", "value").distinct()
    else:
        wanted = pages.sparkSession.createDataFrame(parse_tag_list(tags), "key string, value string").distinct()
    entry = F.struct("lang", F.struct("description", "image", "rendering").alias("page"))
    first = lambda c: F.min_by(c, F.struct(F.col("lang") != "en", "lang", "title")).alias(c)
    chosen = pages.alias("p").join(wanted.alias("w"), (F.col("p.key") == F.col("w.key")) & F.col("p.value").eqNullSafe(F.col("w.value")), "left_semi")
    one = F.min_by(F.struct("lang", "title", "description", "image", "rendering", "on_node", "on_way", "on_area", "on_relation"), "title").alias("page")
    each = chosen.groupBy("key", "value", "lang").agg(one).select("key", "value", "page.*")  # of several pages the first by title
    documented = each.groupBy("key", "value").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("wiki"), *[first(c) for c in ("on_node", "on_way", "on_area", "on_relation")]
    )
    counted = t["tags"].select("key", "value", *COUNTS).unionByName(t["keys"].select("key", F.lit(None).cast("string").alias("value"), *COUNTS))
    w, d, c = wanted, documented.withColumnsRenamed({"key": "dk", "value": "dv"}), counted.withColumnsRenamed({"key": "ck", "value": "cv"})
    rows = w.join(d, (F.col("key") == F.col("dk")) & F.col("value").eqNullSafe(F.col("dv")), "left")
    rows = rows.join(c, (F.col("key") == F.col("ck")) & F.col("value").eqNullSafe(F.col("cv")), "left").where("dk is not null or ck is not null")
    rows = rows.select("key", "value", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in COUNTS], "wiki", "on_node", "on_way", "on_area", "on_relation")
    return with_fractions(rows, narrow(t, "object_stats", "stats"))


def tags_popular(t: Tables, query=None, sort=None, order="desc", page=None, rp=None) -> DataFrame:
    """Tags that occur in combinations, with their fractions."""
    rows = with_fractions(matching(t["top_tags"], query, "skey", "svalue"), narrow(t, "object_stats", "stats"))
    spec = {"tag": ["skey", "svalue"], **{c: [] for c in COUNTS}, "in_wiki": [], "projects": ["projects", "skey"]}
    return sorted_page(rows, spec, sort, order, page, rp)


__all__ = ["direction", "parse_tag_list", "tag_chronology", "tag_combinations", "tag_distribution", "tag_overview", "tag_projects", "tag_stats", "tag_wiki_pages", "tags_list", "tags_popular"]
