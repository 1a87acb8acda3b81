"""Every job and query over the bridged tables of a data set, by name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import batch
from ..bridge import LIMITS, Tables
from ..operators import chronology, counting, integration, projects, registries, wiki
from . import documentation, keys, relations, reports, search, tags
from . import projects as project_queries

END = date(2024, 12, 31)


def _as_text(c: Column, kind) -> Column:
    """A value as text that every engine writes alike; fields of structs are joined by colons."""
    name = kind.typeName()
    if name == "struct":
        return F.concat_ws(":", *[_as_text(c[f.name], f.dataType) for f in kind.fields])
    return c.cast("decimal(20,6)").cast("string") if name == "double" else c.cast("string")


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays and maps as text (sorted, fields of structs joined by colons), to compare rows with other engines."""

    def text(name: str) -> Column:
        kind = df.schema[name].dataType
        if kind.typeName() == "map":
            return F.transform(F.map_entries(name), lambda x: F.concat_ws(":", _as_text(x["key"], kind.keyType), _as_text(x["value"], kind.valueType)))
        return F.transform(name, lambda x: _as_text(x, kind.elementType))

    return df.withColumns({name: F.array_join(F.array_sort(text(name)), ",") for name in columns})


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in columns})


def _images(df: DataFrame) -> DataFrame:
    """Pages with the fields of their image as columns."""
    return df.select(*[c for c in df.columns if c != "image"], "image.*")


def _cells(t: Tables) -> DataFrame:
    return counting.grid_cells(t["key_grid"])


def _facts(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "image"], "image.image", F.col("image.url").alias("image_url"))


def _sketched_users(t: Tables) -> DataFrame:
    """Distinct users, and whether the merged sketches of two halves of the objects estimate them within a twentieth."""
    halves = [counting.user_sketches(t["object_tags"].where(F.col("oid") % 2 == k)) for k in (0, 1)]
    near = counting.sketched_users(counting.merged_users(*halves)).withColumnRenamed("users_all", "near")
    close = F.abs(F.col("near") - F.col("users_all")) <= F.greatest(F.col("users_all") / 20, F.lit(1))
    return counting.key_users(t["object_tags"]).join(near, "key").select("key", "users_all", close.alias("close"))


def _merged(t: Tables, by_value: bool) -> DataFrame:
    """The series of the older versions with the newer ones merged in from the last states."""
    last = t["history"].agg((F.max("version") * 0.6).alias("cut"))
    rows = t["history"].crossJoin(F.broadcast(last))
    old, new = rows.where("version <= cut").drop("cut"), rows.where("version > cut").drop("cut")
    series = chronology.tag_chronology(old) if by_value else chronology.key_chronology(old)
    return chronology.add_series(series, chronology.merge_day(chronology.object_states(old), new, by_value)[0])


_NESTED = ("counts", "prevalent_values", "wiki_pages", "description")


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "b0_explode_tags": lambda t: t["object_tags"],
    "b1_tag_stats": lambda t: t["plain_tags"],
    "b2_key_stats": lambda t: counting.key_stats(t["plain_tags"]),
    "b3_key_users": lambda t: counting.key_users(t["object_tags"]),
    "b3_user_sketches": _sketched_users,
    "b4_object_stats": lambda t: counting.object_stats(t["objects"]),
    "b5_key_combinations": lambda t: t["key_combinations"],
    "b6_tag_combinations": lambda t: t["tag_combinations"],
    "b7_relation_types": lambda t: t["plain_relation_types"],
    "b8_relation_roles": lambda t: t["relation_roles"],
    "b9_relation_types_topup": lambda t: t["relation_types"],
    "b10_prevalent_values": lambda t: t["prevalent_values"].withColumn("fraction", F.round("fraction", 8)),
    "b11_prevalent_roles": lambda t: t["prevalent_roles"],
    "b12_key_grid": lambda t: t["key_grid"],
    "b12_tag_grid": lambda t: t["tag_grid"],
    "b13_key_cells": _cells,
    "b14_similar_keys": lambda t: t["similar_keys"].select("key1", "key2", "similarity"),
    "b15_similar_keys_counts": lambda t: t["similar_keys"],
    "b16_similar_keys_common_rare": lambda t: t["similar_keys_common_rare"],
    "b17_character_class": lambda t: t["plain_keys"].select("key", "characters"),
    "b18_key_grade": lambda t: t["plain_keys"].select("key", "grade"),
    "b19_db_stats": lambda t: batch.statistics(t, counting.table_counters()).unionByName(t["object_stats"]),
    "b21_interesting_tags": lambda t: t.selection()["interesting_tags"],
    "b21_frequent_tags": lambda t: t.selection()["frequent_tags"],
    "b21_interesting_relation_types": lambda t: t.selection()["interesting_relation_types"],
    "b22_selection_stats": lambda t: counting.selection_stats(t.selection()),
    "c1_key_chronology": lambda t: t["key_chronology"],
    "c1_key_chronology_merged": lambda t: _merged(t, False),
    "c2_tag_chronology": lambda t: t["tag_chronology"],
    "c2_tag_chronology_merged": lambda t: _merged(t, True),
    "c2_object_states": lambda t: joined(chronology.object_states(t["history"]), "tags"),
    "c3_first_use": lambda t: chronology.first_use(t["history"]),
    "c4_smoothness": lambda t: chronology.smoothness(t["key_chronology"]).withColumn("smoothness", F.round("smoothness", 8)),
    "c5_cumulative": lambda t: chronology.cumulative(t["key_chronology"], end=END),
    "c6_chronology_stats": lambda t: chronology.chronology_stats(t["key_chronology"], t["history"]),
    "d13_page_status": lambda t: t["wikipages"].select("title", "status"),
    "d14_wikipages_keys": lambda t: joined(t["wikipages_keys"], "langs"),
    "d15_wikipages_tags": lambda t: joined(t["wikipages_tags"], "langs"),
    "d16_inconsistent_keys": lambda t: t["inconsistent_status_keys"],
    "d16_inconsistent_tags": lambda t: t["inconsistent_status_tags"],
    "d17_wiki_languages": lambda t: t["wiki_languages"],
    "d18_wiki_stats": lambda t: batch.statistics(t, wiki.table_counters()),
    "d19_image_titles": lambda t: wiki.image_titles(t["wikipages"], t["relation_pages"]),
    "d22_wiki_words": lambda t: joined(t["words"], "words"),
    "e3_project_counters": lambda t: projects.project_counters(t["projects"], t["project_tags"]),
    "e4_project_stats": lambda t: projects.project_stats(t["projects"], t["project_tags"]),
    "g2_sw_stats": lambda t: registries.sw_stats(t["discardable_tags"].select("key"), t["discardable_tags"]),
    "m2_master_stats": lambda t: t["stats"],
    "m3_project_unique_keys": lambda t: t["project_unique_keys"],
    "m4_project_unique_tags": lambda t: t["project_unique_tags"],
    "m5_keys": lambda t: t["keys"],
    "m6_tags": lambda t: t["tags"],
    "m7_top_tags": lambda t: t["top_tags"],
    "m8_popular_keys": lambda t: rounded(t["popular_keys"], "scale_count", "scale_users", "scale_wiki", "scale1"),
    "m9_popular_metadata": lambda t: integration.popular_metadata(t["popular_keys"]),
    "m10_popular_scores": lambda t: t["popular_keys"].select("key", F.round("scale1", 8).alias("scale1")),
    "m11_language_pages": lambda t: t["languages"],
    "m12_suggestions": lambda t: t["suggestions"],
    "m13_stats_series": lambda t: integration.stats_series(t["history_stats"], "click"),
    "m14_search_index": lambda t: t["search_index"],
    "m14_search_postings": lambda t: joined(t["search_postings"], "positions"),
    "d22_word_grams": lambda t: t["word_grams"],
    "q1_key_combinations": lambda t: keys.key_combinations(t, "priority"),
    "q1_key_combinations_nodes": lambda t: keys.key_combinations(t, "type", query="n", T="relations"),
    "q2_key_similar": lambda t: keys.key_similar(t, "old rod"),
    "q3_key_distribution": lambda t: keys.key_distribution(t, "urgent"),
    "q4_key_stats": lambda t: keys.key_stats(t, "type"),
    "q5_key_values": lambda t: keys.key_values(t, "brand", "de"),
    "q6_prevalent_values": lambda t: keys.key_prevalent_values(t, "priority", 0.2),
    "q7_key_wiki_pages": lambda t: _images(keys.key_wiki_pages(t, "type")),
    "q8_key_projects": lambda t: keys.key_projects(t, "brand", T="ways"),
    "q9_key_chronology": lambda t: keys.key_chronology(t, "click"),
    "q10_key_overview": lambda t: joined(keys.key_overview(t, "type"), *_NESTED),
    "q11_keys_all": lambda t: joined(keys.keys_all(t, include=["prevalent_values", "wikipages"]), "prevalent_values", "wikipages"),
    "q11_keys_filtered": lambda t: keys.keys_all(t, query="R", filters=["characters_space"]),
    "q12_keys_wiki_pages": lambda t: joined(keys.keys_wiki_pages(t), "langs"),
    "q13_keys_similar": lambda t: keys.keys_similar(t, min_common=20),
    "q14_keys_without_wiki_page": lambda t: joined(rounded(keys.keys_without_wiki_page(t, 100), "count_all_fraction"), "prevalent_values"),
    "q15_keys_discardable": lambda t: keys.keys_discardable(t, ("approved", "proposed")),
    "q16_tag_combinations": lambda t: tags.tag_combinations(t, "priority", "1-URGENT"),
    "q17_tag_distribution": lambda t: tags.tag_distribution(t, "status", "P"),
    "q18_tag_stats": lambda t: tags.tag_stats(t, "priority", "5-LOW"),
    "q19_tag_wiki_pages": lambda t: _images(tags.tag_wiki_pages(t, "type", "BUILDING")),
    "q20_tag_projects": lambda t: tags.tag_projects(t, "brand", "Brand#11"),
    "q21_tag_chronology": lambda t: tags.tag_chronology(t, "click", "0"),
    "q22_tag_overview": lambda t: joined(tags.tag_overview(t, "status", "O"), "counts", "wiki_pages", "description"),
    "q23_tags_list": lambda t: joined(tags.tags_list(t, tags="status=O,P,priority=*"), "wiki"),
    "q23_tags_of_key": lambda t: joined(tags.tags_list(t, key="brand"), "wiki"),
    "q24_tags_popular": lambda t: tags.tags_popular(t),
    "q25_relation_roles": lambda t: relations.relation_roles(t, "BUILDING"),
    "q26_relation_stats": lambda t: relations.relation_stats(t, "BUILDING"),
    "q27_relation_wiki_pages": lambda t: _images(relations.relation_wiki_pages(t, "BUILDING")),
    "q28_relation_projects": lambda t: relations.relation_projects(t, "BUILDING"),
    "q29_relations_all": lambda t: joined(rounded(relations.relations_all(t), "count_fraction"), "prevalent_roles"),
    "q30_relations_roles": lambda t: relations.relations_roles(t, query="u"),
    "q31_search_key_and_value": lambda t: search.by_key_and_value(t, "brand=brand"),
    "q31_search_phrase": lambda t: search.by_key_and_value(t, '"not specified"'),
    "q32_search_keyword": lambda t: search.by_keyword(t, "tion"),
    "q33_search_role": lambda t: search.by_role(t, "low"),
    "q34_search_value": lambda t: search.by_value(t, "urgent"),
    "q35_suggest": lambda t: search.suggest(t, "p"),
    "q36_project_tags": lambda t: project_queries.project_tags(t, "Supplier#000000002"),
    "q37_projects_all": lambda t: project_queries.projects_all(_with_counters(t)),
    "q38_projects_keys": lambda t: project_queries.projects_keys(t),
    "q39_projects_tags": lambda t: project_queries.projects_tags(t, query="1"),
    "q42_wiki_languages": lambda t: rounded(documentation.wiki_languages(t), "wiki_key_pages_fraction", "wiki_tag_pages_fraction"),
    "q43_wiki_key_status": lambda t: joined(documentation.wiki_key_status(t), "languages"),
    "q44_wiki_tag_status": lambda t: joined(documentation.wiki_tag_status(t, "none"), "languages"),
    "q45_inconsistent_key_status": lambda t: joined(documentation.inconsistent_key_status(t), "statuses"),
    "q46_inconsistent_tag_status": lambda t: joined(documentation.inconsistent_tag_status(t), "statuses"),
    "q47_wiki_problems": lambda t: documentation.wiki_problems(t, "PAGE 1"),
    "r1_key_lengths": lambda t: reports.key_lengths(t),
    "r2_characters_in_keys": lambda t: reports.characters_in_keys(t),
    "r3_historic_development": lambda t: reports.historic_development(t, ("click", "view")),
    "r4_pages_about_missing_keys": lambda t: joined(reports.pages_about_missing_keys(t), "wikipages"),
    "r6_tag_cloud": lambda t: rounded(reports.tag_cloud(t), "scale1"),
    "r7_top_tags": lambda t: reports.top_tags(t, without=("status",)),
    "r7_top_relation_types": lambda t: reports.top_relation_types(t),
    "r8_status_table": lambda t: reports.status_table(t),
    "r9_status_choices": lambda t: reports.status_choices(t),
    "r10_frequent_statuses": lambda t: reports.frequent_statuses(t),
    "r11_image_sizes": lambda t: reports.image_sizes(t),
    "r13_language_comparison": lambda t: reports.language_comparison(t, ["en", "de"]),
    "r14_problems_by_lang": lambda t: reports.problems_by(t, "lang"),
    "r15_object_ratios": lambda t: reports.object_ratios(t),
    "r16_discardable_by_source": lambda t: reports.discardable_by_source(t),
    "r17_compare": lambda t: joined(reports.compare(t, [("status", None), ("status", "O")]), "counts", "wiki_pages", "description"),
    "r18_page_facts": lambda t: joined(_facts(reports.page_facts(t, "brand", locale="de")), "discardable_by"),
    "r20_project_overview": lambda t: reports.project_overview(t, F.lit("2024-01-09").cast("timestamp")),
    "r22_embed_counts": lambda t: reports.embed_counts(t, "type"),
    "r22_embed_roles": lambda t: reports.embed_roles(t, "BUILDING"),
    "r25_value_treemap": lambda t: reports.value_treemap(t, "year"),
    "r25_role_treemap": lambda t: reports.role_treemap(t, "BUILDING", 0.2),
}


class _with_counters(dict):
    """The tables with counted projects."""

    def __init__(self, t: Tables):
        self.t = t

    def __getitem__(self, name: str) -> DataFrame:
        return projects.project_counters(self.t["projects"], self.t["project_tags"]) if name == "projects" else self.t[name]


def bound(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bound(q) for name, q in QUERIES.items()}


__all__ = ["LIMITS", "QUERIES", "queries"]
