"""Readers, sinks, documentation, project and registry jobs over the raw inputs of a data set, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import projects, registries, wiki
from ..raw import Raw
from ..sources import catalog, readers
from . import documentation, reports
from .registered import joined

def _now(day: str = "2024-01-10") -> Column:
    return F.lit(f"{day} 00:00:00").cast("timestamp")


def _kept(t: Raw, df: DataFrame, kind: str = "parquet") -> str:
    path = catalog.scratch(t.spark)
    df.write.format(kind).save(path)
    return path


def _objects(t: Raw) -> DataFrame:
    """Objects written and read: counts and sums of every part of them, by type."""
    rows = t["objects"].withColumns({"version": F.lit(1), "visible": F.lit(True)})
    found = readers.read_objects(t.spark, _kept(t, rows))
    return found.groupBy("otype").agg(
        F.count("*").alias("n"), F.sum("oid").alias("oids"), F.sum("uid").alias("uids"), F.sum(F.size("tags")).alias("tags"),
        F.sum(F.coalesce(F.cardinality("nds"), F.lit(0))).alias("nds"), F.sum(F.coalesce(F.cardinality("members"), F.lit(0))).alias("members"),
        F.sum(F.round(F.col("lon") * 100).cast("long")).alias("lon"), F.count_if("visible").alias("visible"),
    )


def _history(t: Raw) -> DataFrame:
    found = readers.read_history(t.spark, _kept(t, t["history"].withColumn("version", F.col("version").cast("int"))))
    return found.groupBy("otype").agg(F.count("*").alias("n"), F.sum("version").alias("versions"), F.count_if("visible").alias("visible"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def _languages(t: Raw) -> DataFrame:
    path = catalog.scratch(t.spark)
    code = F.col("lang")
    rows = t["documents"].where(code.isNotNull()).select(code.alias("code"), code.alias("iso639_1"), F.concat(F.lit("language, "), code).alias("english_name"), F.upper("lang").alias("native_name")).distinct()
    rows.write.option("header", True).csv(path)
    return readers.languages_dim(t.spark, path)


def _catalog(t: Raw) -> DataFrame:
    """Keys and roles written as tables, and read by name."""
    path = catalog.scratch(t.spark)
    catalog.write_tables({"keys": t["plain_keys"], "relation_roles": t["relation_roles"]}, path, {"relation_roles": ["rtype"]})
    found = catalog.Catalog(t.spark, path, ["keys", "relation_roles"])
    roles = found["relation_roles"].groupBy(F.col("rtype").alias("name")).agg(F.count("*").alias("n"), F.sum("count_all").alias("count_all"))
    return roles.unionByName(found["keys"].groupBy(F.col("characters").alias("name")).agg(F.count("*").alias("n"), F.sum("count_all").alias("count_all")))


def _csv(t: Raw) -> DataFrame:
    path = catalog.scratch(t.spark)
    catalog.write_csv(t["plain_tags"], path, ["key", "value", "count_all"])
    return t.spark.read.schema("key string, value string, count_all long").csv(path, header=True)


def _envelope(t: Raw) -> DataFrame:
    rows = t["prevalent_roles"].where("rtype = 'BUILDING'").select("role", "count")
    made = catalog.result_envelope(rows.orderBy("role").limit(2), rows, "/roles", page_no=1, rp=2)
    schema = "url string, data_until string, page int, rp int, total long, data array<struct<role:string,count:long>>"
    return joined(made.select(F.from_json("value", schema).alias("v")).select("v.*"), "data")


def _appended(t: Raw) -> DataFrame:
    """Statistics of two days, the second written twice."""
    path = catalog.scratch(t.spark)
    stats = t["object_stats"]
    for day, factor in (("2024-01-01", 1), ("2024-01-02", 5), ("2024-01-02", 2)):
        catalog.append_history(stats.withColumn("value", F.col("value") * factor), path, F.lit(day))
    return t.spark.read.parquet(path).select("key", F.col("value").cast("long").alias("value"), F.col("udate").cast("date").alias("udate"))


def _metrics(t: Raw) -> DataFrame:
    return catalog.metrics({"keys": t["plain_keys"], "tags": t["plain_tags"]}, t["sources"], t["image_cache"], _now("2024-04-01"))


def _templates(t: Raw) -> DataFrame:
    found = wiki.extract_templates(t["raw_pages"])
    each = F.transform("templates", lambda x: F.concat(x["name"], F.lit("("), F.array_join(x["params"], ";"), F.lit(")")))
    return found.select("title", "parsed", F.array_join(each, " ").alias("templates"))


def _pages(t: Raw, *columns: str) -> DataFrame:
    found = t.documentation()["wikipages"].select("title", *columns)
    return joined(found, *[c for c in columns if c.startswith("tags_")])


def _names(t: Raw) -> DataFrame:
    return documentation.keys_name({"keys": t["name_keys"], "subtags": t["subtags"]})


QUERIES: dict[str, Callable[[Raw], DataFrame]] = {
    "a1_read_objects": _objects,
    "a2_read_history": _history,
    "a3_page_list": lambda t: t["page_list"],
    "a4_current_bodies": lambda t: t["current_bodies"],
    "a4_listed_bodies": lambda t: readers.listed_bodies(t["page_bodies"], t["page_list"]),
    "a5_load_projects": lambda t: readers.load_projects(t["fetch_log"]).select("id", "status", "fetch_status", F.col("data_updated").cast("timestamp").alias("data_updated")),
    "a6_prune_fetch_log": lambda t: readers.prune_fetch_log(t["fetch_log"], t["supplier"].where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("id")), _now()).select("id", "fetch_date", "fetch_status"),
    "a7_read_subtags": lambda t: t["subtags"],
    "a8_unicode_scripts": lambda t: t["unicode_scripts"],
    "a9_script_ranges": lambda t: t["unicode_codepoint_script_mapping"],
    "a10_unicode_data": lambda t: t["unicode_data"],
    "a11_wikipedia_sites": lambda t: t["wikipedia_sites"],
    "a13_editor_lists": lambda t: t["editor_lists"].select(F.explode("old_tags").alias("old_key", "old_value"), F.col("replace_tags")["new"].alias("new_value")),
    "a12_key_bindings": lambda t: t["key_bindings"],
    "a12_label_bindings": lambda t: t["label_bindings"],
    "a13_discarded_keys": lambda t: t["discarded_keys"],
    "a15_image_info": lambda t: wiki.image_info(t["image_cache"]),
    "a16_read_links": lambda t: t["page_links"],
    "a17_languages": _languages,
    "a18_catalog": _catalog,
    "z2_write_csv": _csv,
    "z3_result_envelope": _envelope,
    "z4_append_history": _appended,
    "z5_metrics": _metrics,
    "b20_key_characters": lambda t: t["key_characters"],
    "d1_parse_titles": lambda t: t["parsed_titles"].select("title", "lang", "tag", "key", "value", "ttype", "rtype"),
    "d2_good_titles": lambda t: wiki.check_titles(t["parsed_titles"])[0].select("title"),
    "d2_title_problems": lambda t: wiki.check_titles(t["parsed_titles"])[1],
    "d3_redirects": lambda t: t.documentation()["redirects"],
    "d4_templates": _templates,
    "d5_descriptions": lambda t: _pages(t, "description", "has_templ", "parsed", "status"),
    "d6_images": lambda t: _pages(t, "image", "rendering"),
    "d7_object_types": lambda t: _pages(t, "on_node", "on_way", "on_area", "on_relation"),
    "d8_tag_lists": lambda t: _pages(t, "tags_implies", "tags_combination", "tags_linked"),
    "d9_related_terms": lambda t: t.documentation()["related_terms"],
    "d10_wikipedia_links": lambda t: t.documentation()["wikipedia_links"],
    "d11_group_status": lambda t: _pages(t, "tgroup", "approval_status", "statuslink"),
    "d12_problems": lambda t: t.documentation()["problems"],
    "d20_image_info": lambda t: wiki.image_info(wiki.expire_cache(t["image_cache"], _now("2024-04-01"))),
    "d20_canonical_titles": lambda t: wiki.canonical_titles(t["image_cache"]).withColumnsRenamed({"from": "from_title", "to": "to_title"}),
    "d20_rewritten_images": lambda t: wiki.rewrite_images(t["pages_with_images"], wiki.canonical_titles(t["image_cache"])).join(wiki.image_info(t["image_cache"]), "image").select("title", "image", "image_url"),
    "d21_expire_cache": lambda t: wiki.expire_cache(t["image_cache"], _now("2024-04-01"), soft_limit=5).select("title", "timestamp"),
    "d23_classify_links": lambda t: wiki.classify_links(t["page_links"]),
    "e1_validate_projects": lambda t: t["checked_projects"].select("id", "status", "error_log", "data_updated", "name", "description", "project_url", "contact_name", "contact_email", "doc_url", "icon_url"),
    "e2_project_tags": lambda t: projects.project_tags(t["checked_projects"]),
    "f1_language_stats": lambda t: registries.language_stats(t["subtags"], t["wikipedia_sites"]),
    "g1_deprecated_tags": lambda t: registries.deprecated_tags(t["editor_lists"]),
    "h1_wikidata_keys": lambda t: t["wikidata_keys"],
    "h1_wikidata_tags": lambda t: t["wikidata_tags"],
    "h1_wikidata_labels": lambda t: t["wikidata_labels"],
    "h2_wikidata_stats": lambda t: registries.wikidata_stats(*t.wikidata().values()),
    "m1_sources": lambda t: t["sources"],
    "q40_languages": lambda t: documentation.languages(t, query="a"),
    "q41_characters": lambda t: documentation.characters(t, t["nation"].select("n_name"), "n_name"),
    "q48_wikidata_keys": lambda t: documentation.wikidata_keys(t),
    "q49_wikidata_tags": lambda t: documentation.wikidata_tags(t, query="val1"),
    "q50_wikidata_errors": lambda t: documentation.wikidata_errors(t),
    "q51_site_sources": lambda t: documentation.site_sources(t),
    "q52_keys_name": _names,
    "r12_image_comparison": lambda t: reports.image_comparison(t),
    "r19_tag_links": lambda t: joined(reports.tag_links(t["link_tags"], t["wikipedia_sites"]), "links"),
    "r21_freshness": lambda t: reports.freshness(t, _now("2024-06-01")),
    "r23_stats_dump": lambda t: reports.stats_dump(t),
    "r24_link_key_usage": lambda t: reports.link_key_usage({"keys": t["link_tags"].groupBy("key").agg(F.count("*").alias("count_all"), F.countDistinct("value").alias("values_all"))}),
}
