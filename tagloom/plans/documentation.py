"""Queries about documentation pages, languages, characters, Wikidata and the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import contains, fraction, matching, sorted_page
from ..sources.readers import in_ranges
from .keys import Tables, direction, narrow


def wiki_languages(t: Tables, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Languages with their pages and which part of the documented keys and tags they describe (not rounded)."""
    total = narrow(t, "described_counts", "stats").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("wiki_keys_described", "wiki_tags_described")])
    rows = t["languages"].crossJoin(F.broadcast(total)).select(
        "code", "native_name", "english_name", direction(F.col("code")).alias("dir"), "wiki_key_pages", "wiki_tag_pages",
        fraction("wiki_key_pages", "wiki_keys_described", None).alias("wiki_key_pages_fraction"),
        fraction("wiki_tag_pages", "wiki_tags_described", None).alias("wiki_tag_pages_fraction"),
    )
    spec = {n: [] for n in ("code", "native_name", "english_name", "wiki_key_pages", "wiki_tag_pages")}
    return sorted_page(rows, spec, sort, order, page, rp)


def _with_status(t: Tables, status: str | None, by: list[str], of: str) -> DataFrame:
    rows = t["wikipages"].where(of)
    if status is not None:
        rows = rows.where(F.col("approval_status").isNull() if status == "none" else F.col("approval_status") == status)
    found = rows.groupBy("approval_status", *by).agg(F.array_sort(F.collect_list("lang")).alias("languages"))
    return found


def wiki_key_status(t: Tables, status: str | None = None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Keys with an approval status ('none': without any) and the languages of the pages that say so."""
    return sorted_page(_with_status(t, status, ["key"], "value is null"), {"key": []}, sort, order, page, rp)


def wiki_tag_status(t: Tables, status: str | None = None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    return sorted_page(_with_status(t, status, ["key", "value"], "value is not null"), {"key": [], "value": []}, sort, order, page, rp)


def _statuses(t: Tables, name: str, by: list[str], of: str) -> DataFrame:
    rows = t["wikipages"].where(of).join(t[name].select(*by), by, "left_semi").where("approval_status is not null")
    counted = rows.groupBy(*by, "approval_status").agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("approval_status", "n")))).alias("statuses"))


def inconsistent_key_status(t: Tables, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Keys whose pages disagree on the status: how many pages say what."""
    return sorted_page(_statuses(t, "inconsistent_status_keys", ["key"], "value is null"), {"key": []}, sort, order, page, rp)


def inconsistent_tag_status(t: Tables, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    return sorted_page(_statuses(t, "inconsistent_status_tags", ["key", "value"], "value is not null"), {"key": [], "value": []}, sort, order, page, rp)


def wiki_problems(t: Tables, query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Problems found while reading pages."""
    rows = t["problems"]
    if query:
        rows = rows.where(contains(F.concat("location", "reason", "title"), query))
    spec = {
        "location": ["location", "reason", "key", "value"],
        "reason": ["reason", "location", "key", "value"],
        "title": [],
        "tag": ["key", "value"],
        "lang": ["lang", "key", "value"],
    }
    return sorted_page(rows, spec, sort, order, page, rp)


def languages(t: Tables, query=None, type=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Language subtags with notes."""
    rows = t["subtags"] if type is None else t["subtags"].where(F.col("stype") == type)
    rows = matching(rows, query, "subtag", "description")
    note = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    found = rows.select(
        F.initcap("stype").alias("type"), "subtag", "description", "added",
        F.concat_ws(", ", note("Scope", "scope"), note("Default script", "suppress_script"), note("Prefixes", "prefix")).alias("notes"),
    )
    return sorted_page(found, {"subtag": [], "description": [], "added": []}, sort, order, page, rp)


def characters(t: Tables, texts: DataFrame, column: str = "text") -> DataFrame:
    """(column, num, char, codepoint, script, script_name, category, name) of each character of a string column.

    A character that is not listed by itself takes script and category from the range that covers it; one whose script has
    no name is left out.
    """
    chars = texts.select(column, F.posexplode(F.split(column, "")).alias("num", "char")).where("char <> ''")
    coded = chars.withColumn("codepoint", F.ascii("char").cast("long"))
    known = t["unicode_data"].select("codepoint", F.col("script").alias("own_script"), F.col("category").alias("own_category"), "name")
    rows = in_ranges(coded.join(known, "codepoint", "left"), t["unicode_codepoint_script_mapping"])
    rows = rows.withColumn("script", F.coalesce("own_script", "range_script")).withColumn("category", F.coalesce("own_category", "range_category"))
    named = rows.join(t["unicode_scripts"].withColumnRenamed("name", "script_name"), "script")
    return named.select(column, "num", "char", "codepoint", "script", "script_name", "category", "name")


def _wikidata(t: Tables, name: str, by: list[str], lang: str, query, sort, order, page, rp) -> DataFrame:
    labels = t["wikidata_labels"].where(F.col("lang") == lang).groupBy("code").agg(F.max("label").alias("label"))
    rows = t[name].join(labels, "code", "left").select(F.substring("code", 1, 1).alias("type"), "code", *by, "label")
    rows = matching(rows, query, "code", *by, "label")
    item = "lpad(substring(code, 2), 20, '0')"
    spec = {"type": ["type", item], "item": [item], **({"key": []} if by == ["key"] else {"tag": by})}
    return sorted_page(rows, spec, sort, order, page, rp)


def wikidata_keys(t: Tables, lang: str = "en", query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Wikidata items about keys, ordered by item number."""
    return _wikidata(t, "wikidata_keys", ["key"], lang, query, sort or "item", order, page, rp)


def wikidata_tags(t: Tables, lang: str = "en", query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    return _wikidata(t, "wikidata_tags", ["key", "value"], lang, query, sort or "item", order, page, rp)


def wikidata_errors(t: Tables) -> DataFrame:
    return t["wikidata_errors"]


def site_sources(t: Tables) -> DataFrame:
    """Visible sources in their order."""
    return t["sources"].where("visible").orderBy("no")


def keys_name(t: Tables, query=None, page=None, rp=None) -> DataFrame:
    """Keys that contain "name", taken apart as ``[prefix:][type_]name[:language tag]``, and how good each part of the tag is.

    States: good (well-formed and registered), okay (well-formed), bad. A region counts only as two capitals.
    """
    form = r"^(?:(.*):)?((?:[a-z]+_)?name)(?::([A-Za-z0-9-]+))?$"
    rows = matching(t["keys"].where(contains("key", "name")), query, "key").where(F.col("key").rlike(form))
    part = lambda n: F.nullif(F.regexp_extract("key", form, n), F.lit(""))
    rows = rows.select("key", "count_all", part(1).alias("prefix"), part(2).alias("type"), part(3).alias("langtag"))
    pieces = F.split("langtag", "-")
    second, third = F.try_element_at(pieces, F.lit(2)), F.try_element_at(pieces, F.lit(3))
    is_script = second.rlike("^[A-Za-z]{4}$")
    rest = F.when(is_script, third).otherwise(second)
    rows = rows.withColumns({"lang": F.element_at(pieces, 1), "script": F.when(is_script, second), "region": F.when(rest.rlike("^[A-Z]{2}$"), rest)})
    known = lambda s, c: t["subtags"].where(F.col("stype") == s).groupBy(F.col("subtag").alias(c)).agg(F.max("description").alias(f"{c}_note"))
    rows = rows.join(known("language", "lang"), "lang", "left").join(known("script", "script"), "script", "left")
    state = lambda c, good: F.when(F.col(c).isNull(), None).when(~F.col(c).rlike(good), "bad").when(F.col(f"{c}_note").isNotNull(), "good").otherwise("okay")
    found = rows.select(
        "key", "count_all", "prefix", "type", "langtag", "lang", state("lang", "^[a-z]{2,3}$").alias("lang_state"), "lang_note",
        "script", state("script", "^[A-Z][a-z]{3}$").alias("script_state"), "script_note", "region",
    )
    return sorted_page(found, {"key": []}, None, "asc", page, rp)
