"""Queries about relation types and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import TYPES, fraction, matching, required, sorted_page, top_per_group
from .keys import Tables, narrow, pages_with_images

_MEMBERS = {"all": "members_all", "nodes": "members_nodes", "ways": "members_ways", "relations": "members_relations"}


def relation_roles(t: Tables, rtype: str, query=None, min_fraction: float | None = None, sort=None, order="desc", page=None, rp=None) -> DataFrame:
    """Roles of a relation type with their share of the members, by type. With ``min_fraction`` (and neither query nor
    paging) rarer roles are one row without a role."""
    required(rtype=rtype)
    own = t["relation_types"].where(F.col("rtype") == rtype).agg(*[F.max(c).alias(c) for c in _MEMBERS.values()])
    rows = matching(t["relation_roles"].where(F.col("rtype") == rtype), query, "role").crossJoin(F.broadcast(own))
    counts = [F.col(f"count_{x}") for x in TYPES]
    if min_fraction is not None and not query and page is None:
        kept = F.col("count_all") >= F.col("members_all") * min_fraction
        rare = rows.where(~kept).agg(F.lit(None).cast("string").alias("role"), *[F.sum(f"count_{x}").alias(f"count_{x}") for x in TYPES], *[F.max(c).alias(c) for c in _MEMBERS.values()])
        rows = rows.where(kept).select("role", *counts, *_MEMBERS.values()).unionByName(rare.where("count_all > 0"))
    names = {"all": "all_members", "nodes": "node_members", "ways": "way_members", "relations": "relation_members"}
    found = rows.select("role", *[c for x in TYPES for c in (F.col(f"count_{x}").alias(f"count_{names[x]}"), fraction(f"count_{x}", _MEMBERS[x]).alias(f"count_{names[x]}_fraction"))])
    spec = {"count_all_members": [], "role": [], "count_node_members": [], "count_way_members": [], "count_relation_members": []}
    return sorted_page(found, spec, sort, order, page, rp)


def relation_stats(t: Tables, rtype: str) -> DataFrame:
    """Members of a relation type by their type; zeros if unknown."""
    required(rtype=rtype)
    one = t["relation_types"].where(F.col("rtype") == rtype).agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in _MEMBERS.values()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("type"), F.col(c).alias("count")) for x, c in _MEMBERS.items()])))


def relation_wiki_pages(t: Tables, rtype: str) -> DataFrame:
    required(rtype=rtype)
    return pages_with_images(t["relation_pages"].where(F.col("rtype") == rtype), t)


def relation_projects(t: Tables, rtype: str, query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Entries of projects about the relation type."""
    required(rtype=rtype)
    rows = t["project_tags"].where((F.col("key") == "type") & (F.col("value") == rtype) & F.col("on_relation"))
    found = rows.drop("icon_url", "doc_url").join(t["projects"].where("status = 'OK'").select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "icon_url"), "project_id")
    return sorted_page(matching(found, query, "project_name"), {"project_name": ["lower(project_name)"]}, sort, order, page, rp)


def top_roles(t: Tables, k: int = 10) -> DataFrame:
    row = F.struct("role", "count", "fraction")
    return top_per_group(t["prevalent_roles"], ["rtype"], [F.desc("count"), F.asc("role")], k, row, "prevalent_roles")


def relations_all(t: Tables, query=None, sort=None, order="desc", page=None, rp=None) -> DataFrame:
    """Relation types with their share of all relations (not rounded) and most frequent roles; null roles where members
    were not counted."""
    total = narrow(t, "object_stats", "stats").where("key = 'relations'").agg(F.max("value").alias("total"))
    rows = matching(t["relation_types"], query, "rtype").crossJoin(F.broadcast(total)).join(top_roles(t), "rtype", "left")
    none = F.array().cast("array<struct<role:string,count:bigint,fraction:double>>")
    found = rows.select("rtype", "count", fraction("count", "total", None).alias("count_fraction"), F.when(F.col("members_all").isNotNull(), F.coalesce("prevalent_roles", none)).alias("prevalent_roles"))
    return sorted_page(found, {"count": [], "rtype": []}, sort, order, page, rp)


def relations_roles(t: Tables, query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """All roles of all types."""
    rows = matching(t["relation_roles"], query, "role")
    spec = {"role": ["role", "!count_all", "rtype"], "rtype": ["rtype", "!count_all", "role"], **{f"count_{x}": [f"!count_{x}", "role", "rtype"] for x in TYPES}}
    return sorted_page(rows, spec, sort, order, page, rp)
