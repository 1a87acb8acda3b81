"""Queries about external projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import fraction, matching, required, sorted_page
from .keys import Tables


def project_tags(t: Tables, project: str, query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Entries of a project with documentation and use of the key or tag."""
    required(project=project)
    rows = matching(t["project_tags"].where(F.col("project_id") == project), query, "key", "value")
    keys = t["project_unique_keys"].select("key", F.lit(None).cast("string").alias("value"), "in_wiki", "count_all")
    known = keys.unionByName(t["project_unique_tags"].select("key", "value", "in_wiki", "count_all"))
    known = known.withColumnsRenamed({"key": "k", "value": "v"})
    found = rows.join(known, (F.col("key") == F.col("k")) & F.col("value").eqNullSafe(F.col("v"))).drop("k", "v").distinct()
    spec = {"tag": ["key", "value"], "count_all": [], "in_wiki": ["in_wiki", "key", "value"]}
    return sorted_page(found, spec, sort, order, page, rp)


def projects_all(t: Tables, status: str = "OK", query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Projects with a status."""
    rows = matching(t["projects"].where(F.col("status") == status), query, "name", "description")
    spec = {"name": ["lower(name)"], "unique_keys": ["unique_keys", "unique_tags"], "unique_tags": ["unique_tags", "unique_keys"]}
    return sorted_page(rows, spec, sort, order, page, rp)


def _used(t: Tables, name: str) -> DataFrame:
    """Entries with the share of projects (of those that are OK) that have them."""
    n = t["projects"].where("status = 'OK'").agg(F.count("*").alias("n"))
    rows = t[name].crossJoin(F.broadcast(n))
    return rows.withColumn("projects_fraction", fraction("projects", "n")).drop("n")


def projects_keys(t: Tables, query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Keys that projects use."""
    spec = {"key": [], "projects": ["projects", "key"], "in_wiki": ["in_wiki", "key"], "count_all": ["count_all", "key"]}
    return sorted_page(matching(_used(t, "project_unique_keys"), query, "key"), spec, sort, order, page, rp)


def projects_tags(t: Tables, query=None, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Tags that projects use."""
    spec = {c: [c, "key", "value"] for c in ("projects", "in_wiki", "count_all")}
    rows = matching(_used(t, "project_unique_tags"), query, "key", "value")
    return sorted_page(rows, {"tag": ["key", "value"]} | spec, sort, order, page, rp)
