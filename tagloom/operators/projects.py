"""External projects: checks of their JSON documents, their tags, and counts.

``projects`` has id, fetch_status and fetch_json, as the fetch log leaves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import counters

TAG_TYPES = ("node", "way", "relation", "area")
#: The properties that the format of project files fixes.
TOP_LEVEL = r"^([$]schema|data_format|data_updated|data_url|project|tags)$"
PROJECT = ("name", "description", "project_url", "doc_url", "icon_url", "contact_name", "contact_email", "keywords", "data_url")


def _at(path: str) -> Column:
    return F.expr(f"try_variant_get(v, '{path}', 'variant')")


def _kind(path: str) -> Column:
    """Type of a JSON value, null if there is none or it is null."""
    return F.nullif(F.schema_of_variant(_at(path)), F.lit("VOID"))


def _text(path: str) -> Column:
    return F.when(_kind(path) == "STRING", F.expr(f"try_variant_get(v, '{path}', 'string')"))


def _entry_findings(entry: Column, n: Column) -> Column:
    """Findings on one entry of the tags; all but the warning leave the entry out."""
    value = lambda name, kind="variant": F.try_variant_get(entry, f"$.{name}", kind)
    kind = lambda name: F.nullif(F.schema_of_variant(value(name)), F.lit("VOID"))
    place = F.concat(F.lit("tags."), n.cast("string"))
    say = lambda test, level, message: F.when(test, F.concat(F.lit(f"{level}: "), place, F.lit(message)))
    named = F.coalesce(kind("key") == "STRING", F.lit(False))
    types = F.when(kind("object_types").startswith("ARRAY"), value("object_types", "array<string>"))
    messages = [
        say(kind("key").isNull(), "ERROR", ".key is missing"),
        say(kind("key").isNotNull() & ~named, "ERROR", ".key is not a string"),
        say(named & kind("object_types").isNotNull() & types.isNull(), "ERROR", ".object_types is not an array"),
        say(named & (F.size(types) == 0), "WARNING", ".object_types is empty and means all types"),
        *[say(named & kind(c).isNotNull() & (kind(c) != "STRING"), "ERROR", f".{c} is not a string") for c in ("value", "description", "doc_url", "icon_url")],
    ]
    unknown = F.filter(types, lambda t: ~F.coalesce(t.isin(*TAG_TYPES), F.lit(False)))
    unknown = F.transform(unknown, lambda t: F.concat(F.lit("ERROR: "), place, F.lit(".object_types has an unknown type: "), F.coalesce(t, F.lit("null"))))
    none = F.array().cast("array<string>")
    return F.concat(F.filter(F.array(*messages), lambda m: m.isNotNull()), F.when(named, F.coalesce(unknown, none)).otherwise(none))


def validate_projects(projects: DataFrame) -> DataFrame:
    """Adds the fields of the document, ``status`` (OK, PARSE_ERROR, JSON_ERROR) and ``error_log`` (one line for each
    finding with its level). A fatal finding makes PARSE_ERROR; some of them end the checks."""
    rows = projects.withColumn("v", F.try_parse_json("fetch_json"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    has = lambda p: _kind(p).isNotNull()
    text = lambda p: F.coalesce(_kind(p) == "STRING", F.lit(False))
    say = lambda test, level, message: F.when(test, F.concat(F.lit(level + ": "), message if isinstance(message, Column) else F.lit(message)))
    format_ok = F.coalesce((_kind("$.data_format") == "BIGINT") & (F.expr("try_variant_get(v, '$.data_format', 'bigint')") == 1), F.lit(False))
    project_ok = F.coalesce(_kind("$.project").startswith("OBJECT"), F.lit(False))
    tags_ok = F.coalesce(_kind("$.tags").startswith("ARRAY"), F.lit(False))
    stop1, stop2 = F.coalesce(~is_object, F.lit(True)), ~format_ok
    go = ~stop1 & ~stop2
    on = go & project_ok
    updated = _text("$.data_updated").rlike(r"^[0-9]{8}T[0-9]{6}Z$")
    messages = [
        say(stop1, "FATAL", "top level is not an object"),
        say(~stop1 & stop2, "FATAL", "data_format is missing or unknown (known: 1)"),
        say(go & has("$.data_updated") & ~F.coalesce(updated, F.lit(False)), "ERROR", "data_updated is not yyyymmddThhmmssZ and is ignored"),
        say(go & ~has("$.project"), "FATAL", "project is missing"),
        say(go & has("$.project") & ~project_ok, "FATAL", "project is not an object"),
        *[say(on & ~text(f"$.project.{n}"), "FATAL", f"project.{n} is missing or not a string") for n in ("name", "description", "project_url")],
        *[say(on & ~text(f"$.project.{n}"), "ERROR", f"project.{n} is missing or not a string") for n in ("contact_name", "contact_email")],
        *[say(on & has(f"$.project.{n}") & ~text(f"$.project.{n}"), "ERROR", f"project.{n} is not a string") for n in ("doc_url", "icon_url")],
        *[
            say(on & text(f"$.project.{n}") & ~_text(f"$.project.{n}").startswith("https:"), "WARNING", F.concat(F.lit(f"{n} is not an https URL: "), _text(f"$.project.{n}")))
            for n in ("data_url", "project_url", "doc_url", "icon_url")
        ],
        say(on & ~has("$.tags"), "FATAL", "tags are missing"),
        say(on & has("$.tags") & ~tags_ok, "FATAL", "tags are not an array"),
    ]
    names = lambda path: F.coalesce(F.json_object_keys(F.expr(f"to_json(try_variant_get(v, '{path}', 'variant'))")), F.array().cast("array<string>"))
    top = F.filter(F.coalesce(F.json_object_keys("fetch_json"), F.array().cast("array<string>")), lambda k: ~k.rlike(TOP_LEVEL))
    more = F.filter(names("$.project"), lambda k: ~k.isin(*PROJECT))
    found = F.filter(F.array(*messages), lambda m: m.isNotNull())
    unknown = F.concat(
        F.when(go, F.transform(top, lambda k: F.concat(F.lit("WARNING: unknown property: "), k))).otherwise(F.array().cast("array<string>")),
        F.when(on, F.transform(more, lambda k: F.concat(F.lit("WARNING: project has unknown property: "), k))).otherwise(F.array().cast("array<string>")),
    )
    log = F.when(F.col("v").isNotNull(), F.concat(found, unknown)).otherwise(F.array(F.lit("FATAL: not JSON")))
    entries = F.expr("try_variant_get(v, '$.tags', 'array<variant>')")
    about_tags = F.flatten(F.transform(entries, _entry_findings))
    log = F.concat(log, F.when(on & tags_ok, about_tags).otherwise(F.array().cast("array<string>")))
    fatal = F.exists("log", lambda m: m.startswith("FATAL"))
    # exploded, as conditions on the result would move below a plain column, and make the log and what it reads again
    checked = rows.select("*", F.explode_outer(F.array(log)).alias("log"))
    fields = [_text(f"$.project.{n}").alias(n) for n in PROJECT if n not in ("keywords", "data_url")]
    return checked.select(
        *projects.columns,
        F.when(updated, _text("$.data_updated")).alias("data_updated"),
        *fields,
        F.when(F.col("v").isNull(), "JSON_ERROR").when(fatal, "PARSE_ERROR").otherwise("OK").alias("status"),
        F.array_join("log", "\n").alias("error_log"),
        F.when(F.col("v").isNotNull() & ~fatal, F.to_json("v")).alias("document"),
    )


def project_tags(projects: DataFrame) -> DataFrame:
    """(project_id, key, value, on_node, on_way, on_relation, on_area, description, doc_url, icon_url) of valid entries.
    No or empty object types mean all; an entry with an unknown type or a value that is no string is dropped."""
    rows = projects.where("document is not null").select(F.col("id").alias("project_id"), F.expr("try_variant_get(try_parse_json(document), '$.tags', 'array<variant>')").alias("tags"))
    entry = rows.select("project_id", F.explode_outer("tags").alias("v"))  # no entry is no valid one; the outer form reads the tags once
    types = F.expr("try_variant_get(v, '$.object_types', 'array<string>')")
    parsed = entry.withColumn("types", types).withColumn("types_kind", _kind("$.object_types"))
    optional = lambda n: F.coalesce(_kind(f"$.{n}") == "STRING", F.lit(True))
    fine = (
        F.coalesce(_kind("$.key") == "STRING", F.lit(False))
        & F.coalesce(F.col("types_kind").startswith("ARRAY"), F.lit(True))
        & F.coalesce(F.forall("types", lambda t: t.isin(*TAG_TYPES)), F.lit(True))
        & optional("value") & optional("description") & optional("doc_url") & optional("icon_url")
    )
    every = F.col("types").isNull() | (F.size("types") == 0)
    flags = [(every | F.array_contains("types", t)).alias(f"on_{t}") for t in TAG_TYPES]
    return parsed.where(fine).select("project_id", *[_text(f"$.{n}").alias(n) for n in ("key", "value")], *flags, *[_text(f"$.{n}").alias(n) for n in ("description", "doc_url", "icon_url")])


def project_counters(projects: DataFrame, project_tags: DataFrame) -> DataFrame:
    """Adds key_entries, tag_entries, unique_keys and unique_tags (0 without entries)."""
    names = ["key_entries", "tag_entries", "unique_keys", "unique_tags"]
    found = project_tags.groupBy(F.col("project_id").alias("id")).agg(
        F.count_if(F.col("value").isNull()).alias("key_entries"),
        F.count("value").alias("tag_entries"),
        F.countDistinct("key").alias("unique_keys"),
        F.countDistinct(F.when(F.col("value").isNotNull(), F.struct("key", "value"))).alias("unique_tags"),
    )
    base = projects.drop(*names)
    return base.join(found, "id", "left").select(*base.columns, *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])


def project_stats(projects: DataFrame, project_tags: DataFrame) -> DataFrame:
    """(key, value): projects by status and with an icon, and entries for keys and tags."""
    status = lambda s: F.count_if(F.col("status") == s)
    of_projects = {
        "projects": F.count("*"),
        "projects_ok": status("OK"),
        "projects_fetch_error": status("FETCH ERROR"),
        "projects_parse_error": status("PARSE_ERROR"),
        "projects_with_icon": F.count("icon_url"),
    }
    of_tags = {"project_keys": F.count_if(F.col("value").isNull()), "project_tags": F.count("value")}
    return counters(projects, of_projects).unionByName(counters(project_tags, of_tags))
