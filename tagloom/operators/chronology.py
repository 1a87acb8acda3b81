"""Time series of key and tag use from the history of objects.

``history`` has otype, oid, version, visible, ts and tags; a version that is not visible has no tags.
"""

from __future__ import annotations

import functools
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import check_type, counters



def _steps(history: DataFrame, by_value: bool) -> DataFrame:
    """+1 or -1 for each key (or tag) that a version adds to or takes from its object. One shuffle by object."""
    items = F.map_entries("tags") if by_value else F.map_keys("tags")
    empty = F.array().cast("array<struct<key:string,value:string>>" if by_value else "array<string>")
    now = F.when(F.col("visible") & F.col("tags").isNotNull(), items).otherwise(empty)
    versions = history.select("otype", "oid", "version", F.to_date("ts").alias("date"), now.alias("now"))
    before = F.lag("now").over(Window.partitionBy("otype", "oid").orderBy("version"))
    changed = versions.withColumn("before", F.coalesce(before, empty))
    step = lambda a, b, n: F.transform(F.array_except(a, b), lambda x: F.struct(x.alias("item"), F.lit(n).alias("step")))
    rows = changed.select("otype", "date", F.inline(F.concat(step("now", "before", 1), step("before", "now", -1))))
    return rows.select("otype", "date", "step", *(["item.key", "item.value"] if by_value else [F.col("item").alias("key")]))


def _daily(steps: DataFrame, by: list[str]) -> DataFrame:
    sums = [
        F.sum(F.when(F.col("otype") == t, F.col("step")).otherwise(0)).cast("long").alias(name)
        for t, name in (("n", "nodes"), ("w", "ways"), ("r", "relations"))
    ]
    return steps.groupBy(*by, "date").agg(*sums).where("nodes <> 0 or ways <> 0 or relations <> 0")


def key_chronology(history: DataFrame) -> DataFrame:
    """(key, date, nodes, ways, relations): daily change in the number of objects with the key."""
    return _daily(_steps(history, False), ["key"])


def tag_chronology(history: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """The same for tags, of a selection of (key, value) if given."""
    steps = _steps(history, True)
    if selection is not None:
        steps = steps.join(selection.select("key", "value").distinct(), ["key", "value"], "left_semi")
    return _daily(steps, ["key", "value"])


def object_states(history: DataFrame) -> DataFrame:
    """(otype, oid, version, tags) of the last version of each object, to be stored in buckets by otype and oid; tags are
    null where that version is not visible."""
    last = history.groupBy("otype", "oid").agg(F.max_by(F.struct("version", F.when(F.col("visible"), F.col("tags")).alias("tags")), "version").alias("s"))
    return last.select("otype", "oid", "s.version", "s.tags")


def merge_day(states: DataFrame, history: DataFrame, by_value: bool = False) -> tuple[DataFrame, DataFrame]:
    """(daily changes, new states) from the last states and the versions of a day or more. Versions that a state knows, or
    that are older than it, change nothing.

    The versions of each object are one row, which meets the state of the object; stored states are not moved.
    """
    kept = F.array_sort(F.map_entries(F.when(F.col("visible"), F.col("tags"))))
    version = F.struct("version", F.to_date("ts").alias("date"), kept.alias("tags"))
    day = history.groupBy("otype", "oid").agg(F.array_sort(F.collect_set(version)).alias("new"))
    known = states.select("otype", "oid", F.col("version").alias("known"), F.map_entries("tags").alias("old"))
    met = known.join(day, ["otype", "oid"], "full")
    fresh = F.filter("new", lambda n: F.col("known").isNull() | (n["version"] > F.col("known")))
    met = met.withColumn("new", F.coalesce(fresh, F.array().cast(day.schema["new"].dataType)))

    empty = F.array().cast("array<struct<key:string,value:string>>")
    items = lambda tags: F.coalesce(tags, empty) if by_value else F.transform(F.coalesce(tags, empty), lambda e: e["key"])
    before = lambda i: F.when(i == 0, items(F.col("old"))).otherwise(items(F.try_element_at("new", F.greatest(i, F.lit(1)))["tags"]))
    step = lambda a, b, n, d: F.transform(F.array_except(a, b), lambda x: F.struct(x.alias("item"), F.lit(n).alias("step"), d.alias("date")))
    changes = F.flatten(F.transform("new", lambda n, i: F.concat(step(items(n["tags"]), before(i), 1, n["date"]), step(before(i), items(n["tags"]), -1, n["date"]))))
    rows = met.where(F.size("new") > 0).select("otype", F.inline(changes))
    steps = rows.select("otype", "date", "step", *(["item.key", "item.value"] if by_value else [F.col("item").alias("key")]))
    last = F.try_element_at("new", F.lit(-1))
    states = met.select("otype", "oid", F.coalesce(last["version"], "known").alias("version"), F.map_from_entries(F.when(F.size("new") > 0, last["tags"]).otherwise(F.col("old"))).alias("tags"))
    return _daily(steps, ["key", "value"] if by_value else ["key"]), states


def add_series(*parts: DataFrame) -> DataFrame:
    """Daily changes of several days or parts as one series."""
    by = [c for c in ("key", "value") if c in parts[0].columns]
    sums = [F.sum(n).cast("long").alias(n) for n in ("nodes", "ways", "relations")]
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.groupBy(*by, "date").agg(*sums).where("nodes <> 0 or ways <> 0 or relations <> 0")


def first_use(history: DataFrame, by_value: bool = False) -> DataFrame:
    """First time, in seconds, that a visible object had the key (or tag)."""
    rows = history.where("visible").select("ts", F.explode("tags").alias("key", "value"))
    return rows.groupBy("key", *(["value"] if by_value else [])).agg(F.min(F.unix_timestamp("ts")).alias("first_use"))


def smoothness(chronology: DataFrame) -> DataFrame:
    """Our own measure: 1 - largest daily increase / sum of all daily increases; null without any increase. Near 1 means
    steady growth, 0 a single import."""
    by = [c for c in ("key", "value") if c in chronology.columns]
    up = F.greatest(F.col("nodes") + F.col("ways") + F.col("relations"), F.lit(0))
    return chronology.groupBy(*by).agg((1 - F.try_divide(F.max(up).cast("double"), F.sum(up).cast("double"))).alias("smoothness"))


def cumulative(
    chronology: DataFrame, T: str = "all", start: date = date(2007, 10, 7), end: date | None = None
) -> DataFrame:
    """Running total of each series, with a zero row at ``start`` if the series starts later and its last total again at
    ``end`` (tomorrow by default), so that charts begin and end together."""
    check_type(T)
    by = [c for c in ("key", "value") if c in chronology.columns]
    change = F.col("nodes") + F.col("ways") + F.col("relations") if T == "all" else F.col(T)
    daily = chronology.select(*by, "date", change.alias("change"))
    running = daily.select(
        *by, "date", F.sum("change").over(Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("count")
    )
    span = daily.groupBy(*by).agg(F.min("date").alias("first"), F.sum("change").alias("count"))
    last = F.lit(end) if end else F.date_add(F.current_date(), 1)
    zero = span.where(F.col("first") > F.lit(start)).select(*by, F.lit(start).alias("date"), F.lit(0).cast("long").alias("count"))
    return running.unionByName(zero).unionByName(span.select(*by, last.alias("date"), "count"))


def chronology_stats(chronology: DataFrame, history: DataFrame) -> DataFrame:
    """(key, value): number of keys, and of visible versions by type."""
    of = lambda t: F.count_if((F.col("otype") == t) & F.col("visible"))
    keys = counters(chronology, {"chronology_num_keys": F.countDistinct("key")})
    return keys.unionByName(
        counters(history, {"chronology_nodes": of("n"), "chronology_ways": of("w"), "chronology_relations": of("r")})
    )
