"""The daily batch: every table is written once, from the tables written before it, with its counters gathered on the way."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame

from .operators import counting, wiki
from .sources import catalog

Counters = Mapping[str, Mapping[str, Column]]
STATS = "key string, value long"
#: Tables in the order in which they are written: each after those it is made of.
ORDER = (
    "plain_tags", "plain_keys", "key_counts", "object_stats", "key_combinations", "key_pairs", "plain_relation_types", "relation_types", "relation_roles",
    "prevalent_values", "prevalent_roles", "similar_keys", "similar_keys_common_rare",
    "wikipages", "wikipages_keys", "wikipages_tags", "wiki_languages", "relation_pages", "wiki_images", "inconsistent_status_keys", "inconsistent_status_tags",
    "project_tags", "project_unique_tags", "keys", "tags", "tag_combinations", "tag_pairs", "top_tags", "words", "word_grams", "search_postings",
)
#: Tables that are read by one key, or joined by it.
BUCKETS = {
    "plain_tags": ("key",), "plain_keys": ("key",), "key_counts": ("key",), "key_pairs": ("key1",), "tag_pairs": ("key1",), "prevalent_values": ("key",), "wikipages": ("key",), "wikipages_keys": ("key",),
    "keys": ("key",), "tags": ("key",), "relation_roles": ("rtype",), "prevalent_roles": ("rtype",), "project_tags": ("key",),
    "words": ("key", "value"), "word_grams": ("gram",), "search_postings": ("token",),
}


def table_counters() -> dict[str, dict[str, Column]]:
    return {"object_stats": {}} | counting.table_counters() | wiki.table_counters()


def _written(tables, path: str, names: Iterable[str], counters: Counters, buckets: int | None) -> tuple[catalog.Catalog, list[tuple[str, int]]]:
    """(the tables that were written, their counters)."""
    spark, layout, values = tables.spark, {}, {}
    for name in names:
        made = type(tables)(spark, tables.dir, catalog.Catalog(spark, path, list(layout), layout))[name]
        by = BUCKETS.get(name, ()) if buckets else ()
        layout[name], found = catalog.write_table(made, path, name, bucket_by=by, buckets=buckets or 1, counters=counters.get(name))
        values |= found
    rows = [(k, v) for k, v in values.items() if v or not k.startswith(counting.CHARACTERS_IN_KEYS)]
    done = catalog.Catalog(spark, path, list(layout), layout)
    if "object_stats" in layout and "object_stats" in counters:  # has counters as rows, a dozen of them
        rows += [(r.key, r.value) for r in done["object_stats"].collect()]
    return done, rows


def run(tables, path: str, names: Iterable[str] = ORDER, buckets: int = 64) -> DataFrame:
    """Writes the tables (a ``Tables`` without prepared ones) below the path, to be read through a ``Catalog``, and gives
    their counters as (key, value), which are written as ``stats``. No table is made or read again for a counter."""
    done, rows = _written(tables, path, names, table_counters(), buckets)
    stats = tables.spark.createDataFrame(rows, STATS)
    catalog.write_layout(tables.spark, path, [*done.layout.values(), catalog.write_table(stats, path, "stats")[0]])
    return stats


def statistics(tables, counters: Counters | None = None) -> DataFrame:
    """Counters of the tables, which are written to a scratch folder for that and then deleted."""
    counters = table_counters() if counters is None else counters
    wanted = {*counters, *(("plain_tags", "plain_relation_types") if "relation_types" in counters else ())}
    path = catalog.scratch(tables.spark)
    try:
        return tables.spark.createDataFrame(_written(tables, path, [n for n in ORDER if n in wanted], counters, None)[1], STATS)
    finally:
        catalog.discard(tables.spark, path)
