"""Readers of the inputs. Every reader takes a path that Spark can open and gives a DataFrame with an explicit schema."""

from __future__ import annotations

import codecs
import itertools
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OBJECTS = (
    "otype string, oid long, version int, visible boolean, uid long, ts timestamp, lon double, lat double, "
    "tags map<string,string>, nds array<long>, members array<struct<mtype:string,ref:long,role:string>>"
)


def _tabular(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path)


def read_objects(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Tagged objects, one current version each."""
    return _tabular(spark, path, OBJECTS, kind)


def read_history(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """All versions of tagged objects."""
    return _tabular(spark, path, OBJECTS, kind)


def read_wiki_page_list(spark: SparkSession, path: str) -> DataFrame:
    """Pages about keys, tags and relation types from a tab-separated list (type, timestamp, namespace, title)."""
    pages = spark.read.schema("type string, timestamp string, namespace string, title string").csv(path, sep="\t", quote="")
    return pages.where(F.col("title").rlike(r"^([^:]+:)?(Key|Tag|Relation):(.+)$"))


def current_wiki_bodies(pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pages with their newest cached body that is as new as the list says; pages without one are left out."""
    cached = bodies.select("title", F.col("timestamp").alias("cached"), "body")
    fresh = pages.join(cached, "title").where(F.col("cached") >= F.col("timestamp"))
    newest = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("cached")))
    return fresh.withColumn("_n", newest).where("_n = 1").drop("_n", "cached")


def listed_bodies(bodies: DataFrame, pages: DataFrame) -> DataFrame:
    """Cached bodies of pages that are still listed. Titles are looked up, as sorting would move the bodies once more."""
    return bodies.join(pages.select("title").distinct().hint("shuffle_hash"), "title", "left_semi")


def load_projects(fetch_log: DataFrame) -> DataFrame:
    """Newest fetch of each project that succeeded; ``status`` tells fetches that failed."""
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("fetch_date")))
    rows = fetch_log.withColumn("_n", newest).where("_n = 1").drop("_n")
    ok = F.col("fetch_status") == "200"
    return rows.withColumns(
        {
            "status": F.when(ok, "OK").otherwise("FETCH ERROR"),
            "data_updated": F.when(F.col("last_modified") == "", F.col("fetch_date")).otherwise(F.coalesce("last_modified", "fetch_date")),
        }
    )


def prune_fetch_log(log: DataFrame, ids: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Fetches of listed projects: the newest success replaces what is older; failures stay for a week."""
    listed = log.join(ids.select("id").distinct(), "id", "left_semi")
    good = listed.where("fetch_status = '200'").groupBy("id").agg(F.max("fetch_date").alias("_last"))
    rows = listed.join(good, "id", "left").where(F.col("_last").isNull() | (F.col("fetch_date") >= F.col("_last")))
    return rows.where((F.col("fetch_status") == "200") | (F.date_add("fetch_date", days) >= F.to_date(now))).drop("_last")


def read_subtags(spark: SparkSession, path: str) -> DataFrame:
    """Language subtag registry: records between lines of %%, with continuation lines. Private use, special and
    collection languages, scripts in Z and regions that are not two letters are left out."""
    records = spark.read.text(path, lineSep="%%\n").where(F.col("value").contains("Type: "))
    text = F.regexp_replace("value", r"\n[ \t]+", " ")
    field = lambda name: F.regexp_extract_all(text, F.lit(rf"(?m)^{name}: (.*)$"), F.lit(1))
    first = lambda name: F.try_element_at(field(name), F.lit(1))
    joined = lambda name, sep: F.when(F.size(field(name)) > 0, F.array_join(field(name), sep))
    rows = records.select(
        first("Type").alias("stype"), first("Subtag").alias("subtag"), first("Added").alias("added"),
        first("Suppress-Script").alias("suppress_script"), first("Scope").alias("scope"),
        joined("Description", ". ").alias("description"), joined("Prefix", ",").alias("prefix"),
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.where(
        F.col("stype").isin("language", "script", "region", "variant")
        & ~no(F.col("description") == "Private use")
        & ~no((F.col("stype") == "language") & F.col("scope").isin("special", "collection"))
        & ~no((F.col("stype") == "script") & F.col("subtag").startswith("Z"))
        & ~no((F.col("stype") == "region") & ~F.col("subtag").rlike("^[A-Z]{2}$"))
    )


def read_unicode_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(script, name) from the aliases of property values."""
    parts = F.split("value", r"\s*;\s*")
    return spark.read.text(path).where(F.col("value").rlike("^sc ;")).select(parts[1].alias("script"), parts[2].alias("name"))


def read_script_ranges(spark: SparkSession, path: str, scripts: DataFrame) -> DataFrame:
    """(codepoint_from, codepoint_to, script, category) of ranges of characters."""
    line = r"^([0-9A-F]{4,5})(?:\.\.([0-9A-F]{4,5}))? +; +([^ ]+) # (..) "
    part = lambda n: F.regexp_extract("value", line, n)
    number = lambda c: F.conv(c, 16, 10).cast("long")
    rows = spark.read.text(path).where(F.col("value").rlike(line)).select(
        number(part(1)).alias("codepoint_from"), number(F.coalesce(F.nullif(part(2), F.lit("")), part(1))).alias("codepoint_to"), part(3).alias("name"), part(4).alias("category")
    )
    return rows.join(scripts, "name", "left").select("codepoint_from", "codepoint_to", "script", "category")


def in_ranges(points: DataFrame, ranges: DataFrame, point: str = "codepoint") -> DataFrame:
    """Adds script (and range_category) of the first range that covers a code point; null without one.

    Ranges are cut at multiples of 256, so that the join is on equal blocks and only its rest on bounds.
    """
    block = lambda c: F.shiftright(c, 8)
    cut = ranges.select(
        "codepoint_from",
        "codepoint_to",
        F.col("script").alias("range_script"),
        F.col("category").alias("range_category"),
        F.explode(F.sequence(block("codepoint_from"), block("codepoint_to"))).alias("_cut"),
    )
    keyed = points.withColumn("_block", block(F.col(point).cast("long")))
    covers = (F.col("_block") == F.col("_cut")) & F.col(point).between(F.col("codepoint_from"), F.col("codepoint_to"))
    return keyed.join(cut, covers, "left").drop("_block", "_cut")


def read_unicode_data(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """(codepoint, script, category, name) of characters; the script is Zzzz where no range has it."""
    parts = F.split("value", ";")
    rows = spark.read.text(path).where("value <> ''").select(F.conv(parts[0], 16, 10).cast("long").alias("codepoint"), parts[1].alias("name"), parts[2].alias("category"))
    found = in_ranges(rows, ranges).groupBy("codepoint", "name", "category").agg(F.min_by("range_script", "codepoint_from").alias("script"))
    return found.select("codepoint", F.coalesce("script", F.lit("Zzzz")).alias("script"), "category", "name")


def read_wikipedia_sites(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, language) of the encyclopedia sites in a list of all sites."""
    parts = F.split("value", ",")
    text = parts[3]
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return spark.read.text(path).where(parts[2] == "wikipedia").select(parts[1].alias("prefix"), text.alias("language"))


#: Bytes of a result file that a task holds at a time.
PIECE = 1 << 20
_BINDINGS = re.compile(r'(?<!\\)"bindings"\s*:\s*\[')
_BETWEEN = re.compile(r"[\s,]*")


def bindings_in(read: Callable[[], bytes]) -> Iterator[dict]:
    """The bindings of query results in JSON, one after the other, from pieces of their text (empty at its end); what is
    held is a piece and a binding."""
    decode, parse = codecs.getincrementaldecoder("utf-8")().decode, json.JSONDecoder().raw_decode
    held, at, inside, more = "", 0, False, True
    while True:
        if inside:
            at = _BETWEEN.match(held, at).end()
            if held[at : at + 1] == "]":
                inside = False
                continue
            try:
                found, at = parse(held, at)
                yield found
                continue
            except json.JSONDecodeError:
                if not more:
                    raise ValueError("a result ends within its bindings") from None
        elif m := _BINDINGS.search(held, at):
            at, inside = m.end(), True
            continue
        elif not more:
            return
        else:
            at = max(at, len(held) - 100)  # the name may be cut
        piece = read()
        more = bool(piece)
        held, at = held[at:] + decode(piece, not more), 0


def read_wikidata_bindings(spark: SparkSession, path: str) -> DataFrame:
    """(item, prop, description, label, lang) of query results in JSON; fields that a result lacks are null. Each file is read
    by one task in pieces, so that a result may have millions of bindings."""
    fields = {"item": "item", "prop": "prop", "description": "itemLabel", "label": "label", "lang": "label_lang"}
    schema = pa.schema([(n, pa.string()) for n in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
                with files.open_input_stream(inside) as f:
                    found = bindings_in(lambda f=f: f.read(PIECE))
                    while some := list(itertools.islice(found, 10_000)):
                        values = [[b.get(name, {}).get("value") for b in some] for name in fields.values()]
                        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in values], schema=schema)

    paths = spark.read.format("binaryFile").load(path).select("path").repartition("path")
    return paths.mapInArrow(run, ", ".join(f"{n} string" for n in fields))


def read_editor_lists(spark: SparkSession, deprecated: str, discarded: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(mapping of old_tags to replace_tags, discardable keys (source, key)) of an editor's lists."""
    mapping = spark.read.schema("old map<string,string>, replace map<string,string>").json(deprecated, multiLine=True)
    keys = spark.read.text(discarded, wholetext=True).select(F.lit(source).alias("source"), F.explode(F.json_object_keys("value")).alias("key"))
    return mapping.select(F.col("old").alias("old_tags"), F.col("replace").alias("replace_tags")), keys


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(from_title, to_title) of page links, tab-separated."""
    return spark.read.schema("from_title string, to_title string").csv(path, sep="\t", quote="")


def languages_dim(spark: SparkSession, path: str) -> DataFrame:
    """Languages (code, iso639_1, english_name, native_name) from a CSV file with a header; a fixed small table."""
    return spark.read.schema("code string, iso639_1 string, english_name string, native_name string").csv(path, header=True)
