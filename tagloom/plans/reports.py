"""Reports: histograms, rankings, comparisons and page facts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from . import keys as K
from . import relations as Rel
from . import tags as Tg
from .keys import Tables


def key_lengths(t: Tables, longest: int = 60) -> DataFrame:
    """Number of keys of each length; longer ones are one class, missing lengths have 0."""
    counted = t["keys"].where("count_all > 0").groupBy(F.least(F.length("key"), F.lit(longest)).alias("length")).agg(F.count("*").alias("count"))
    every = t["keys"].sparkSession.range(1, longest + 1).select(F.col("id").cast("int").alias("length"))
    return every.join(counted, "length", "left").select("length", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def characters_in_keys(t: Tables) -> DataFrame:
    """Keys of each character class and their percentage."""
    counted = t["keys"].where("characters is not null").groupBy("characters").agg(F.count("*").alias("count"))
    total = counted.agg(F.sum("count").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("characters", "count", F.round(F.col("count") * 100.0 / F.col("total"), 2).alias("percent"))


def historic_development(t: Tables, names: tuple[str, ...] = ("num_keys", "num_tags", "relation_types")) -> DataFrame:
    """Statistics by day, one column each."""
    rows = t["history_stats"].where(F.col("key").isin(*names))
    return rows.groupBy("udate").pivot("key", list(names)).agg(F.max("value")).orderBy("udate")


def pages_about_missing_keys(t: Tables) -> DataFrame:
    """Documented keys that no object has."""
    return K.keys_all(t, filters=["in_wiki", "not_in_db"], include=["wikipages"])


def tag_cloud(t: Tables, k: int = 300) -> DataFrame:
    """The best keys by score with rank and a size that falls with the rank."""
    best = t["popular_keys"].orderBy(F.desc("scale1"), "key").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("scale1"), "key"))
    ranked = best.select("key", "count", "scale1", rank.alias("rank"))  # at most k rows
    size = F.round(F.col("scale1") / 22 * 25 + (1 - (F.col("rank") - 1) / F.lit(float(k))) * 10 + 8, 2)
    return ranked.withColumn("size", size)


def top_tags(t: Tables, k: int = 30, without: tuple[str, ...] = ("source", "source_ref", "attribution")) -> DataFrame:
    return t["tags"].where(~F.col("key").isin(*without)).orderBy(F.desc("count_all"), "key", "value").limit(k).select("key", "value", "count_all")


def top_relation_types(t: Tables, k: int = 30) -> DataFrame:
    return t["relation_types"].orderBy(F.desc("count"), "rtype").limit(k).select("rtype", "count")


def status_table(t: Tables) -> DataFrame:
    """Pages of each approval status: all, about keys, about tags, with whole percentages, and a total row ('total')."""
    pages = t["wikipages"].withColumn("status_name", F.coalesce("approval_status", F.lit("none")))
    rows = pages.rollup("status_name").agg(
        F.count("*").alias("all"), F.count_if(F.col("value").isNull()).alias("keys"), F.count_if(F.col("value").isNotNull()).alias("tags"), F.grouping("status_name").alias("g")
    )
    total = rows.where("g = 1").select(F.col("all").alias("t_all"), F.col("keys").alias("t_keys"), F.col("tags").alias("t_tags"))
    percent = lambda c: F.floor(F.try_divide(F.col(c) * 100, F.col(f"t_{c}"))).alias(f"{c}_percent")
    named = F.when(F.col("g") == 1, "total").otherwise(F.col("status_name")).alias("status")
    return rows.crossJoin(F.broadcast(total)).select(named, "all", percent("all"), "keys", percent("keys"), "tags", percent("tags"))


def status_choices(t: Tables) -> DataFrame:
    """Distinct keys and tags of each approval status."""
    return t["wikipages"].where("approval_status is not null").groupBy("approval_status").agg(
        F.countDistinct(F.when(F.col("value").isNull(), F.col("key"))).alias("keys"),
        F.countDistinct(F.when(F.col("value").isNotNull(), F.struct("key", "value"))).alias("tags"),
    )


def frequent_statuses(t: Tables, min_pages: int = 10) -> DataFrame:
    return t["wikipages"].where("approval_status is not null").groupBy("approval_status").agg(F.count("*").alias("pages")).where(F.col("pages") > min_pages)


SIZES = {
    "small": "width < 100 and height < 100",
    "tall": "height div width >= 2",
    "wide": "width div height >= 3",
    "large": "size > 20000000",
}


def image_sizes(t: Tables) -> DataFrame:
    """Images that are small, tall, wide or large: how many, and where they are used."""
    used = t["wikipages"].select("key", "value", "image").join(t["wiki_images"], "image")
    kinds = F.filter(F.array(*[F.when(F.expr(test), name) for name, test in SIZES.items()]), lambda x: x.isNotNull())
    return used.withColumn("kind", F.explode(kinds)).groupBy("kind", "image", "key", "value").agg(F.count("*").alias("pages"))


def image_size_counts(t: Tables) -> DataFrame:
    return image_sizes(t).groupBy("kind").agg(F.countDistinct("image").alias("images"))


def image_comparison(t: Tables) -> DataFrame:
    """Images of the pages about each key, by language."""
    rows = t["wikipages"].where("value is null and image is not null and image <> ''").join(t["wiki_images"], "image")
    return rows.select("key", "lang", "image", "image_url").orderBy("key", "lang")


def language_comparison(t: Tables, langs: list[str]) -> DataFrame:
    """Status of the page about each key in each of some languages."""
    return t["wikipages"].where("value is null").groupBy("key").pivot("lang", langs).agg(F.min("status"))


def problems_by(t: Tables, column: str = "reason") -> DataFrame:
    return t["problems"].groupBy(column).agg(F.count("*").alias("count"))


def object_ratios(t: Tables) -> DataFrame:
    """Percentage of tagged nodes and average tags of nodes, ways and relations, cut to two digits."""
    names = ("nodes", "ways", "relations", "node_tags", "way_tags", "relation_tags", "nodes_with_tags")
    one = K.narrow(t, "object_stats", "stats").agg(*[F.max(F.when(F.col("key") == n, F.col("value"))).cast("double").alias(n) for n in names])
    cut = lambda c: F.floor(c * 100) / 100
    return one.select(
        cut(F.try_divide(F.col("nodes_with_tags") * 100, F.col("nodes"))).alias("tagged_nodes_percent"),
        *[cut(F.try_divide(F.col(a), F.col(b))).alias(f"tags_per_{n}") for n, a, b in (("node", "node_tags", "nodes"), ("way", "way_tags", "ways"), ("relation", "relation_tags", "relations"))],
    )


def discardable_by_source(t: Tables, sources: tuple[str, ...] = ("id", "josm")) -> DataFrame:
    return t["discardable_tags"].groupBy("key").agg(*[F.max((F.col("source") == s).cast("int")).alias(s) for s in sources])


def compare(t: Tables, items: list[tuple[str, str | None]]) -> DataFrame:
    """Overviews of up to five keys or tags side by side."""
    if not 1 <= len(items) <= 5:
        raise ValueError("one to five keys or tags can be compared")
    def overview(key: str, value: str | None) -> DataFrame:
        rows = K.key_overview(t, key) if value is None else Tg.tag_overview(t, key, value)
        value_col = F.lit(value).cast("string").alias("value")
        counts = F.transform("counts", lambda c: F.struct(c["type"].alias("type"), c["count"].alias("count"), c["count_fraction"].alias("count_fraction")))
        return rows.select("key", value_col, counts.alias("counts"), "projects", "has_map", "wiki_pages", "description")
    return functools.reduce(DataFrame.unionByName, [overview(*i) for i in items])


def page_facts(t: Tables, key: str, value: str | None = None, locale: str = "en", max_width: int = 330) -> DataFrame:
    """Description in a language, else in English; preview image by the same order with a URL of bounded width; number of
    projects; who lists the key as discardable."""
    about = (F.col("key") == key) & F.col("value").eqNullSafe(F.lit(value))
    rank = F.when(F.col("lang") == locale, 0).when(F.col("lang") == "en", 1).otherwise(2)
    pages = t["wikipages"].where(about)
    text = pages.where((F.col("description") != "") & F.col("lang").isin(locale, "en")).agg(F.min_by("description", F.struct(rank, "title")).alias("description"))
    images = pages.where("image <> ''").join(t["wiki_images"], "image").withColumn("rank", rank).where("rank < 2")
    thumb = F.concat("thumb_url_prefix", F.lit(str(max_width)), "thumb_url_suffix")
    url = F.when((F.col("width") <= max_width) | F.col("thumb_url_prefix").isNull(), F.col("image_url")).otherwise(thumb)
    image = images.agg(F.min_by(F.struct("image", url.alias("url")), F.struct("rank", "title")).alias("image"))
    projects = t["project_tags"].where(F.col("key") == key).agg(F.countDistinct("project_id").alias("projects"))
    listed = t["discardable_tags"].where(F.col("key") == key).agg(F.array_sort(F.collect_set("source")).alias("discardable_by"))
    count = pages.agg(F.count("*").alias("wiki_pages"))
    one = functools.reduce(DataFrame.crossJoin, [text, image, projects, listed, count])
    return one.select(F.lit(key).alias("key"), F.lit(value).cast("string").alias("value"), *one.columns)


#: Keys whose values name something that can be linked to; fixed forms of those values.
LINK_KEYS = ("addr:country", "image", "phone", "ref:bag", "species", "url", "website", "wikidata", "wikipedia")


def _link(title: Column, url: Column) -> Column:
    return F.array(F.struct(title.alias("title"), url.alias("url")))


def tag_links(tags: DataFrame, wikipedia_sites: DataFrame) -> DataFrame:
    """Tags whose value can be linked to, with ``links`` (title, url)."""
    v = F.col("value")
    digits = F.regexp_extract("value", r"^([0-9]{1,16})$", 1)
    web = F.regexp_extract("value", r"^(https?://\S+)$", 1)
    phone = F.regexp_replace(F.regexp_extract("value", r"^(\+[0-9][0-9() /.-]*)$", 1), r"[() /.-]+", "-")
    title = F.regexp_extract("value", r"^([a-z-]+):(.+)$", 2)
    sites = wikipedia_sites.select(F.col("prefix").alias("site")).distinct()
    rows = tags.where(F.col("key").isin(*LINK_KEYS)).withColumn("_lang", F.regexp_extract("value", r"^([a-z-]+):", 1))
    rows = rows.join(sites, F.col("_lang") == F.col("site"), "left")
    key = F.col("key")
    lit = F.lit
    links = (
        F.when((key == "addr:country") & v.rlike("^[A-Z]{2}$"), F.concat(_link(F.concat(lit("Country "), v), F.concat(lit("https://en.wikipedia.org/wiki/"), v)), _link(lit("ISO 3166-2"), F.concat(lit("https://en.wikipedia.org/wiki/ISO_3166-2:"), v))))
        .when(key.isin("image", "url", "website") & (web != ""), _link(web, web))
        .when((key == "phone") & (phone != ""), _link(phone, F.concat(lit("tel:"), phone)))
        .when((key == "ref:bag") & (digits != ""), _link(F.lpad(digits, 16, "0"), F.concat(lit("https://bagviewer.kadaster.nl/lvbag/bag-viewer/?objectId="), F.lpad(digits, 16, "0"))))
        .when((key == "species") & v.rlike(r"^[A-Za-z -]+$"), _link(v, F.concat(lit("https://species.wikimedia.org/wiki/"), v)))
        .when((key == "wikidata") & v.rlike("^Q[0-9]{1,10}$"), _link(v, F.concat(lit("https://www.wikidata.org/wiki/"), v)))
        .when((key == "wikipedia") & F.col("site").isNotNull() & (title != ""), _link(title, F.concat(lit("https://"), F.col("site"), lit(".wikipedia.org/wiki/"), title)))
    )
    return rows.withColumn("links", links).where("links is not null").select(*tags.columns, "links")


def link_key_usage(t: Tables) -> DataFrame:
    """Use of the keys with linkable values."""
    return t["keys"].where(F.col("key").isin(*LINK_KEYS)).select("key", "count_all", "values_all")


def project_overview(t: Tables, now: Column, days: int = 7) -> DataFrame:
    """Projects with a flag for fetches that are too old, and their log."""
    rows = t["projects"]
    return rows.select("id", "name", "status", "fetch_date", (F.datediff(now, "fetch_date") > days).alias("outdated"), "error_log")


def freshness(t: Tables, now: Column, days: float = 1.5) -> DataFrame:
    """Whether the oldest visible source is too old."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.min("data_until"))) / 86400.0
    return t["sources"].where("visible").agg(F.min("data_until").alias("data_until"), (age > days).alias("outdated"))


def embed_counts(t: Tables, key: str, value: str | None = None) -> DataFrame:
    """Counts of a key or tag by type."""
    rows = t["keys"].where(F.col("key") == key) if value is None else t["tags"].where((F.col("key") == key) & (F.col("value") == value))
    return K.by_type(rows, {"count": "count"})


def embed_roles(t: Tables, rtype: str, k: int = 10) -> DataFrame:
    return t["relation_roles"].where(F.col("rtype") == rtype).orderBy(F.desc("count_all"), "role").limit(k).select("role", "count_all")


def stats_dump(t: Tables) -> DataFrame:
    return t["stats"].orderBy("key")


def role_treemap(t: Tables, rtype: str, min_fraction: float = 0.01) -> DataFrame:
    """(role, type, count) of a relation type, rarer roles as one without a name."""
    rows = Rel.relation_roles(t, rtype, min_fraction=min_fraction)
    names = {"nodes": "node", "ways": "way", "relations": "relation"}
    return rows.select("role", F.inline(F.array(*[F.struct(F.lit(x).alias("type"), F.col(f"count_{n}_members").alias("count")) for x, n in names.items()])))


def value_treemap(t: Tables, key: str, T: str = "all") -> DataFrame:
    return K.key_prevalent_values(t, key, 0.002, T)


