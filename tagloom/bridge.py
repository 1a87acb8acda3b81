"""Logical inputs (objects, history, pages, projects) from the generated order and document tables.

The tables of a data set stand in for tagged objects: orders are nodes, parts are ways, customers are relations whose members
are their orders, documents are pages, suppliers are projects, and events are object history. ``Tables`` builds every
derived table on first use from these inputs only, each as a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batch
from .functions.semantics import counters
from .operators import chronology, counting, integration, wiki

#: Thresholds of the integration jobs, for data of this size.
LIMITS = {"combinations": 50, "tags": 200, "map": 300, "relations": 10, "popular": 100, "suggest": 500, "common": 100, "rare": 10_000}

PAGE_KEYS = ("status", "priority", "year", "brand", "type", "size", "nation:code", "undocumented:key")
PAGE_VALUES = ("O", "1-URGENT", "1995", "Brand#11", "BUILDING", "10", "3", "x")


RELATION_TYPES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


class Tables(Mapping):
    """Tables by name; see the methods. Tables that a batch has prepared (a ``Catalog``) are read and not made again."""

    def __init__(self, spark: SparkSession, sf_dir: str, prepared: Mapping[str, DataFrame] | None = None):
        self.spark, self.dir, self.prepared, self._made = spark, sf_dir, prepared or {}, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.prepared:
            return self.prepared[name]
        if name not in self._made:
            make = getattr(self, f"t_{name}", None)
            self._made[name] = make() if make else self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._made[name]

    def __iter__(self):
        return (n[2:] for n in dir(self) if n.startswith("t_"))

    def __len__(self):
        return sum(1 for _ in self)

    # ---- inputs
    def t_objects(self) -> DataFrame:
        return self._objects()

    def _objects(self, members: bool = True) -> DataFrame:
        """Tagged objects; what looks at tags alone does without the join that makes members."""
        text = lambda c: F.col(c).cast("string")
        o, p, c = self["orders"], self["part"], self["customer"]
        urgent = F.col("o_orderpriority") == "1-URGENT"
        tags = F.map_concat(
            F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority", F.lit("year"), F.year("o_orderdate").cast("string")),
            F.when(urgent, F.create_map(F.lit("urgent"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>")),
        )
        none = {"nds": F.lit(None).cast("array<bigint>"), "members": F.lit(None).cast("array<struct<mtype:string,ref:bigint,role:string>>"), "lon": F.lit(None).cast("double"), "lat": F.lit(None).cast("double"), "ts": F.lit(None).cast("timestamp")}
        columns = ["otype", "oid", "uid", "ts", "lon", "lat", "tags", "nds", "members"]

        def rows(df: DataFrame, **given) -> DataFrame:
            made = none | given
            return df.select(*[made[n].alias(n) for n in columns])

        nodes = rows(
            o, otype=F.lit("n"), oid=F.col("o_orderkey"), uid=F.col("o_custkey"), ts=F.col("o_orderdate").cast("timestamp"), tags=tags,
            lon=F.expr("pmod(o_custkey * 7919 + o_orderkey * 31, 36000) / 100.0D - 180.0D"), lat=F.expr("pmod(o_orderkey * 104729 + o_custkey, 18000) / 100.0D - 90.0D"),
        )
        part_tags = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), text("p_size"), F.col("p_name"), "p_brand")
        nds = F.expr("if(p_size % 2 = 0, array(p_partkey, p_partkey + 32, p_partkey), array(p_partkey, p_partkey + 32))")
        ways = rows(p, otype=F.lit("w"), oid=F.col("p_partkey"), uid=F.col("p_size").cast("long"), tags=part_tags, nds=nds)
        member = F.struct(F.translate("o_orderstatus", "OFP", "nwr").alias("mtype"), F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("role"))
        more = {}
        if members:
            listed = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(member).alias("m"))
            c, more = c.join(listed, "c_custkey", "left"), {"members": F.col("m")}
        relation_tags = F.create_map(F.lit("type"), "c_mktsegment", F.lit("nation:code"), text("c_nationkey"))
        relations = rows(c, otype=F.lit("r"), oid=F.col("c_custkey"), uid=F.col("c_nationkey").cast("long"), tags=relation_tags, **more)
        return nodes.unionByName(ways).unionByName(relations)

    def t_history(self) -> DataFrame:
        value = F.floor(F.col("value") / 50).cast("int").cast("string")
        tags = F.create_map(F.col("event_type"), F.coalesce(value, F.lit("none")))
        return self["events"].select(
            F.element_at(F.array(F.lit("n"), F.lit("w"), F.lit("r")), (F.col("user_id") % 3 + 1).cast("int")).alias("otype"),
            F.col("user_id").alias("oid"), F.col("event_id").alias("version"), (F.col("event_id") % 11 != 0).alias("visible"), F.col("ts").cast("timestamp").alias("ts"), tags.alias("tags"),
        )

    def _pages(self) -> DataFrame:
        d = self["documents"].join(self["labels"], "doc_id", "left")
        pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
        status = F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "proposed")
        redirect = F.col("doc_id") % 17 == 0
        value = F.when(F.floor(F.col("doc_id") / 8) % 2 == 1, pick(PAGE_VALUES))
        return d.select(
            "lang", pick(PAGE_KEYS).alias("key"), value.alias("value"),
            F.concat(F.lit("page "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"), F.substring_index("text", "\n", 1).alias("description"),
            F.when(redirect, "redirect").otherwise("page").alias("type"), (F.col("doc_id") % 3 != 0).alias("has_templ"), (F.col("doc_id") % 5 != 0).alias("parsed"),
            F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("File:i"), (F.col("doc_id") % 40).cast("string"))).alias("image"), F.when(F.col("doc_id") % 6 == 1, F.concat(F.lit("File:r"), (F.col("doc_id") % 9).cast("string"))).alias("rendering"),
            *[(F.col("doc_id") % n == 0).alias(f"on_{kind}") for kind, n in (("node", 2), ("way", 3), ("area", 5), ("relation", 7))],
            status.alias("approval_status"), "doc_id",
        )

    def t_wikipages(self) -> DataFrame:
        return wiki.page_status(self._pages())

    def t_relation_pages(self) -> DataFrame:
        return self["wikipages"].where("key = 'type'").withColumn("rtype", F.coalesce("value", F.lit("AUTOMOBILE")))

    def t_wiki_images(self) -> DataFrame:
        n = F.substring("image", 7, 9).cast("int")
        rows = self["wikipages"].where("image is not null").select("image").distinct()
        return rows.select("image", ((n + 1) * 25).alias("width"), ((n % 7 + 1) * 60).alias("height"), (n * 1_000_000).alias("size"), F.lit("image/png").alias("mime"), F.concat(F.lit("https://images.example/"), "image").alias("image_url"), F.concat(F.lit("https://images.example/t/"), "image", F.lit("/")).alias("thumb_url_prefix"), F.lit("px.png").alias("thumb_url_suffix"))

    def t_projects(self) -> DataFrame:
        s = self["supplier"]
        return s.select(
            F.col("s_name").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("description"),
            F.when(F.col("s_suppkey") % 10 == 0, "FETCH ERROR").when(F.col("s_suppkey") % 10 == 1, "PARSE_ERROR").otherwise("OK").alias("status"),
            F.when(F.col("s_suppkey") % 3 == 0, F.lit("https://icons.example/i.png")).alias("icon_url"), F.when(F.col("s_suppkey") % 10 == 1, F.concat(F.lit("FATAL: no document at "), "s_name")).alias("error_log"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 9).cast("int")).cast("timestamp").alias("fetch_date"),
        )

    def t_project_tags(self) -> DataFrame:
        l = self["lineitem"].select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")  # noqa: E741
        rows = l.join(self["part"].select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        rows = rows.join(self["supplier"].select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        brand, rtype = F.col("l_returnflag") == "R", F.element_at(F.array(*map(F.lit, RELATION_TYPES)), (F.col("l_suppkey") % len(RELATION_TYPES) + 1).cast("int"))
        value = F.when(brand, F.col("p_brand")).when(F.col("l_returnflag") == "N", rtype)
        flat = rows.select(F.col("s_name").alias("project_id"), F.when(brand, "brand").otherwise("type").alias("key"), value.alias("value"), (F.col("l_linestatus") == "O").alias("o"), (F.col("l_linestatus") == "F").alias("f"), (F.col("l_returnflag") == "N").alias("r"))
        found = flat.groupBy("project_id", "key", "value").agg(F.bool_or("o").alias("on_node"), F.bool_or("f").alias("on_way"), F.bool_or(F.col("f") | F.col("r")).alias("on_relation"), F.bool_and("o").alias("on_area"))
        of_brand = F.col("key") == "brand"
        about = F.concat(F.lit("uses "), "value")  # null for an entry about the key alone
        return found.select("*", about.alias("description"), F.when(of_brand, F.concat(F.lit("https://doc.example/"), "project_id")).alias("doc_url"), F.when(~of_brand, F.concat(F.lit("https://icons.example/"), "project_id")).alias("icon_url"))

    def t_discardable_tags(self) -> DataFrame:
        rows = self["nation"].select(F.element_at(F.array(*map(F.lit, PAGE_KEYS)), (F.col("n_nationkey") % 8 + 1).cast("int")).alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "id").otherwise("josm").alias("source"), "n_regionkey")
        return rows.where("n_regionkey < 2").select("source", "key").distinct()

    def t_languages(self) -> DataFrame:
        base = self["documents"].select(F.col("lang").alias("code")).where("code in ('en', 'de', 'fr')").distinct()
        named = base.select("code", F.concat(F.lit("language "), "code").alias("english_name"), F.upper("code").alias("native_name"))
        return integration.language_pages(named, self["wikipages"])

    def t_history_stats(self) -> DataFrame:
        return self["events"].groupBy(F.to_date("ts").alias("udate"), F.col("event_type").alias("key")).agg(F.count("*").alias("value"))

    # ---- counts
    def t_object_tags(self) -> DataFrame:
        return counting.explode_tags(self._objects(members=False))

    def t_object_stats(self) -> DataFrame:
        return counting.object_stats(self._objects(members=False))

    def t_key_counts(self) -> DataFrame:
        return counting.key_stats(self["plain_tags"])

    def t_key_pairs(self) -> DataFrame:
        return counting.both_ways(self["key_combinations"])

    def pairs_of(self, key: str) -> DataFrame:
        """Combinations with one key as ``key1``, prepared or from the objects that have it."""
        if "key_pairs" in self.prepared:
            return self["key_pairs"].where(F.col("key1") == key)
        if "key_combinations" in self.prepared:
            return counting.both_ways(self["key_combinations"], key)
        return counting.both_ways(counting.key_combinations(self._objects(members=False).where(F.map_contains_key("tags", key))), key)

    def t_plain_tags(self) -> DataFrame:
        return counting.tag_stats(self["object_tags"])

    def t_plain_keys(self) -> DataFrame:
        keys = counting.key_stats(self["plain_tags"]).join(counting.key_users(self["object_tags"]), "key", "left")
        return counting.key_grade(counting.character_class(keys))

    def t_keys(self) -> DataFrame:
        users = self["project_tags"].groupBy("key").agg(F.countDistinct("project_id").alias("projects"))
        return integration.enrich_keys(self["plain_keys"], self["wikipages"], users)

    def t_tags(self) -> DataFrame:
        return integration.enrich_tags(self["plain_tags"], self["wikipages"])

    def t_key_combinations(self) -> DataFrame:
        return counting.key_combinations(self._objects(members=False))

    def selection(self) -> dict[str, DataFrame]:
        keys = self["plain_keys" if "plain_keys" in self.prepared else "key_counts"]  # users and grades select nothing
        return counting.selection(keys, self["plain_tags"], self["plain_relation_types"], LIMITS["tags"], LIMITS["map"], LIMITS["relations"])

    def t_tag_combinations(self) -> DataFrame:
        return counting.tag_combinations(self._objects(members=False), self.selection()["interesting_tags"], LIMITS["combinations"])

    def t_tag_pairs(self) -> DataFrame:
        return counting.both_ways(self["tag_combinations"])

    def tag_pairs_of(self, key: str, value: str) -> DataFrame:
        """Combinations with one tag as the first, prepared or from the objects that have it."""
        if "tag_pairs" in self.prepared:
            found = self["tag_pairs"]
        elif "tag_combinations" in self.prepared:
            found = counting.both_ways(self["tag_combinations"], key)
        else:
            having = self._objects(members=False).where(F.try_element_at("tags", F.lit(key)) == value)
            found = counting.both_ways(counting.tag_combinations(having, self.selection()["interesting_tags"], LIMITS["combinations"]), key)
        return found.where((F.col("key1") == key) & (F.col("value1") == value))

    def t_plain_relation_types(self) -> DataFrame:
        return counting.relation_types(self["objects"])

    def t_relation_types(self) -> DataFrame:
        return counting.topup_relation_types(self["plain_relation_types"], self["plain_tags"])

    def t_relation_roles(self) -> DataFrame:
        return counting.relation_roles(self["objects"])

    def t_prevalent_values(self) -> DataFrame:
        return counting.prevalent_values(self["plain_tags"], self["plain_keys"])

    def t_prevalent_roles(self) -> DataFrame:
        return counting.prevalent_roles(self["relation_types"], self["relation_roles"])

    def t_key_grid(self) -> DataFrame:
        return counting.geo_grid(self._objects(members=False))

    def t_tag_grid(self) -> DataFrame:
        return counting.geo_grid(self._objects(members=False), ("key", "value"), only=self.selection()["frequent_tags"])

    def tag_grid_of(self, key: str, value: str) -> DataFrame:
        """Cells of one tag, prepared or from the objects that have it, if it is a frequent one."""
        if "tag_grid" in self.prepared:
            return self["tag_grid"].where((F.col("key") == key) & (F.col("value") == value))
        tags = self.selection()["frequent_tags"].where((F.col("key") == key) & (F.col("value") == value))
        objects = self._objects(members=False)
        having = objects.where(F.try_element_at("tags", F.lit(key)) == value)
        return counting.geo_grid(having, ("key", "value"), only=tags, cells=counting.node_cells(objects))  # a way is in the cells of any nodes

    def t_similar_keys(self) -> DataFrame:
        return counting.with_counts(counting.similar_keys(self["plain_keys"]), self["plain_keys"])

    def t_similar_keys_common_rare(self) -> DataFrame:
        return counting.common_rare(self["similar_keys"], LIMITS["common"] // 10, LIMITS["rare"])

    def t_stats(self) -> DataFrame:
        return integration.master_stats(batch.statistics(self))

    def t_described_counts(self) -> DataFrame:
        """The counters of documented keys and tags alone."""
        named = wiki.table_counters()
        return counters(self["wikipages_keys"], named["wikipages_keys"]).unionByName(counters(self["wikipages_tags"], named["wikipages_tags"]))

    def t_wiki_languages(self) -> DataFrame:
        return wiki.wiki_languages(self["wikipages"])

    # ---- history
    def t_key_chronology(self) -> DataFrame:
        return chronology.key_chronology(self["history"])

    def t_tag_chronology(self) -> DataFrame:
        return chronology.tag_chronology(self["history"])

    # ---- documentation and integration
    def t_wikipages_keys(self) -> DataFrame:
        return wiki.wikipages_keys(self["wikipages"])

    def t_wikipages_tags(self) -> DataFrame:
        return wiki.wikipages_tags(self["wikipages"])

    def t_inconsistent_status_keys(self) -> DataFrame:
        return wiki.inconsistent_status(self["wikipages"], "key")

    def t_inconsistent_status_tags(self) -> DataFrame:
        return wiki.inconsistent_status(self["wikipages"], "tag")

    def t_words(self) -> DataFrame:
        return wiki.wiki_words(self["wikipages"])

    def t_problems(self) -> DataFrame:
        bad = wiki.page_status(self._pages()).where("status = 'e'")
        return bad.select(F.lit("page content").alias("location"), F.lit("parsing failed").alias("reason"), "title", "lang", "key", "value", F.lit(None).cast("string").alias("info"))

    def t_project_unique_keys(self) -> DataFrame:
        return integration.project_unique_keys(self["project_tags"], self["wikipages_keys"], self["plain_keys"])

    def t_project_unique_tags(self) -> DataFrame:
        return integration.project_unique_tags(self["project_tags"], self["wikipages_tags"], self["plain_tags"])

    def t_top_tags(self) -> DataFrame:
        return integration.top_tags(self["tag_combinations"], self["plain_tags"], self["wikipages"], self["project_unique_tags"])

    def t_popular_keys(self) -> DataFrame:
        popular = integration.popular_keys(self["plain_keys"], self["wikipages"], LIMITS["popular"])
        return integration.popular_scores(popular, integration.popular_metadata(popular))

    def t_suggestions(self) -> DataFrame:
        return integration.suggestions(self["keys"], self["prevalent_values"], self["wikipages"], LIMITS["suggest"])

    def t_search_index(self) -> DataFrame:
        return integration.search_index(self["plain_tags"])

    def t_search_postings(self) -> DataFrame:
        return integration.search_postings(self["search_index"])

    def t_word_grams(self) -> DataFrame:
        return wiki.word_grams(self["words"])
