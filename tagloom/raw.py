"""Raw inputs (page lists and bodies, project files, registries) from the generated tables.

``Raw`` makes them as the readers find them: text in files where a reader reads files, else the rows that a reader gives.
Files go to a new shared folder for each use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bridge import Tables
from .operators import counting, projects, registries, wiki
from .sources import catalog, readers


def _pick(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


class Raw(Tables):
    """The tables of the bridge and those made from raw inputs."""

    def _text_file(self, lines: DataFrame, **options) -> str:
        path = catalog.scratch(self.spark)
        lines.write.options(**options).text(path)
        return path

    # ---- pages
    def t_raw_pages(self) -> DataFrame:
        """(title, type, body) of a page for each document: of keys, tags and relation types, with mistakes of every kind."""
        i, kind = F.col("doc_id"), F.col("doc_id") % 4
        lang = F.coalesce("lang", F.lit("en"))
        prefix = F.when(lang == "en", "").otherwise(F.concat(F.upper(lang), F.lit(":")))
        odd = F.floor(i / 4) % 6
        title = (
            F.when(kind == 0, _say(prefix, "Key:key", i))
            .when(kind == 1, _say(prefix, "Tag:key", i % 50, "=val", i))
            .when(kind == 2, _say(prefix, "Relation:rel", i))
            .when(odd == 0, _say(prefix, "Key:a/b", i))
            .when(odd == 1, _say("DE:Key:k", i, "=v"))
            .when(odd == 2, _say("DE:Tag:k", i))
            .when(odd == 3, _say("en:Key:k", i))
            .when(odd == 4, _say("Tag:k", i, "=v/w"))
            .otherwise(_say("Bad code:Key:k", i))
        )
        cleaned = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]+", ""))
        words = F.col("words")  # of a step of its own, as a body has them in several places
        if_ = lambda hit, *parts: F.when(hit, _say(*parts)).otherwise("")
        image = F.when(i % 3 == 0, _say("|image=File:i", i % 40, ".png")).when(i % 3 == 1, F.lit("|image=no image")).otherwise(F.lit(""))
        rendering = F.when(i % 7 == 2, _say("|osmcarto-rendering=Image:r", i % 5, ".svg")).when(i % 7 == 3, F.lit("|osmcarto-rendering=none")).otherwise(F.lit(""))
        page = _say(
            "<!-- {{Key|no}} -->{{", _pick(("KeyDescription", "ValueDescription", "RelationDescription", "KeyDescription"), kind), if_(i % 10 == 2, "|stray"),
            "|description=", words, if_(i % 12 == 5, " <b>"), " {{Tag|key", i % 50, "|val", i % 7, "}}", image, rendering, "|onNode=", _pick(("yes", "no"), i), if_(i % 15 == 4, "|onNode=no"),
            "|onWay=", F.when(i % 5 == 0, "maybe").otherwise("yes"), F.when(odd < 2, "|onArea=yes").when(odd < 4, "|onArea=no").otherwise(""), "|onRelation=", F.when(odd == 5, "Yes").when(odd == 1, "yes").otherwise("no"),
            if_(i % 9 != 8, "|status=", _pick(("approved", "de facto", "proposed"), i)), if_(i % 5 == 1, "|statuslink=Proposal ", i % 3),
            "|group=g", i % 9, if_(i % 6 < 2, "|implies={{Tag|i", i % 3, "|v}} {{Key|j}}"), "|combination={{Tag|c", i % 4, "}} {{Tag|d|e", i % 4, "}}}} ", words, " {{Tag|link", i % 6, "|x}} [[other]]",
            if_(i % 11 != 10, "{{RelatedTerm|", F.when(i % 3 == 0, "").when(i % 3 == 1, "de|").when(i % 21 == 2, "b@d|").otherwise("fr|"), "term", i % 11, "}}"),
            " {{Wikipedia|", F.when(i % 10 == 0, "b@d").when(i % 10 == 1, "").when(i % 10 == 2, "commons").when(i % 10 == 3, "de").otherwise("en"), if_(i % 10 != 4, "|Article ", i % 8), "}}",
        )
        moved = F.when(i % 34 == 0, _say("#REDIRECT [[Tag:target=x", i, "]]")).otherwise(F.lit("#REDIRECT to nothing"))
        body = F.when(i % 17 == 0, moved).when(i % 13 == 0, words).when(i % 19 == 0, _say("x }} ", words)).otherwise(page)
        return self["documents"].select("doc_id", "lang", cleaned.alias("words")).select("doc_id", title.alias("title"), F.when(i % 17 == 0, "redirect").otherwise("page").alias("type"), body.alias("body"))

    def t_page_list(self) -> DataFrame:
        """The list of pages, read from a tab-separated file that has other pages too."""
        rows = self["raw_pages"].select("type", F.lit("2024-01-02T00:00:00Z").alias("timestamp"), F.lit("0").alias("namespace"), "title")
        others = self["documents"].select(F.lit("page").alias("type"), F.lit("2024-01-02T00:00:00Z").alias("timestamp"), F.lit("0").alias("namespace"), _say("Main page ", F.col("doc_id")).alias("title"))
        path = catalog.scratch(self.spark)
        rows.unionByName(others).write.option("sep", "\t").option("quote", "").csv(path)
        return readers.read_wiki_page_list(self.spark, path)

    def t_page_bodies(self) -> DataFrame:
        """Cached bodies: of every page an old one, of most the current one, and some of pages that are not listed."""
        rows = self["raw_pages"]
        old = rows.select("title", F.lit("2023-01-01T00:00:00Z").alias("timestamp"), F.lit("old").alias("body"))
        new = rows.where("doc_id % 23 <> 0").select("title", F.lit("2024-01-03T00:00:00Z").alias("timestamp"), "body")
        gone = rows.select(_say("Key:gone", F.col("doc_id")).alias("title"), F.lit("2024-01-03T00:00:00Z").alias("timestamp"), F.lit("gone").alias("body"))
        return old.unionByName(new).unionByName(gone)

    def t_current_bodies(self) -> DataFrame:
        return readers.current_wiki_bodies(self["page_list"], self["page_bodies"])

    def t_parsed_titles(self) -> DataFrame:
        return wiki.parse_titles(self["raw_pages"].drop("doc_id"))

    def documentation(self) -> dict[str, DataFrame]:
        return wiki.documentation(self["documented_pages"])

    def t_documented_pages(self) -> DataFrame:
        return wiki.documented(wiki.check_titles(self["parsed_titles"])[0])

    def t_page_links(self) -> DataFrame:
        i = F.col("doc_id")
        source = (
            F.when(i % 6 == 0, _say("Tag:key", i % 10, "=v")).when(i % 6 == 1, _say("DE:Key:key", i % 10)).when(i % 6 == 2, _say("Category:c", i))
            .when(i % 6 == 3, _say("User talk:u", i)).when(i % 6 == 4, _say("Proposed_features/p", i)).otherwise(_say("Relation:r", i % 10))
        )
        to = F.when(i % 2 == 0, _say("Key:key", i % 10)).otherwise(_say("Tag:key", i % 10, "=v"))
        path = catalog.scratch(self.spark)
        self["documents"].select(source.alias("from_title"), to.alias("to_title")).write.option("sep", "\t").option("quote", "").csv(path)
        return readers.read_links(self.spark, path)

    def t_image_cache(self) -> DataFrame:
        """Cached answers about images, several for most titles and, beyond 3,000 parts, of one time."""
        n = F.col("p_partkey")
        title = _say("File:p", n % 500, ".png")
        info = F.when(n % 9 != 0, _say('"imageinfo":[{"width":', n % 90 + 10, ',"height":', n % 70 + 5, ',"size":', n * 1000, ',"mime":"image/png","url":"http://i.example/', n % 500, '.png","thumburl":"https://i.example/t/', n % 500, F.when(n % 12 == 5, "/x.png").otherwise("/200px-x.png"), '"}],')).otherwise(F.lit(""))
        m = n % 500
        also = F.when(m % 10 == 3, m + 1).when(m % 50 == 7, m + 1).when(m % 50 == 8, m - 1)  # a chain, and two that lead to each other
        more = F.coalesce(_say(',{"from":"', title, '","to":"File:p', also, '.png"}'), F.lit(""))
        body = _say('{"query":{"normalized":[{"from":"file:p', m, '.png","to":"', title, '"}', more, '],"pages":{"', n, '":{', info, '"imagerepository":"', _pick(("local", "shared"), n), '","title":"', title, '"}}}}')
        stamp = F.date_sub(F.lit("2024-04-01").cast("date"), (n % 120).cast("int")).cast("timestamp")
        return self["part"].select(title.alias("title"), stamp.alias("timestamp"), body.alias("body"), n.alias("entry"))

    def t_pages_with_images(self) -> DataFrame:
        """Pages that name images as their authors wrote them."""
        i = F.col("doc_id")
        image = F.when(i % 3 == 0, _say("file:p", i % 500, ".png")).when(i % 3 == 1, _say("File:p", i % 500, ".png"))
        return self["documents"].select(_say("Key:k", i).alias("title"), image.alias("image"))

    # ---- projects
    def t_fetch_log(self) -> DataFrame:
        """Two fetches of each supplier's project file."""
        k = F.col("s_suppkey")
        head = _say('{"data_format":1,"data_updated":"', F.when(k % 6 == 5, "yesterday").otherwise("20240101T000000Z"), '","project":{"name":"P', k, '","description":"d","project_url":"http')
        good = _say(
            head, F.when(k % 2 == 0, "s").otherwise(""), "://x.example/", k, '","contact_name":"c","contact_email":"e"', F.when(k % 4 == 1, _say(',"doc_url":"https://doc.example/', k, '"')).otherwise(""), F.when(k % 3 == 1, _say(',"icon_url":"http://icon.example/', k, '"')).otherwise(""), F.when(k % 7 == 6, ',"colour":"red"').otherwise(""), "},",
            F.when(k % 9 == 8, '"more":1,').otherwise(""), '"tags":[{"key":"brand","value":"Brand#', k % 5, '"', F.when(k % 2 == 0, _say(',"description":"about ', k, '"')).otherwise(""), F.when(k % 3 == 0, ',"doc_url":"https://doc.example/b","icon_url":"https://icon.example/b"').otherwise(""),
            ',"object_types":', F.when(k % 2 == 0, '["node","way"]').otherwise('["area"]'), '},{"key":"k', k, '"},{"key":"bad","object_types":["house"]},',
            '{"key":"n","value":5},{"value":"nokey"},{"key":"e","object_types":[]},{"key":7}]}',
        )
        text = (
            F.when(k % 10 == 1, "no json").when(k % 10 == 2, "[1,2]").when(k % 10 == 3, '{"data_format":2}')
            .when(k % 10 == 4, '{"data_format":1,"project":{"name":"x"},"tags":[]}').when(k % 10 != 0, good)
        )
        at = lambda day: F.to_timestamp(F.lit(f"2024-01-{day} 00:00:00"))
        common = [F.col("s_name").alias("id"), _say("https://x.example/", k, ".json").alias("json_url"), F.when(k % 2 == 0, "").otherwise("2023-12-31 00:00:00").alias("last_modified")]
        first = self["supplier"].select(*common, at("01").alias("fetch_date"), F.when(k % 4 == 0, "404").otherwise("200").alias("fetch_status"), F.lit('{"data_format":1}').alias("fetch_json"))
        second = self["supplier"].select(*common, at("05").alias("fetch_date"), F.when(k % 10 == 0, "404").otherwise("200").alias("fetch_status"), text.alias("fetch_json"))
        return first.unionByName(second)

    def t_checked_projects(self) -> DataFrame:
        newest = readers.load_projects(self["fetch_log"]).drop("status", "data_updated")
        return projects.validate_projects(newest.where("fetch_status = '200'"))

    # ---- registries
    def t_subtags(self) -> DataFrame:
        n, k = F.col("n_name"), F.col("n_nationkey")
        subtag = (
            F.when(k % 4 == 0, F.lower(F.substring(n, 1, 2))).when(k % 8 == 1, "Zxxx").when(k % 4 == 1, F.initcap(F.substring(n, 1, 4)))
            .when(k % 8 == 2, "001").when(k % 4 == 2, F.upper(F.substring(n, 1, 2))).otherwise(F.lower(n))
        )
        record = _say(
            "Type: ", _pick(("language", "script", "region", "variant"), k), "\nSubtag: ", subtag, "\nDescription: ", F.when(k == 4, "Private use").otherwise(F.concat(n, F.lit("\n  in region "), F.col("n_regionkey").cast("string"))),
            F.when(k % 3 == 0, _say("\nDescription: Second ", n)).otherwise(""), "\nAdded: 2005-10-16", F.when(k % 12 == 8, "\nScope: special").otherwise(""),
            F.when(k % 8 == 0, "\nSuppress-Script: Latn").otherwise(""), F.when(k % 4 == 3, "\nPrefix: aa\nPrefix: bb").otherwise(""), "\n",
        )
        return readers.read_subtags(self.spark, self._text_file(self["nation"].select(record.alias("value")), lineSep="%%\n"))

    def t_wikipedia_sites(self) -> DataFrame:
        k = F.col("n_nationkey")
        line = _say(k, ",", F.lower(F.substring("n_name", 1, 2)), F.char(k + 97), ",", _pick(("wikipedia", "wiktionary"), k), ",", F.col("n_name"), " &amp; &lt;others&gt;,x")
        return readers.read_wikipedia_sites(self.spark, self._text_file(self["nation"].select(line.alias("value"))))

    def t_unicode_scripts(self) -> DataFrame:
        k = F.col("r_regionkey")
        lines = self["region"].select(_say("sc ; S00", k, " ; Script", k).alias("value"))
        return readers.read_unicode_scripts(self.spark, self._text_file(lines.union(self["region"].select(_say("# about ", F.col("r_name"))))))

    def t_unicode_codepoint_script_mapping(self) -> DataFrame:
        """Six letters from A on for each region."""
        k = F.col("r_regionkey")
        line = _say(F.lpad(F.hex(k * 6 + 65), 4, "0"), "..", F.lpad(F.hex(k * 6 + 70), 4, "0"), "    ; Script", k, " # Lu [6] of ", F.col("r_name"))
        return readers.read_script_ranges(self.spark, self._text_file(self["region"].select(line.alias("value"))), self["unicode_scripts"])

    def t_unicode_data(self) -> DataFrame:
        """The characters of the names of nations."""
        chars = self["nation"].select(F.explode(F.split("n_name", "")).alias("c")).where("c <> ''").distinct()
        line = _say(F.lpad(F.hex(F.ascii("c")), 4, "0"), ";NAME OF ", F.col("c"), ";", F.when(F.col("c") == " ", "Zs").otherwise("Lu"), ";0;L")
        return readers.read_unicode_data(self.spark, self._text_file(chars.select(line.alias("value"))), self["unicode_codepoint_script_mapping"])

    def editor_lists(self) -> tuple[DataFrame, DataFrame]:
        """Deprecated tags (old tags and their replacements) and discarded keys as an editor lists them."""
        k, path = F.col("n_nationkey"), catalog.scratch(self.spark)
        old = F.create_map(_say("old", k % 7), F.when(k % 3 == 0, "*").otherwise(F.lower("n_name")))
        entry = F.to_json(F.struct(old.alias("old"), F.create_map(F.lit("new"), F.lower("n_name")).alias("replace")))
        listed = self["nation"].agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ","), F.lit("]")).alias("value"))  # nations are few
        listed.write.text(path)
        entry = F.concat(F.lit('"'), F.lower("r_name"), F.lit('":true'))
        keys = self["region"].agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value"))  # regions are few
        return readers.read_editor_lists(self.spark, path, self._text_file(keys), "id")

    def t_editor_lists(self) -> DataFrame:
        return self.editor_lists()[0]

    def t_discarded_keys(self) -> DataFrame:
        return self.editor_lists()[1]

    # ---- Wikidata
    def _bindings(self, **fields: Column) -> DataFrame:
        """Query results in JSON, some bindings in each file, read by the reader of bindings."""
        k = F.col("s_suppkey")
        item = _say(F.when(k % 7 == 0, "http://elsewhere.example/").otherwise("http://www.wikidata.org/entity/"), _pick(("Q", "P"), k), k)
        named = {"item": item} | fields
        binding = F.struct(*[F.struct(F.lit("literal").alias("type"), c.alias("value")).alias(n) for n, c in named.items()])
        rows = self["supplier"].groupBy(F.floor(k / 100).alias("part")).agg(F.to_json(F.collect_list(binding)).alias("b"))  # a hundred each
        path = self._text_file(rows.select(_say('{"head":{"vars":["item"]},\n"results":{"bindings":', F.col("b"), "}}").alias("value")))
        return readers.read_wikidata_bindings(self.spark, path)

    def t_key_bindings(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self._bindings(prop=_say("key", k % 20), itemLabel=_say("about ", F.col("s_name")))

    def t_tag_bindings(self) -> DataFrame:
        k = F.col("s_suppkey")
        tag = F.when(k % 11 == 0, _say("key", k % 20)).when(k % 13 == 0, _say("a=b=", k)).otherwise(_say("key", k % 20, "=val", k))
        return self._bindings(prop=tag, itemLabel=_say("about ", F.col("s_name")))

    def t_label_bindings(self) -> DataFrame:
        return self._bindings(label=_say("label of about ", F.col("s_name")), label_lang=_pick(("en", "de", "pt-br"), F.col("s_suppkey")))

    def wikidata(self) -> dict[str, DataFrame]:
        keys, tags = (self[n].select("item", "prop", "description") for n in ("key_bindings", "tag_bindings"))
        labels = self["label_bindings"].select("item", "label", "lang")
        made = registries.wikidata_tables(keys, tags, labels)
        return dict(zip(("wikidata_keys", "wikidata_tags", "wikidata_labels", "wikidata_errors"), made))

    def t_wikidata_keys(self) -> DataFrame:
        return self.wikidata()["wikidata_keys"]

    def t_wikidata_tags(self) -> DataFrame:
        return self.wikidata()["wikidata_tags"]

    def t_wikidata_labels(self) -> DataFrame:
        return self.wikidata()["wikidata_labels"]

    def t_wikidata_errors(self) -> DataFrame:
        return self.wikidata()["wikidata_errors"]

    # ---- others
    def t_sources(self) -> DataFrame:
        """A registry of sources for each region: a row with its time of update, from the newest order of its nations."""
        newest = self["orders"].join(self["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.max("o_orderdate").alias("data_until"))
        per = newest.join(self["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.max("data_until").cast("timestamp").alias("data_until"))
        rows = per.join(self["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.lower("r_name").alias("id"), F.col("r_name").alias("name"), "data_until", F.col("data_until").alias("update_start"), F.col("data_until").alias("update_end"), (F.col("r_regionkey") % 2 == 0).alias("visible"), "r_regionkey"
        )
        from .operators import integration

        return integration.sources(*[rows.where(F.col("r_regionkey") == k).drop("r_regionkey") for k in range(5)])

    def t_name_keys(self) -> DataFrame:
        """Keys of names in several languages, counted over customers by nation and segment."""
        code = F.lower(F.substring("n_name", 1, 2))
        tag = _pick(("", ":%", ":%-Latn", ":%-Ca-US", ":x-y-z"), F.col("c_custkey"))
        key = F.concat(_pick(("name", "old_name", "addr:name", "names"), F.floor(F.col("c_custkey") / 5)), F.replace(tag, F.lit("%"), code))
        rows = self["customer"].join(self["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.groupBy(key.alias("key")).agg(F.count("*").alias("count_all"))

    def t_link_tags(self) -> DataFrame:
        k = F.col("p_partkey")
        key = _pick(("addr:country", "image", "phone", "ref:bag", "species", "url", "website", "wikidata", "wikipedia", "other"), k)
        value = (
            F.when(k % 10 == 0, F.when(k % 20 == 0, "DE").otherwise("Germany")).when((k % 10).isin(1, 5, 6), F.when(k % 4 == 1, _say("ftp://x/", k)).otherwise(_say("https://x.example/", k)))
            .when(k % 10 == 2, _say("+49 (30) ", k)).when(k % 10 == 3, k.cast("string")).when(k % 10 == 4, F.initcap("p_name")).when(k % 10 == 7, _say("Q", k))
            .otherwise(_say(F.when(k % 20 == 8, "naa").otherwise("xx"), ":Title ", k))
        )
        return self["part"].select(key.alias("key"), value.alias("value"))

    def t_key_characters(self) -> DataFrame:
        return counting.key_characters(self["nation"].select(F.col("n_name").alias("key")), self["unicode_data"])
