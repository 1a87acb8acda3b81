"""Jobs on small hand-written inputs."""

import json
import random
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tagloom.operators import chronology, counting, projects, registries, wiki
from tagloom.plans import documentation, keys, relations, search, tags
from tagloom.sources import catalog, readers


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture(scope="module")
def objects(spark):
    n = lambda oid, tags, lon=0.0, lat=0.0, uid=1: ("n", oid, 1, True, uid, None, lon, lat, tags, None, None)
    data = [
        n(1, {}), n(2, {"a": "1"}, 180.0, -90.0), n(3, {"a": "1", "b": "2", "c": "3"}, 200.0, 0.0, 2), n(4, None, 1.0, 1.0),
        ("w", 1, 1, True, 1, None, None, None, {"a": "2", "type": "road"}, [1, 2, 1], None),
        ("w", 2, 1, True, 1, None, None, None, {"b": "2"}, [1, 3], None),
        ("r", 1, 1, True, 3, None, None, None, {"type": "route", "a": "1"}, None, [("n", 1, "stop"), ("w", 1, ""), ("w", 2, "")]),
        ("r", 2, 1, True, 3, None, None, None, {"type": "site"}, None, None),
    ]
    return spark.createDataFrame(data, readers.OBJECTS)


def test_counts(objects):
    object_tags = counting.explode_tags(objects)
    plain = counting.tag_stats(object_tags)
    assert ("a", "1", 3, 2, 0, 1) in rows(plain) and ("a", "2", 1, 0, 1, 0) in rows(plain)
    by_key = {r.key: r for r in counting.key_stats(plain).collect()}
    assert (by_key["a"].count_all, by_key["a"].values_all, by_key["a"].values_nodes) == (4, 2, 1)
    assert ("a", 3) in rows(counting.key_users(object_tags))
    stats = dict(rows(counting.object_stats(objects)))
    assert (stats["objects"], stats["nodes_with_tags"], stats["closed_ways"], stats["object_tags"]) == (8, 2, 1, 10)
    assert rows(counting.key_combinations(objects), "key1", "key2", "count_all") == [("a", "b", 1), ("a", "c", 1), ("a", "type", 2), ("b", "c", 1)]
    items = objects.sparkSession.createDataFrame([("a", ""), ("b", "2"), ("type", "route")], "key string, value string")
    assert rows(counting.tag_combinations(objects, items, 1), "key1", "value1", "key2", "value2", "count_all") == [("a", "", "b", "2", 1), ("a", "", "type", "route", 1)]
    types = counting.relation_types(objects)
    assert rows(types) == [("route", 1, 3, 1, 2, 0), ("site", 1, 0, 0, 0, 0)]
    assert rows(counting.relation_roles(objects), "rtype", "role", "count_all") == [("route", "", 2), ("route", "stop", 1)]
    topped = counting.topup_relation_types(types.where("rtype = 'site'"), plain)
    assert ("route", 1, None, None, None, None) in rows(topped)


def test_grid(objects):
    grid = counting.geo_grid(objects)
    assert ("a", "n", 359, 179, 1) in rows(grid)  # the corner belongs to the last cell
    assert not [r for r in rows(grid) if r[0] == "c"]  # outside of the box
    assert rows(counting.grid_cells(grid).where("key = 'a'")) == [("a", 1, 2)]


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line, before = [i], line
        for j, y in enumerate(b, 1):
            line.append(min(before[j] + 1, line[-1] + 1, before[j - 1] + (x != y)))
    return line[-1]


def edited(rnd, word, times):
    for _ in range(times):
        at = rnd.randrange(len(word) + 1)
        word = word[:at] + rnd.choice(["", "a", "b", "é"]) + word[at + rnd.choice([0, 1]) :]
    return word


def test_similar_keys(spark):
    from itertools import combinations

    names = {"old rod", "cold rod", "Old rod", "name", "nam", "nmae", "highway", "highwya", "x", "", "hihgwya"}
    rnd = random.Random(3)
    for length in (1, 2, 3, 5, 8, 9, 10, 11, 12, 13, 14, 20, 31, 60):
        base = "".join(rnd.choice("abcd_:") for _ in range(length))
        names |= {base, base.upper(), *(edited(rnd, base, rnd.randrange(1, 4)) for _ in range(8))}
    want = sorted((*sorted(p), d) for p in combinations(sorted(names), 2) if (d := distance(p[0].lower(), p[1].lower())) <= 2)
    df = spark.createDataFrame([(n, 10) for n in names], "key string, count_all long")
    assert len(want) > 100 and rows(counting.similar_keys(df)) == sorted(want, key=repr)


def test_long_similar_keys(spark):
    rnd = random.Random(4)
    names = ["".join(rnd.choice("abcdefgh") for _ in range(120)) for _ in range(100)]
    names += [edited(rnd, n, 2) for n in names]
    df = spark.createDataFrame([(n, 10) for n in names], "key string, count_all long")
    start = time.time()
    found = rows(counting.similar_keys(df))
    assert len(found) >= 100 - 20 and all(distance(a, b) == d for a, b, d in found)
    marks = df.select(*[F.size(m) for m in counting._marks(F.col("key"), 2)]).first()
    assert marks[0] == 3 and marks[1] <= 45 and time.time() - start < 30  # strings, however long the key


def test_tag_combinations_both_ways(spark, objects):
    items = spark.createDataFrame([("a", ""), ("a", "1"), ("b", "2"), ("c", ""), ("type", "route"), ("none", "x")], "key string, value string")
    within, joined = (counting.tag_combinations(objects, items, 1, small) for small in (5000, 2))
    moved = [df._jdf.queryExecution().executedPlan().toString().count("Exchange") for df in (within, joined)]
    assert moved[0] == 1 < moved[1] and rows(within) == rows(joined) != []
    assert rows(counting.tag_combinations(objects, items.limit(0), 1)) == []


def test_tag_combinations_of_odd_values(spark):
    data = [("n", 1, {"a": "", "b": None, "c:": "1"}), ("n", 2, {"a": "", "c:": "1"}), ("w", 3, {"b": "é", "a": "x"}), ("w", 4, {}), ("r", 5, None)]
    objects = spark.createDataFrame(data, "otype string, oid long, tags map<string,string>")
    items = spark.createDataFrame([("a", ""), ("b", ""), ("b", "é"), ("b", None), (None, "x"), ("c:", "1"), ("c", ":1")], "key string, value string")
    within, joined = (rows(counting.tag_combinations(objects, items, 1, small)) for small in (5000, 2))
    assert within == joined == [("a", "", "b", "é", 1, 0, 1, 0), ("a", "", "c:", "1", 2, 2, 0, 0), ("b", "", "c:", "1", 1, 1, 0, 0)]


def test_classes_and_grades(spark):
    data = [
        ("highway", 5, "plain", "u"), ("a", 5, "plain", "b"), ("ab", 200, "plain", "g"), ("addr:street", 101, "colon", "g"),
        ("name:zh-Hant", 1, "rest", "g"), ("Straße", 50, "letters", "u"), ("a b", 50, "space", "b"), ("a=b", 2000, "problem", "g"),
        ("t\tab", 5, "problem", "b"), ("x-y", 5, "rest", "b"), ("x-z", 1001, "rest", "g"), ("abc\nDEF", 5, "plain", "u"),
    ]
    df = spark.createDataFrame([(k, n) for k, n, *_ in data], "key string, count_all long")
    got = {r.key: (r.characters, r.grade) for r in counting.key_grade(counting.character_class(df)).collect()}
    assert got == {k: (c, g) for k, _, c, g in data}


def test_history(spark):
    t = lambda d, h=0: datetime(2020, 1, d, h)
    data = [
        ("n", 1, 1, True, t(1), {"a": "1"}), ("n", 1, 2, True, t(2), {"a": "2", "b": "1"}), ("n", 1, 3, False, t(3), {"a": "2"}),
        ("n", 1, 4, True, t(4), {"a": "2"}), ("w", 1, 1, True, t(1), {"a": "1"}), ("w", 1, 2, True, t(1, 5), {}),
    ]
    h = spark.createDataFrame(data, "otype string, oid long, version int, visible boolean, ts timestamp, tags map<string,string>")
    d = lambda x: date(2020, 1, x)
    by_key = chronology.key_chronology(h)
    assert rows(by_key) == [("a", d(1), 1, 0, 0), ("a", d(3), -1, 0, 0), ("a", d(4), 1, 0, 0), ("b", d(2), 1, 0, 0), ("b", d(3), -1, 0, 0)]
    assert ("a", "1", d(2), -1, 0, 0) in rows(chronology.tag_chronology(h))
    total = rows(chronology.cumulative(by_key, end=date(2020, 2, 1)).where("key = 'a'"), "date", "count")
    assert total == [(date(2007, 10, 7), 0), (d(1), 1), (d(3), 0), (d(4), 1), (date(2020, 2, 1), 1)]
    assert rows(chronology.smoothness(by_key)) == [("a", 0.5), ("b", 0.0)]


BODY = """{{KeyDescription|key=x|description=About {{Tag|highway|primary}} things|image=File:A.jpg|onNode=yes|onWay=maybe|onArea=
|implies={{Tag|a|b}}{{Tag|a|b}} {{Key|c}}|status=approved|group=roads<!-- no | {{ -->}} {{RelatedTerm|de|Strasse}} {{RelatedTerm|road}}
{{Wikipedia||Road}} {{Wikipedia|123|Bad}}"""


def test_documentation(spark):
    titles = ["Key:highway", "DE:Tag:highway=primary", "Pt-br:Key:name", "en:Key:x", "DE:Key:a=b", "Key:a/b", "Relation:route", "Key:old", "Key:broken"]
    bodies = dict.fromkeys(titles, "text") | {"Key:highway": BODY, "Key:old": "#REDIRECT [[DE:Tag:a=b]]", "Key:broken": "}} {{x"}
    data = [(t, "redirect" if t == "Key:old" else "page", bodies[t]) for t in titles]
    good, bad = wiki.check_titles(wiki.parse_titles(spark.createDataFrame(data, "title string, type string, body string")))
    assert rows(bad, "title", "reason") == [("DE:Key:a=b", "value_in_key_page"), ("Key:a/b", "slash_in_key"), ("en:Key:x", "lang_is_en")]
    made = wiki.documentation(wiki.documented(good))
    page = made["wikipages"].where("title = 'Key:highway'").first()
    assert page.description == "About highway=primary things"
    assert (page.image, page.on_node, page.on_way, page.tgroup, page.approval_status) == ("File:A.jpg", True, False, "roads", "approved")
    assert page.tags_implies == ["a=b", "c"] and page.tags_linked == ["a=b", "c", "highway=primary"]
    status = dict(rows(made["wikipages"], "title", "status"))
    assert (status["Key:highway"], status["Key:old"], status["Pt-br:Key:name"]) == ("t", "r", "p")
    assert rows(made["related_terms"], "lang", "term") == [("de", "Strasse"), ("en", "road")]
    assert rows(made["wikipedia_links"], "lang", "link") == [("en", "Road")]
    assert rows(made["redirects"], "to_lang", "to_key", "to_value") == [("de", "a", "b")]
    reasons = {r.reason for r in made["problems"].collect()}
    assert {"invalid value for onWay parameter", "invalid lang parameter", "parsing failed"} <= reasons


def test_template_escapes():
    (t,) = wiki._templates("{{Key|a{{!}}b|c{{=}}d}}")
    assert t["name"] == "key" and wiki._templates("a }} b") is None and wiki._templates("") == []


def test_words_and_links(spark):
    pages = spark.createDataFrame([("k", None, f"Road common{'' if i else ''} x1 ab word{chr(97 + i)}") for i in range(10)], "key string, value string, body string")
    (row,) = rows(wiki.wiki_words(pages))
    assert row[:2] == ("k", "") and "road" not in row[2] and "worda" in row[2] and "x1" not in row[2]
    links = spark.createDataFrame([("Key:a", "Key:a"), ("Tag:a=b", "Key:a"), ("Key:a", "Tag:a=b"), ("Key:a", "Key:c"), ("Category:X", "Key:a"), ("DE:Map_Features", "Key:a"), ("User:Me", "Key:a"), ("Other", "Key:a")], "from_title string, to_title string")
    assert [r.link_class for r in wiki.classify_links(links).collect()] == ["same", "tag_to_key", "key_to_tag", "ktr", "category", "map_features", "user", "rest"]


def test_frequent_words_cost_a_task_few_rows(spark, monkeypatch):
    monkeypatch.setattr(wiki, "HELD_WORDS", 50)
    data = [(f"k{i % 300}", None if i % 2 else "v", f"common Common word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} rare{'abc'[i % 3] * (i % 50 + 1)} x9y") for i in range(1500)]
    pages = spark.createDataFrame(data, "key string, value string, body string")
    parts = wiki._counted_words(pages.coalesce(1), 10)
    each = {r.word: r["count"] for r in parts.groupBy("word").count().collect()}
    flushes = 1500 // 50 + 1
    assert each["common"] <= 10 * flushes and pages.where("body like '%common%'").count() == 1500
    counts, about = {}, {}
    for key, value, body in data:
        for raw in set(body.split()):
            if not any(c.isdigit() for c in raw):
                counts[raw.lower()] = counts.get(raw.lower(), 0) + 1
                about.setdefault((key, value or ""), set()).add(raw.lower())
    want = sorted(((*k, sorted(w for w in ws if counts[w] < 10)) for k, ws in about.items() if any(counts[w] < 10 for w in ws)), key=repr)
    assert want and rows(wiki.wiki_words(pages)) == want
    grams = rows(wiki.word_grams(wiki.wiki_words(pages)))
    assert grams == sorted({(t[i : i + 3], k, v) for k, v, ws in want for t in [",".join(ws)] for i in range(len(t) - 2)}, key=repr)


def test_images(spark):
    body = json.dumps({"query": {"normalized": [{"from": "File:a b.png", "to": "File:A b.png"}], "pages": {"1": {"title": "File:A b.png", "imageinfo": [{"width": 10, "height": 20, "size": 3, "mime": "image/png", "url": "http://x/y.png", "thumburl": "http://x/200px-y.png"}]}, "-1": {"title": "File:none.png"}}}})
    cache = spark.createDataFrame([("File:a b.png", datetime(2020, 1, 1), body), ("File:old.png", datetime(2019, 1, 1), "{}")], "title string, timestamp timestamp, body string")
    (row,) = wiki.image_info(cache).collect()
    assert (row.image, row.width, row.image_url, row.thumb_url_prefix, row.thumb_url_suffix) == ("File:A b.png", 10, "https://x/y.png", "http://x/", "px-y.png")
    assert rows(wiki.canonical_titles(cache)) == [("File:a b.png", "File:A b.png")]
    answer = lambda *pairs: json.dumps({"query": {"normalized": [{"from": a, "to": b} for a, b in pairs]}})
    chain = [(f"t{k}", f"t{k + 1}") for k in range(60)]
    circle = [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("same", "same"), ("two", "b"), ("two", "a"), ("a", "last")]
    answers = spark.createDataFrame([(answer(*chain[::2]),), (answer(*chain[1::2]),), (answer(*circle),), ("no json",), (None,)], "body string")
    assert rows(wiki.canonical_titles(answers)) == sorted([(f"t{k}", "t60") for k in range(60)] + [("two", "last"), ("a", "last")], key=repr)
    pages = spark.createDataFrame([("p", "t5", 1), ("q", None, 2), ("r", "x", 3)], "title string, image string, n int")
    assert rows(wiki.rewrite_images(pages, wiki.canonical_titles(answers))) == [("p", "t60", 1), ("q", None, 2), ("r", "x", 3)]
    kept = wiki.expire_cache(cache, F.lit("2020-01-20").cast("timestamp"))
    assert [r.title for r in kept.collect()] == ["File:a b.png"]


def test_projects(spark):
    good = {"data_format": 1, "data_updated": "20200101T000000Z", "more": 1, "project": {"name": "N", "description": "D", "project_url": "http://x", "contact_name": "c", "odd": 1}, "tags": [{"key": "a"}, {"key": "b", "value": "1", "object_types": ["node"]}, {"key": "c", "object_types": []}, {"key": "d", "object_types": ["bad"]}, {"key": 5}, {"value": "x"}, {"key": "e", "value": 3}]}
    cases = {"ok": json.dumps(good), "json": "{", "array": "[1]", "format": json.dumps(good | {"data_format": 2}), "name": json.dumps(good | {"project": {"description": "D", "project_url": "https://x"}}), "tags": json.dumps({k: v for k, v in good.items() if k != "tags"})}
    df = spark.createDataFrame([(k, "200", v) for k, v in cases.items()], "id string, fetch_status string, fetch_json string")
    checked = projects.validate_projects(df).cache()
    got = {r.id: r for r in checked.collect()}
    assert {k: r.status for k, r in got.items()} == {"ok": "OK", "json": "JSON_ERROR", "array": "PARSE_ERROR", "format": "PARSE_ERROR", "name": "PARSE_ERROR", "tags": "PARSE_ERROR"}
    log = got["ok"].error_log
    assert "unknown property: more" in log and "unknown property: odd" in log and "contact_email" in log and "https" in log and got["ok"].name == "N"
    found = projects.project_tags(checked)
    assert rows(found, "key", "value", "on_node", "on_way") == [("a", None, True, True), ("b", "1", True, False), ("c", None, True, True)]
    counted = projects.project_counters(checked, found).where("id = 'ok'").first()
    assert (counted.key_entries, counted.tag_entries, counted.unique_keys, counted.unique_tags) == (2, 1, 3, 1)


def test_registries(spark, tmp_path):
    (tmp_path / "subtags").write_text("File-Date: 2020-01-01\n%%\nType: language\nSubtag: de\nDescription: German\nDescription: Deutsch\n  continued\nAdded: 2005-10-16\nSuppress-Script: Latn\n%%\nType: script\nSubtag: Zxxx\nDescription: None\n%%\nType: region\nSubtag: 001\nDescription: World\n%%\nType: region\nSubtag: AT\nDescription: Austria\nPrefix: a\nPrefix: b\n%%\nType: language\nSubtag: qaa\nDescription: Private use\n%%\nType: language\nSubtag: mul\nDescription: Many\nScope: special\n")
    subtags = readers.read_subtags(spark, str(tmp_path / "subtags"))
    assert rows(subtags, "stype", "subtag", "description", "prefix") == [("language", "de", "German. Deutsch continued", None), ("region", "AT", "Austria", "a,b")]
    (tmp_path / "alias").write_text("sc ; Latn ; Latin\nsc ; Cyrl ; Cyrillic\nsc ; Hani ; Han\nxx ; no ; no\n")
    (tmp_path / "ranges").write_text("# c\n0041..005A ; Latin # L& [26] x\n0400..04FF ; Cyrillic # L& [256] y\n4E00..9FFF ; Han # Lo [9] z\n")
    (tmp_path / "data").write_text("0041;LATIN CAPITAL LETTER A;Lu;x\n0436;ZHE;Ll;x\n1F600;GRINNING FACE;So;x\n")
    scripts = readers.read_unicode_scripts(spark, str(tmp_path / "alias"))
    ranges = readers.read_script_ranges(spark, str(tmp_path / "ranges"), scripts)
    data = readers.read_unicode_data(spark, str(tmp_path / "data"), ranges)
    assert dict(rows(data, "codepoint", "script")) == {0x1F600: "Zzzz", 0x41: "Latn", 0x436: "Cyrl"}
    t = {"unicode_data": data, "unicode_codepoint_script_mapping": ranges, "unicode_scripts": scripts}
    chars = documentation.characters(t, spark.createDataFrame([("A中😀ж",)], "text string"))
    assert rows(chars, "num", "char", "script") == [(0, "A", "Latn"), (1, "中", "Hani"), (3, "ж", "Cyrl")]
    assert rows(counting.key_characters(spark.createDataFrame([("Aж",)], "key string"), data), "num", "codepoint") == [(0, 0x41), (1, 0x436)]
    names = spark.createDataFrame([("name", 5), ("name:de", 4), ("old_name:xx", 3), ("a:name:DE", 2), ("name:de-AT", 1), ("named", 1)], "key string, count_all long")
    got = {r.key: r for r in documentation.keys_name({"keys": names, "subtags": subtags}).collect()}
    assert (got["name:de"].lang_state, got["old_name:xx"].lang_state, got["a:name:DE"].lang_state) == ("good", "okay", "bad")
    assert got["name:de-AT"].region == "AT" and got["name"].lang_state is None and "named" not in got and got["a:name:DE"].prefix == "a"


def test_wikidata(spark):
    e = "http://www.wikidata.org/entity/"
    k = spark.createDataFrame([(e + "P1", "highway", "d"), ("bad", "x", None)], "item string, prop string, description string")
    t = spark.createDataFrame([(e + "Q10", "a=b", None), (e + "Q9", "a", None), (e + "Q8", "a=b=c", None)], "item string, prop string, description string")
    labels = spark.createDataFrame([(e + "Q10", "ten", "en"), ("bad", "x", "en")], "item string, label string, lang string")
    keys_, tags_, labels_, errors = registries.wikidata_tables(k, t, labels)
    assert rows(keys_) == [("P1", "highway")] and rows(tags_) == [("Q10", "a", "b")] and errors.count() == 3
    assert dict(rows(registries.wikidata_stats(keys_, tags_, labels_, errors)))["wikidata_tags_qcode"] == 1
    assert rows(documentation.wikidata_tags({"wikidata_tags": tags_, "wikidata_labels": labels_}), "code", "label") == [("Q10", "ten")]
    mapping = spark.createDataFrame([({"a": "1", "b": "*"}, None), ({"a": "1"}, {"c": "2"})], "old_tags map<string,string>, replace_tags map<string,string>")
    assert rows(registries.deprecated_tags(mapping)) == [("a", "1"), ("b", None)]


def test_bindings_in_pieces(spark, tmp_path):
    value = lambda v: {"type": "literal", "value": v}
    made = [{"item": value(f"http://x/Q{k}"), "label": value(f'Straße "bindings": [ {k} ]}} é'), "label_lang": value("de" if k % 2 else "en")} for k in range(200)]
    text = json.dumps({"head": {"vars": ["bindings"]}, "results": {"bindings": made}}, ensure_ascii=False, indent=1) + "\n" + json.dumps({"results": {"bindings": []}}) + json.dumps({"results": {"bindings": [{"prop": value("a=b")}]}})
    for size in (1, 7, 1000, 10**6):
        pieces = iter([text.encode()[i : i + size] for i in range(0, len(text.encode()), size)])
        assert list(readers.bindings_in(lambda p=pieces: next(p, b""))) == [*made, {"prop": value("a=b")}]
    with pytest.raises(ValueError, match="ends within"):
        list(readers.bindings_in(iter([text.encode()[:3000], b""]).__next__))
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text("{}")
    found = rows(readers.read_wikidata_bindings(spark, str(tmp_path)))
    assert len(found) == 201 and ("http://x/Q1", None, None, 'Straße "bindings": [ 1 ]} é', "de") in found and (None, "a=b", None, None, None) in found


def test_days_are_merged(spark):
    """Day by day from the last states equals all versions at once, with versions that come again or too late."""
    rnd = random.Random(7)
    versions = {}
    for k in range(600):
        otype, oid = rnd.choice("nwr"), rnd.randrange(12)
        n = versions.setdefault((otype, oid), [])
        tags = None if rnd.random() < 0.1 else {rnd.choice("abc"): rnd.choice("12") for _ in range(rnd.randrange(4))}
        n.append((otype, oid, len(n) + 1, rnd.random() > 0.15, datetime(2020, 1, 1 + k // 60, k % 24), tags))
    schema = "otype string, oid long, version int, visible boolean, ts timestamp, tags map<string,string>"
    everything = sorted((r for n in versions.values() for r in n), key=lambda r: r[4])
    df = lambda rows_: spark.createDataFrame(rows_, schema)
    for by_value, whole in ((False, chronology.key_chronology), (True, chronology.tag_chronology)):
        states, series = chronology.object_states(df([])), whole(df([]))
        for day in range(1, 11):
            new = [r for r in everything if r[4].day == day]
            again = [r for r in everything if r[4].day < day][-5:]
            steps, states = chronology.merge_day(states, df(new + again), by_value)
            series, states = spark.createDataFrame(chronology.add_series(series, steps).collect(), series.schema), spark.createDataFrame(states.collect(), states.schema)
        assert rows(series) == rows(whole(df(everything)))
        assert rows(states, "otype", "oid", "version") == rows(chronology.object_states(df(everything)), "otype", "oid", "version")


def test_states_are_not_moved(spark, tmp_path):
    schema = "otype string, oid long, version int, visible boolean, ts timestamp, tags map<string,string>"
    old = spark.createDataFrame([("n", k, 1, True, datetime(2020, 1, 1), {"a": "1"}) for k in range(50)], schema)
    new = spark.createDataFrame([("n", 3, 2, True, datetime(2020, 1, 2), {"b": "1"})], schema)
    catalog.write_tables({"states": chronology.object_states(old)}, str(tmp_path), bucket_by={"states": ["otype", "oid"]}, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps, states = chronology.merge_day(catalog.Catalog(spark, str(tmp_path))["states"], new)
        for df in (steps, states):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(otype") == 1  # of the day
        assert rows(steps) == [("a", date(2020, 1, 2), -1, 0, 0), ("b", date(2020, 1, 2), 1, 0, 0)] and states.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_users_of_days_are_merged(spark):
    rnd = random.Random(9)
    days = [[("k1", rnd.randrange(5000)) for _ in range(3000)] + [("k2", rnd.randrange(20)) for _ in range(50)] + [("k3", None)] for _ in range(3)]
    df = lambda rows_: spark.createDataFrame(rows_, "key string, uid long")
    merged = counting.merged_users(*[counting.user_sketches(df(d)) for d in days])
    whole = counting.user_sketches(df([r for d in days for r in d]))
    found = rows(counting.sketched_users(merged))
    assert found == rows(counting.sketched_users(whole))
    exact = dict(rows(counting.key_users(df([r for d in days for r in d]))))
    assert all(abs(n - exact[k]) <= 0.05 * exact[k] for k, n in found) and exact["k1"] > 4000


def test_grid_from_stored_cells(spark, objects, tmp_path):
    tables = {"node_cells": counting.node_cells(objects), "way_points": counting.way_points(objects)}
    catalog.write_tables(tables, str(tmp_path), bucket_by={"node_cells": ["oid"], "way_points": ["oid"]}, buckets=4)
    c = catalog.Catalog(spark, str(tmp_path))
    assert rows(counting.geo_grid(objects, cells=c["node_cells"], points=c["way_points"])) == rows(counting.geo_grid(objects))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = counting.way_cells(c["node_cells"], c["way_points"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(oid" not in plan and plan.count("Bucketed: true") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_query_symmetry_and_errors(spark, objects):
    combos = counting.key_combinations(objects)
    table = {"key_combinations": combos, "keys": counting.key_stats(counting.tag_stats(counting.explode_tags(objects)))}
    a = dict(rows(keys.key_combinations(table, "a"), "other_key", "together_count"))
    assert all(dict(rows(keys.key_combinations(table, k), "other_key", "together_count"))["a"] == n for k, n in a.items())
    with pytest.raises(ValueError):
        keys.key_combinations(table, "")
    with pytest.raises(ValueError):
        keys.key_combinations(table, "a", T="areas")
    assert tags.parse_tag_list("k=v1,v2,k2=*") == [("k", "v1"), ("k", "v2"), ("k2", None)]
    assert search.tokens("Foo-Bar_1 é") == ["foo", "bar", "1", "é"]
    few = {"relation_types": counting.relation_types(objects), "relation_roles": counting.relation_roles(objects)}
    got = rows(relations.relation_roles(few, "route", min_fraction=0.5), "role", "count_all_members")
    assert got == [("", 2), (None, 1)]


def test_sinks(spark, tmp_path):
    stats = spark.createDataFrame([("a", 1)], "key string, value long")
    for value in (1, 2):
        catalog.append_history(stats.withColumn("value", F.lit(value).cast("long")), str(tmp_path / "h"), F.lit("2020-01-01"))
    catalog.append_history(stats, str(tmp_path / "h"), F.lit("2020-01-02"))
    assert rows(spark.read.parquet(str(tmp_path / "h")), "key", "value") == [("a", 1), ("a", 2)]
    one = json.loads(catalog.result_envelope(stats, stats, "/x", page_no=1, rp=10).first().value)
    assert one == {"url": "/x", "data_until": None, "page": 1, "rp": 10, "total": 1, "data": [{"key": "a", "value": 1}]}
    catalog.write_tables({"stats": stats}, str(tmp_path / "t"))
    c = catalog.Catalog(spark, str(tmp_path / "t"), ["stats"])
    c.register()
    assert spark.sql("select count(*) from stats").first()[0] == 1


def test_images_of_one_time(spark):
    """Of several answers of one time the first in the cache counts, by number and not by text."""
    body = lambda n: json.dumps({"query": {"pages": {str(n): {"title": "File:a", "imageinfo": [{"width": n}]}}}})
    day = datetime(2020, 1, 1)
    cache = spark.createDataFrame([("File:a", day, body(n), n) for n in (18006, 6, 3006)] + [("File:a", datetime(2019, 1, 1), body(1), 1)], "title string, timestamp timestamp, body string, entry long")
    kept = wiki.expire_cache(cache, F.lit("2020-01-20").cast("timestamp"))
    assert [(r.entry, r.body) for r in kept.collect()] == [(6, body(6))]
    assert [r.width for r in wiki.image_info(kept).collect()] == [6]
    assert [r.width for r in wiki.image_info(cache.where("entry > 1")).collect()] == [6]
    assert len(wiki.image_info(cache.drop("entry").where(F.col("timestamp") == day)).collect()) == 1


def test_grid_of_selected_tags(spark):
    """Few selected items are numbers until they are counted, more are joined; both give the same cells."""
    where = [(-180.0, 90.0), (179.99, -89.99), (180.0, -90.0), (0.0, 0.0), (0.0, 0.0), (None, 0.0)]
    data = [("n", i, lon, lat, {"a": "x", "b": None if i == 3 else "y", "": "", "1:a": "x"}, None) for i, (lon, lat) in enumerate(where)]
    data += [("w", 50, None, None, {"a": "x", "c": "z"}, [0, 3, 3, 4]), ("w", 51, None, None, None, [0]), ("w", 52, None, None, {"b": "y"}, [5, 99])]
    objects = spark.createDataFrame(data, "otype string, oid long, lon double, lat double, tags map<string,string>, nds array<long>")
    only = spark.createDataFrame([("a", "x"), ("b", "y"), ("", ""), (None, "x"), ("b", None), ("none", "z"), ("a", "x")], "key string, value string")
    want = [("", "", "n", 0, 0, 1), ("", "", "n", 180, 90, 2), ("", "", "n", 359, 179, 2), ("a", "x", "n", 0, 0, 1), ("a", "x", "n", 180, 90, 2), ("a", "x", "n", 359, 179, 2)]
    want += [("b", "y", "n", 0, 0, 1), ("b", "y", "n", 180, 90, 1), ("b", "y", "n", 359, 179, 2), ("a", "x", "w", 0, 0, 1), ("a", "x", "w", 180, 90, 1)]
    want = sorted(want, key=repr)
    found = counting.geo_grid(objects, ("key", "value"), only=only)
    assert rows(found) == want == rows(counting.geo_grid(objects, ("key", "value"), only=only, small=1))
    assert [c for c, t in found.dtypes if t == "int"] == ["x", "y"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan and "keys=[item#" in plan  # not texts
    every = counting.geo_grid(objects, ("key", "value"))
    assert rows(every.join(only, ["key", "value"], "left_semi")) == want
    assert rows(counting.geo_grid(objects, only=only)) == rows(counting.geo_grid(objects).where("key in ('a', 'b', '')"))


def test_parsed_pages_go_out_in_parts(spark):
    """A task holds a few parsed pages, whatever number comes in at once."""
    import pyarrow as pa

    n = 3 * wiki.PAGES + 5
    bodies = ["{{Key|k%d}}" % i if i % 5 else None if i % 2 else "}}" for i in range(n)]
    parts = list(wiki._parsed_bodies(iter([pa.array(bodies), pa.array([], pa.string()), pa.array(bodies[:1])])))
    assert max(map(len, parts)) <= wiki.PAGES and sum(map(len, parts)) == n + 1
    want = [(str(i), b != "}}", [["k%d" % i]] if b and b != "}}" else []) for i, b in enumerate(bodies)]
    pages = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "title string, body string").coalesce(1)
    got = [(r.title, r.parsed, [t.params for t in r.templates]) for r in wiki.extract_templates(pages).collect()]
    assert got == want


def test_projects_are_checked_once(spark):
    """A condition on the document does not make the checks a second time; odd entries of the tags are left out."""
    head = {"data_format": 1, "project": {"name": "N", "description": "D", "project_url": "https://x", "contact_name": "c", "contact_email": "e"}}
    tags = {"none": [], "null": [None, 5, "x", {}], "one": [{"key": "a"}, {"key": None}]}
    data = [(i, "200", json.dumps(head | {"tags": t})) for i, t in tags.items()] + [("bad", "200", "{"), ("empty", "200", None)]
    found = projects.project_tags(projects.validate_projects(spark.createDataFrame(data, "id string, fetch_status string, fetch_json string")))
    assert rows(found.select("project_id", "key", "value", "on_node")) == [("one", "a", None, True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("top level is not an object") == 1 and plan.count("parseJson(fetch_json") == 1


def test_listed_bodies_are_not_sorted(spark):
    bodies = spark.createDataFrame([("a", "1", "x"), ("a", "2", None), ("b", "1", "y"), (None, "1", "z")], "title string, timestamp string, body string")
    pages = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "title string")
    found = readers.listed_bodies(bodies, pages)
    assert rows(found) == [("a", "1", "x"), ("a", "2", None)]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and "ShuffledHashJoin" in found._jdf.queryExecution().executedPlan().toString()
