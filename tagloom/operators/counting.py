"""Counts over tagged objects: tags, keys, combinations, relation types and roles, grids, similar keys and grades.

``objects`` has otype ('n', 'w', 'r'), oid, uid, ts, lon, lat, tags (map), nds (array) and members (array of struct mtype,
ref, role). Objects with null tags have no tags.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.semantics import COUNTS, counters, fold, fraction, typed

#: The whole globe in the usual proportions.
BOX, WIDTH, HEIGHT = (-180.0, -90.0, 180.0, 90.0), 360, 180


def explode_tags(objects: DataFrame) -> DataFrame:
    """(otype, oid, uid, key, value) of every tag."""
    return objects.select("otype", "oid", "uid", F.explode("tags").alias("key", "value"))


def tag_stats(object_tags: DataFrame) -> DataFrame:
    """Objects with each tag, by type."""
    return object_tags.groupBy("key", "value").agg(*typed())


def key_stats(tags: DataFrame) -> DataFrame:
    """Objects with each key and its distinct values, by type. An object has a key once, so sums over tags are counts of
    objects and the objects need no second pass."""
    sums = [F.sum(c).alias(c) for c in COUNTS]
    values = [F.count_if(F.col(c) > 0).alias(c.replace("count", "values")) for c in COUNTS]
    return tags.groupBy("key").agg(*sums, *values)


def key_users(object_tags: DataFrame) -> DataFrame:
    """Distinct last editors of the objects with each key. The exact form first removes repeated (key, user) pairs, which
    is combined before the shuffle, so a frequent key costs a row for each user and task at most."""
    return object_tags.select("key", "uid").distinct().groupBy("key").agg(F.count("uid").alias("users_all"))


def user_sketches(object_tags: DataFrame) -> DataFrame:
    """(key, users): a sketch of the distinct last editors, which can be merged with those of other days. Its standard
    error is 1.04 / sqrt(4096), 1.6 %."""
    return object_tags.groupBy("key").agg(F.hll_sketch_agg("uid", 12).alias("users"))


def merged_users(*sketches: DataFrame) -> DataFrame:
    every = functools.reduce(DataFrame.unionByName, sketches)
    return every.groupBy("key").agg(F.hll_union_agg("users").alias("users"))


def sketched_users(sketches: DataFrame) -> DataFrame:
    """(key, users_all) as the sketches estimate it."""
    return sketches.select("key", F.hll_sketch_estimate("users").alias("users_all"))


def object_counters() -> dict[str, Column]:
    """Objects and tags by type, nodes with tags, closed ways."""
    n, w, r = (F.col("otype") == t for t in "nwr")
    size = F.coalesce(F.cardinality("tags"), F.lit(0))
    closed = w & (F.size("nds") > 0) & (F.element_at("nds", 1) == F.element_at("nds", -1))
    return {
        "nodes": F.count_if(n),
        "ways": F.count_if(w),
        "relations": F.count_if(r),
        "objects": F.count("*"),
        "node_tags": F.sum(F.when(n, size)),
        "way_tags": F.sum(F.when(w, size)),
        "relation_tags": F.sum(F.when(r, size)),
        "object_tags": F.sum(size),
        "nodes_with_tags": F.count_if(n & (size > 0)),
        "closed_ways": F.count_if(closed),
    }


def object_stats(objects: DataFrame) -> DataFrame:
    """(key, value): the counters of objects."""
    return counters(objects, object_counters())


def _pairs(items: Column) -> Column:
    """All pairs (a, b), a before b, of a sorted array, made within the row."""
    n = F.size(items)
    return F.flatten(
        F.transform(
            items,
            lambda x, i: F.transform(F.slice(items, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b"))),
        )
    )


def key_combinations(objects: DataFrame) -> DataFrame:
    """Objects that have both of two keys (key1 < key2), by type. Pairs come from within the object, never from a join;
    frequent pairs are added up before the shuffle."""
    keys = objects.where(F.size("tags") > 1).select("otype", F.array_sort(F.map_keys("tags")).alias("keys"))
    pairs = keys.select("otype", F.explode(_pairs(F.col("keys"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("key1"), F.col("p.b").alias("key2")).agg(*typed())


def both_ways(combinations: DataFrame, key: str | None = None) -> DataFrame:
    """Combinations of keys or tags with each of the two as the first one (or only those that begin with the given key), so
    that those of a key stand together."""
    names = [c for c in ("key", "value") if f"{c}1" in combinations.columns]
    side = lambda a, b: F.struct(*[F.col(f"{c}{x}").alias(f"{c}{n}") for n, x in ((1, a), (2, b)) for c in names])
    rows = combinations if key is None else combinations.where((F.col("key1") == key) | (F.col("key2") == key))
    kept = [c for c in combinations.columns if c.rstrip("12") not in names]
    turned = rows.select(F.inline(F.array(side(1, 2), side(2, 1))), *kept)
    return turned if key is None else turned.where(F.col("key1") == key)


#: Selected items that are looked up inside the row; more are joined.
SMALL = 5_000


def _name(key: Column, value: Column) -> Column:
    """A text for an item; no two items have the same."""
    return F.concat(F.length(key).cast("string"), F.lit(":"), key, value)


def _number(key: Column, value: Column) -> Column:
    return F.xxhash64(_name(key, value))


def _listed(chosen: DataFrame, small: int) -> tuple[list[Row], Callable[[str], Column]] | None:
    """Selected items for the plan: (key, value, id) of each, and what gives an item from a column of ids. None if there are
    more than ``small``, or if two of them get one number."""
    rows = chosen.where("key is not null and value is not null").select("key", "value", _number(F.col("key"), F.col("value")).alias("id"))
    listed = rows.limit(small + 1).collect()  # bounded
    if len(listed) > small or len({r.id for r in listed}) < len(listed):
        return None
    table = F.from_json(F.lit(json.dumps({"id": [r.id for r in listed], "item": [[r.key, r.value] for r in listed]})), "id array<long>, item array<array<string>>")

    def item(c: str) -> Column:
        found = F.element_at(table["item"], F.array_position(table["id"], F.col(c)).cast("int"))
        return F.struct(found[0].alias("key"), found[1].alias("value"))

    return listed, item


def tag_combinations(objects: DataFrame, interesting_tags: DataFrame, min_count: int = 1000, small: int = SMALL) -> DataFrame:
    """Objects that have both of two selected items, a tag or a key (value ''), of different keys and not both keys.

    A selection of up to ``small`` items is a set in the plan: each object picks its items from it without any exchange, and
    pairs are pairs of numbers until they are added up. Beyond that, or should two items get one number, the tags are joined
    with the selection, and the items of an object are grouped again.
    """
    chosen = interesting_tags.select("key", "value").distinct()
    if found := _listed(chosen, small):
        listed, item = found
        tags = F.filter(F.map_entries("tags"), lambda e: _name(e["key"], e["value"]).isin([f"{len(r.key)}:{r.key}{r.value}" for r in listed if r.value]))
        keys = F.filter(F.map_keys("tags"), lambda k: k.isin([r.key for r in listed if not r.value]))
        numbers = F.concat(F.transform(keys, lambda k: _number(k, F.lit(""))), F.transform(tags, lambda e: _number(e["key"], e["value"])))
        items = objects.select("otype", F.sort_array(numbers).alias("items"))
    else:
        entries = F.map_entries("tags")
        both = F.concat(entries, F.transform(entries, lambda e: F.struct(e["key"], F.lit("").alias("value"))))
        rows = objects.select(F.struct("otype", "oid").alias("o"), F.inline(both))
        grouped = rows.join(chosen, ["key", "value"]).groupBy("o").agg(F.array_sort(F.collect_set(F.struct("key", "value"))).alias("items"))
        items, item = grouped.select("o.otype", "items"), F.col
    # the outer form, as a filter on the size of items would move below them and make them twice
    first = items.select("otype", "items", F.posexplode_outer("items").alias("i", "a"))
    later = F.slice("items", F.col("i") + 2, F.size("items") - F.col("i") - 1)
    pairs = first.select("otype", "a", F.explode(later).alias("b")).groupBy("a", "b").agg(*typed())
    often = lambda c: F.when(F.col("count_all") >= min_count, item(c)).alias(c)  # noqa: E731  looked up after the counts, and in few rows
    named = pairs.select(often("a"), often("b"), *COUNTS).where("a.key <> b.key and (a.value <> '' or b.value <> '')")
    sides = [(F.least("a", "b"), 1), (F.greatest("a", "b"), 2)]
    return named.select(*[side[c].alias(f"{c}{n}") for side, n in sides for c in ("key", "value")], *COUNTS)


def _relations(objects: DataFrame, interesting_rtypes: DataFrame | None) -> DataFrame:
    rows = objects.where("otype = 'r' and tags['type'] is not null").withColumn("rtype", F.col("tags")["type"])
    return rows if interesting_rtypes is None else rows.join(interesting_rtypes.select("rtype").distinct(), "rtype", "left_semi")


def relation_types(objects: DataFrame, interesting_rtypes: DataFrame | None = None) -> DataFrame:
    """Relations of each type and their members by type."""
    members = F.coalesce(F.col("members"), F.array().cast(objects.schema["members"].dataType))
    of = lambda t: F.sum(F.size(F.filter(members, lambda m: m["mtype"] == t))).cast("long")
    return _relations(objects, interesting_rtypes).groupBy("rtype").agg(
        F.count("*").alias("count"),
        F.sum(F.size(members)).cast("long").alias("members_all"),
        of("n").alias("members_nodes"),
        of("w").alias("members_ways"),
        of("r").alias("members_relations"),
    )


def relation_roles(objects: DataFrame, interesting_rtypes: DataFrame | None = None) -> DataFrame:
    """Members of each relation type and role, by type of the member."""
    members = _relations(objects, interesting_rtypes).select("rtype", F.inline("members"))
    return members.groupBy("rtype", "role").agg(*typed("mtype"))


def topup_relation_types(relation_types: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds types that are only known from tags of relations, without member counts."""
    more = tags.where("key = 'type' and count_relations > 0").select(
        F.col("value").alias("rtype"), F.col("count_relations").alias("count")
    )
    return relation_types.unionByName(more.join(relation_types, "rtype", "left_anti"), allowMissingColumns=True)


def prevalent_values(tags: DataFrame, keys: DataFrame, min_fraction: float = 0.01) -> DataFrame:
    """Values with more than a share of their key's objects; the fraction is not rounded."""
    both = tags.select("key", "value", F.col("count_all").alias("count")).join(keys.select("key", "count_all"), "key")
    return both.where(F.col("count") > F.col("count_all") * min_fraction).select(
        "key", "value", "count", fraction("count", "count_all", None).alias("fraction")
    )


def prevalent_roles(relation_types: DataFrame, relation_roles: DataFrame, min_fraction: float = 0.01) -> DataFrame:
    """Roles with more than a share of the members of their relation type; the fraction is rounded."""
    both = relation_roles.select("rtype", "role", F.col("count_all").alias("count")).join(
        relation_types.select("rtype", "members_all"), "rtype"
    )
    return both.where(F.col("count") > F.col("members_all") * min_fraction).select(
        "rtype", "role", "count", fraction("count", "members_all").alias("fraction")
    )


def node_cells(objects: DataFrame, box: tuple[float, float, float, float] = BOX, width: int = WIDTH, height: int = HEIGHT, *columns: Column) -> DataFrame:
    """(oid, x, y) and further columns: the cell of each node within the box. Points on the right and lower edge belong to
    the last cells."""
    left, bottom, right, top = box
    x = F.floor((F.col("lon") - left) / (right - left) * width)
    y = F.floor((top - F.col("lat")) / (top - bottom) * height)
    located = objects.where(F.col("lon").between(left, right) & F.col("lat").between(bottom, top) & (F.col("otype") == "n"))
    last = lambda c, n: F.least(c, F.lit(n - 1)).cast("int")
    return located.select("oid", last(x, width).alias("x"), last(y, height).alias("y"), *columns)


def way_points(objects: DataFrame) -> DataFrame:
    """(way, oid) of the nodes of tagged ways."""
    ways = objects.where((F.col("otype") == "w") & (F.size("tags") > 0))
    return ways.select(F.col("oid").alias("way"), F.explode(F.array_distinct("nds")).alias("oid"))


def way_cells(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(way, x, y): cells of the nodes of each way. Cells and points that are stored in buckets by node meet unmoved."""
    return points.join(cells, "oid").select("way", "x", "y").distinct()


def geo_grid(
    objects: DataFrame,
    by: tuple[str, ...] = ("key",),
    box: tuple[float, float, float, float] = BOX,
    width: int = WIDTH,
    height: int = HEIGHT,
    only: DataFrame | None = None,
    cells: DataFrame | None = None,
    points: DataFrame | None = None,
    small: int = SMALL,
) -> DataFrame:
    """(key[, value], object_type, x, y, count): objects in each occupied cell; a way is in the cells of its nodes, points
    outside are in none. Nodes are reduced to their cell before they meet the ways; ``cells`` (of that box) and ``points``
    may be stored tables.

    The items of an object stay together until it has its cells. Of up to ``small`` selected items each is a number until
    the counts are there, as is a cell, so that the counts of a task are pairs of numbers.
    """
    entries = F.map_entries("tags")
    parts = lambda e: (e["key"], e["value"] if "value" in by else F.lit(""))
    found = None
    if only is not None:
        chosen = only.select(*by).distinct()
        found = _listed(chosen if "value" in by else chosen.withColumn("value", F.lit("")), small)
    if found:
        listed, item = found
        picked = F.filter(entries, lambda e: _name(*parts(e)).isin([f"{len(r.key)}:{r.key}{r.value}" for r in listed]))
        rows = objects.withColumn("items", F.transform(picked, lambda e: _number(*parts(e))))
    else:
        item = F.col
        rows = objects.withColumn("items", F.transform(entries, lambda e: F.struct(*[e[c].alias(c) for c in by])))
        if only is not None:
            each = rows.withColumn("item", F.explode("items")).withColumns({c: F.col("item")[c] for c in by})
            rows = each.join(chosen, list(by), "left_semi").drop(*by).withColumn("items", F.array("item"))

    def counted(placed: DataFrame, kind: int) -> DataFrame:
        cell = (F.col("x").cast("long") * height + F.col("y")) * 2 + kind
        # the outer form, as a filter on the size of items would move below them and make them twice
        return placed.select(cell.alias("cell"), F.explode_outer("items").alias("item")).where("item is not null")

    located = node_cells(objects, box, width, height) if cells is None else cells
    met = way_cells(located, way_points(objects) if points is None else points)
    of_nodes = counted(node_cells(rows, box, width, height, F.col("items")), 0)
    of_ways = counted(rows.where("otype = 'w'").select(F.col("oid").alias("way"), "items").join(met, "way"), 1)
    grid = of_nodes.unionByName(of_ways).groupBy("item", "cell").agg(F.count("*").alias("count")).withColumn("item", item("item"))
    kind = F.when(F.col("cell") % 2 == 0, "n").otherwise("w").alias("object_type")
    place = F.expr("cell div 2")
    x, y = (F.floor(place / height).cast("int").alias("x"), (place % height).cast("int").alias("y"))
    return grid.select(*[F.col("item")[c].alias(c) for c in by], kind, x, y, "count")


def grid_cells(grid: DataFrame) -> DataFrame:
    """Occupied cells of each key, by nodes and by ways."""
    return grid.groupBy("key").agg(
        F.count_if(F.col("object_type") == "n").alias("cells_nodes"), F.count_if(F.col("object_type") == "w").alias("cells_ways")
    )


#: Keys up to this length are compared by deletions; the work on longer ones is linear in their length.
SHORT = 10


def _deletions(word: Column, most: int) -> Column:
    """The word and all words that deleting up to ``most`` characters leaves."""

    def drop(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))

    found = F.array(word)
    step = found
    for _ in range(most):
        step = F.array_distinct(F.flatten(F.transform(step, drop)))
        found = F.concat(found, step)
    return F.array_distinct(found)


def _segment(length: Column, i: int, n: int) -> tuple[Column, Column]:
    """(start from 1, size) of the i-th of n segments of words of a length; the last ones are longer by one where needed."""
    size = F.floor(length / n).cast("int")
    longer = F.greatest(F.lit(i - n) + length % n, F.lit(0))  # segments before this one that are longer
    return (size * i + longer + 1).cast("int"), (size + F.when(F.lit(n - i) <= length % n, 1).otherwise(0)).cast("int")


def _mark(kind: int, length: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(kind), length, text)


def _marks(word: Column, most: int) -> tuple[Column, Column]:
    """(marks to be found by, marks to look for) of a word; see ``similar_keys``."""
    n, none = F.length(word), F.array().cast("array<bigint>")

    def at(i: int, length: Column, size: Column) -> Callable[[Column], Column]:
        return lambda p: _mark(i, length, F.substr(word, p, size))

    left = F.when(n <= SHORT + most, F.transform(_deletions(word, most), lambda w: _mark(-1, F.lit(0), w))).otherwise(none)
    own, others = [], []
    for i in range(most + 1):
        start, size = _segment(n, i, most + 1)
        own.append(_mark(i, n, F.substr(word, start, size)))
        for shorter in range(most + 1):
            length = n - shorter
            start, size = _segment(length, i, most + 1)
            places = F.sequence(F.greatest(start - most, F.lit(1)), F.greatest(F.least(start + most, n - size + 1), F.lit(1)))
            others.append(F.when(length > SHORT, F.transform(places, at(i, length, size))).otherwise(none))
    own = F.when(n > SHORT, F.array(*own)).otherwise(none)
    return F.concat(left, own), F.array_distinct(F.concat(left, *others))


def similar_keys(keys: DataFrame, max_distance: int = 2) -> DataFrame:
    """Pairs of keys (key1 < key2) whose lower-case edit distance is at most ``max_distance``; similarity is that distance.

    Of a word cut into one segment more than there may be edits, one segment stands unchanged in the other word, shifted by
    no more than the edits. So a word is found by its segments with their number and its length, and looks for its own
    substrings at these places in words that are as long or shorter. Words of up to ``SHORT`` characters, whose segments say
    little, share instead a string that deleting so many characters from each leaves. Keys of equal lower-case form are one
    in that join and are expanded after it.
    """
    lower = keys.select("key", F.lower("key").alias("low")).distinct()
    words = lower.select("low").distinct()
    own, others = _marks(F.col("low"), max_distance)
    kept = words.select("low", F.explode(own).alias("mark"))
    asked = words.select(F.col("low").alias("low2"), F.explode(others).alias("mark"))
    pairs = kept.join(asked, "mark").where("low <> low2").select(F.least("low", "low2").alias("low"), F.greatest("low", "low2").alias("low2")).distinct()
    near = pairs.withColumn("similarity", F.levenshtein("low", "low2", max_distance)).where("similarity >= 0")
    same = words.select("low", F.col("low").alias("low2"), F.lit(0).alias("similarity"))
    a = lower.select("low", F.col("key").alias("x"))
    b = lower.select(F.col("low").alias("low2"), F.col("key").alias("y"))
    named = near.unionByName(same).join(a, "low").join(b, "low2").where("x <> y")
    return named.select(F.least("x", "y").alias("key1"), F.greatest("x", "y").alias("key2"), "similarity").distinct()


def with_counts(similar: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds count_all of both keys."""
    of = lambda n: keys.select(F.col("key").alias(f"key{n}"), F.col("count_all").alias(f"count_all{n}"))
    joined = similar.join(of(1), "key1", "left").join(of(2), "key2", "left")
    return joined.select("key1", "key2", "count_all1", "count_all2", "similarity")


def common_rare(similar: DataFrame, min_common: int = 1000, max_rare: int = 10) -> DataFrame:
    """Pairs of a common and a rare similar key."""
    names = ["key_common", "key_rare", "count_all_common", "count_all_rare", "similarity"]
    either = similar.select("key1", "key2", "count_all1", "count_all2", "similarity").toDF(*names).unionAll(
        similar.select("key2", "key1", "count_all2", "count_all1", "similarity").toDF(*names)
    )
    return either.where((F.col("count_all_common") >= min_common) & F.col("count_all_rare").between(1, max_rare))


#: Character classes by the first pattern that matches; lines are matched one by one.
CLASSES = (
    ("plain", r"(?md)^[a-z]([a-z_]*[a-z])?$"),
    ("colon", r"(?md)^[a-z][a-z_:]*[a-z]$"),
    ("letters", r"(?md)^[\p{L}\p{M}]([\p{L}\p{M}\p{N}_:]*[\p{L}\p{M}\p{N}])?$"),
    ("space", r"(?md)\p{Z}"),
    ("problem", r"""(?md)[=+/&<>;@'"?%#\\,]|\p{C}"""),
)


def character_class(keys: DataFrame, col: str = "key") -> DataFrame:
    """Adds ``characters``: plain, colon, letters, space, problem or rest."""
    found = None
    for name, pattern in CLASSES:
        hit = F.col(col).rlike(pattern)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return keys.withColumn("characters", F.when(F.col(col).isNotNull(), found.otherwise("rest")))


def key_grade(keys: DataFrame, use_wiki: bool = False, rare: int = 10, used: int = 100, often: int = 1000) -> DataFrame:
    """Adds ``grade``: u (unknown), b (bad) or g (good). Good overrides bad.

    With ``use_wiki`` a documented key in use counts as good from its first use, and a key without a class as bad; by
    default documentation is not known yet when keys are graded.
    """
    n, cls = F.col("count_all"), F.col("characters")
    wiki = F.coalesce(F.col("in_wiki"), F.lit(False)) & (n > 0) if use_wiki else F.lit(False)
    good = (
        (wiki | (n > used)) & cls.isin("plain", "colon", "letters")
        | fold("key").like("%name:%-%")
        | (n > often)
    )
    bad = cls.isin("space", "problem") | (F.col("count_all") < rare) & (cls == "rest") | (F.length("key") < 3)
    bad = bad | cls.isNull() if use_wiki else bad
    return keys.withColumn("grade", F.when(good, "g").when(bad, "b").otherwise("u"))


def key_characters(keys: DataFrame, unicode_data: DataFrame) -> DataFrame:
    """Every character of every key with what is known about it."""
    chars = keys.select("key", F.posexplode(F.split("key", "")).alias("num", "char")).where("char <> ''")
    coded = chars.withColumn("codepoint", F.ascii("char").cast("long"))
    return coded.join(unicode_data.select("codepoint", "script", "category", "name"), "codepoint", "left").select(
        "key", "num", "char", "codepoint", "script", "category", "name"
    )


def selection(
    keys: DataFrame, tags: DataFrame, relation_types: DataFrame, min_count_tags: int = 10_000, min_count_for_map: int = 1000, min_count_relations: int = 100
) -> dict[str, DataFrame]:
    """Tags and keys (value '') for combinations, tags for maps and history, relation types for roles."""
    key_items = keys.where(F.col("count_all") > min_count_tags).select("key", F.lit("").alias("value"))
    tag_items = tags.where(F.col("count_all") > min_count_tags).select("key", "value")
    return {
        "interesting_tags": key_items.union(tag_items).distinct(),
        "frequent_tags": tags.where(F.col("count_all") > min_count_for_map).select("key", "value"),
        "interesting_relation_types": tags.where((F.col("key") == "type") & (F.col("count_relations") > min_count_relations)).select(F.col("value").alias("rtype")),
    }


def selection_stats(sel: dict[str, DataFrame]) -> DataFrame:
    """Rows of each selection."""
    parts = [df.agg(F.count("*").alias("count")).select(F.lit(name).alias("name"), "count") for name, df in sel.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def table_counters() -> dict[str, dict[str, Column]]:
    """Counters of each table of counts. ``relation_types`` is the topped-up table, whose types without detail have no
    member counts."""

    def by_type(name: str) -> dict[str, Column]:
        return {f"num_{name}": F.count("*")} | {f"num_{name}_on_{t}": F.count_if(F.col(f"count_{t}") > 0) for t in ("nodes", "ways", "relations")}

    graded = {"bad": "b", "unknown": "u", "good": "g"}
    grades = {f"grade_{name}": F.count_if(F.col("grade") == g) for name, g in graded.items()}
    uses = {f"grade_key_count_{name}": F.sum(F.when(F.col("grade") == g, F.col("count_all"))) for name, g in graded.items()}
    classes = {f"{CHARACTERS_IN_KEYS}{c}": F.count_if(F.col("characters") == c) for c in (*(name for name, _ in CLASSES), "rest")}
    return {
        "plain_keys": by_type("keys") | grades | uses | classes,
        "plain_tags": by_type("tags"),
        "key_combinations": by_type("key_combinations"),
        "relation_types": {"relation_types_with_detail": F.count("members_all"), "relation_types": F.count("*")},
        "relation_roles": {"relation_roles": F.count("*")},
        "similar_keys": {"num_similar_keys": F.count("*")},
        "similar_keys_common_rare": {"num_similar_keys_common_rare": F.count("*")},
    }


#: Counters that begin so are left out where they are 0.
CHARACTERS_IN_KEYS = "characters_in_keys_"
