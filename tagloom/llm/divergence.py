"""How the sources of a language differ in the words they use.

Counts of words are added up inside the tasks that read the texts, then by (language, source, term). A term is kept if
enough documents of its language have it. What a group (language, source) says about a term is a share that depends on the
count of the term in the group alone, its count level. So the distance of two groups needs only their joint table: how many
terms have level i in one and level j in the other.

One-hot level products: a block of ``TERMS`` terms is a matrix X of indicators with a column for each (group, level) that
occurs in it, level 0 too. The product of its transpose with itself holds the joint tables of all pairs of groups; it is
exact, as its numbers are below 2 to the power 24. Groups are taken in tiles of ``TILE``, so a product has at most
``TERMS * TILE`` columns. Joint tables are linear in the terms: those of blocks are added up (``joint_tables``), or priced
where they are made and the prices added up (``distances``).

Defined results: null text, language and source are empty; a group without kept terms has rows with value 0; repeated rows
count as often as they stand; other columns are ignored; an empty table gives no rows; whole texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS, arrow_schema, hand_back, written

#: Letters are A-Z (made small), a-z and everything beyond ASCII; the rest parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Different (group, term) that a task holds before it hands on what it has counted.
HELD = 200_000
#: Terms of a block, and groups of a tile.
TERMS, TILE = 32, 32
#: Added to every count; shares are in units of 1 / SCALE.
PRIOR, SCALE = 5, 1_000_000_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split()


def partial_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, in parts that are to be added up."""
    schema = "lang string, source string, term string, n long, docs long"
    fields = arrow_schema(schema)

    def out(held: dict) -> pa.RecordBatch:
        rows = ((lang, source, term, n, in_docs[term]) for (lang, source), (of_term, in_docs) in held.items() for term, n in of_term.items())
        columns = list(zip(*rows)) or [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(f.type) if f.name == "term" else pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                for lang, source, text in zip(*(c.slice(at, ROWS).to_pylist() for c in whole.columns)):
                    words = terms_of(text)
                    of_term, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                    of_term.update(words)
                    in_docs.update(set(words))
                if sum(len(of_term) for of_term, _ in held.values()) > HELD:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)
        held = {}
        hand_back()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    return docs.select(*named, F.col(text_col).alias("text")).mapInArrow(run, schema)


def kept_terms(partial: DataFrame, least: int) -> DataFrame:
    """(lang, term, total, cells) of the terms that ``least`` documents of the language have; cells are (source, n)."""
    each = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = each.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells")
    )
    return found.where(F.col("docs") >= least).drop("docs")


def groups_of(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, size, lang_size, v): every group that occurs, its number of kept words, that of its language, and
    the number of kept terms."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    sizes = kept.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count("*").alias("v"))
    found = docs.select(*named).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    return found.na.fill(0, ["size", "lang_size", "v"])


def share(count: str, size: str, v: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (size + PRIOR * v)), exact at any size."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"1 + ({wide(SCALE)} * ({wide(count)} + {PRIOR})) div ({wide(size)} + {PRIOR} * {wide(v)})")


def level_rows(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, counts, sizes): for each term its count in every source of the language, by source."""
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "size"))).alias("sources"))
    rows = kept.select("lang", "total", F.map_from_entries("cells").alias("of")).join(langs, "lang")
    counts = F.transform("sources", lambda s: F.coalesce(F.try_element_at("of", s["source"]), F.lit(0)))
    return rows.select("lang", "total", counts.alias("counts"), F.col("sources.size").alias("sizes"))


def _columns(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(X, group, level): the indicator matrix of a block (terms x groups) and what its columns stand for."""
    levels = [np.unique(counts[:, g], return_inverse=True) for g in range(counts.shape[1])]
    starts = np.concatenate(([0], np.cumsum([len(v) for v, _ in levels])))
    x = np.zeros((len(counts), starts[-1]), np.float32)
    for (_, at), start in zip(levels, starts):
        x[np.arange(len(counts)), start + at] = 1
    return x, np.repeat(np.arange(len(levels)), np.diff(starts)), np.concatenate([v for v, _ in levels])


def products(counts: np.ndarray) -> Iterator[tuple[np.ndarray, tuple, tuple]]:
    """(joint, (group, level) of its rows, (group, level) of its columns) for all tiles of a block, each pair once."""
    tiles = [(at, *_columns(counts[:, at : at + TILE])) for at in range(0, counts.shape[1], TILE)]
    for i, (a, x, group_x, level_x) in enumerate(tiles):
        for b, y, group_y, level_y in tiles[i:]:
            yield x.T @ y, (a + group_x, level_x), (b + group_y, level_y)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[int]]]:
    """(language, counts, sizes) of blocks of terms of one language."""
    langs = batch.column("lang").to_pylist()
    counts, sizes = batch.column("counts"), batch.column("sizes")
    at = 0
    while at < len(langs):
        stop = at + 1
        while stop < len(langs) and stop < at + TERMS and langs[stop] == langs[at]:
            stop += 1
        yield langs[at], np.array(counts.slice(at, stop - at).to_pylist(), np.int64).reshape(stop - at, -1), sizes[at].as_py()
        at = stop


def _ordered(levels: DataFrame) -> DataFrame:
    """Terms of like frequency side by side, so that a block has few levels."""
    return levels.sortWithinPartitions("lang", "total").drop("total")


def joint_tables(levels: DataFrame) -> DataFrame:
    """(lang, a, b, level_a, level_b, n) for a < b: how many terms have these counts in the a-th and b-th source."""
    schema = "lang string, a int, b int, level_a long, level_b long, n long"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, counts, _ in _blocks(batch):
                for joint, (group_a, level_a), (group_b, level_b) in products(counts):
                    i, j = np.nonzero(joint * (group_a[:, None] < group_b))
                    columns = [group_a[i].astype(np.int32), group_b[j].astype(np.int32), level_a[i], level_b[j], joint[i, j].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), *map(pa.array, columns)], schema=fields)

    found = _ordered(levels).mapInArrow(run, schema)
    return found.groupBy("lang", "a", "b", "level_a", "level_b").agg(F.sum("n").alias("n"))


def distances(levels: DataFrame, v: DataFrame) -> DataFrame:
    """(lang, a, b, value) for a < b: the summed differences of shares, from the joint tables of all blocks. ``v`` has the
    number of kept terms by language."""
    schema = "lang string, a int, b int, value long"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            n_terms = dict(zip(batch.column("lang").to_pylist(), batch.column("v").to_pylist()))
            for lang, counts, sizes in _blocks(batch):
                into = total.setdefault(lang, np.zeros((len(sizes), len(sizes)), np.int64))
                under = [s + PRIOR * n_terms[lang] for s in sizes]
                price = lambda group, level: np.array([1 + SCALE * (c + PRIOR) // under[g] for g, c in zip(group.tolist(), level.tolist())], np.int64)
                for joint, (group_a, level_a), (group_b, level_b) in products(counts):
                    cost = np.abs(price(group_a, level_a)[:, None] - price(group_b, level_b)) * joint.astype(np.int64)
                    a, at = np.unique(group_a, return_index=True)
                    b, to = np.unique(group_b, return_index=True)
                    into[np.ix_(a, b)] += np.add.reduceat(np.add.reduceat(cost, at, axis=0), to, axis=1)
        for lang, values in total.items():
            a, b = np.triu_indices(len(values), 1)
            columns = [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(values[a, b])]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)
        hand_back()

    found = _ordered(levels.join(v, "lang")).mapInArrow(run, schema)
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = rows.withColumn("rank", F.row_number().over(order))
    found = found if most is None else found.where(F.col("rank") <= most)
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): in part 'pair' the other sources of the language by distance, in part 'term'
    the ``top`` terms that the source has more of than its language."""
    kept = written(kept_terms(partial_counts(docs, lang_col, source_col, text_col), least))
    groups = written(groups_of(docs, kept, lang_col, source_col))
    numbers = groups.groupBy("lang").agg(F.max("v").alias("v"), F.array_sort(F.collect_list("source")).alias("sources"))
    found = distances(level_rows(kept, groups), numbers.select("lang", "v"))
    # a language without kept terms has no blocks; all its distances are 0
    pairs = numbers.select("lang", "sources", F.posexplode("sources").alias("a", "source")).select(
        "lang", "a", "source", F.posexplode("sources").alias("b", "item")
    )
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    rows = pairs.where("a <> b").select("lang", "source", "item", low, high).join(found, ["lang", "a", "b"], "left")
    by_pair = _ranked(rows.select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")), "pair")
    terms = kept.select("lang", F.col("term").alias("item"), "total", F.inline("cells")).join(groups, ["lang", "source"])
    more = terms.withColumn("value", share("n", "size", "v") - share("total", "lang_size", "v")).where("value > 0")
    return by_pair.unionByName(_ranked(more, "term", top))
