"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items and texts are normalised alike: A-Z to a-z, words of letters, digits and non-ASCII bytes, one space between
words. Every run of 13 consecutive item words is a pattern of the automaton, and each text is scanned once. A match ends
at a known normalised offset, so word starts map it back to words, and ``hit_spans`` maps words back to offsets of the
original text.

The items are a query set. They are taken in blocks of a fixed number of bytes, with a broadcast for each, so that no
broadcast grows with the benchmark; one block holds any usual benchmark and then each text is scanned once. With more
blocks a text is scanned once per block, within one expression, and its findings are united. A worker keeps the automata
of the blocks used last, up to ``KEPT_BYTES`` of items: with more than that it builds each of them once for every Arrow
batch, so a benchmark of many blocks is better scanned with larger batches.

Defined results: null or empty texts have no words and are not contaminated; items without words are ignored; an item
without an id marks words but is not listed; repeated items count by their id; repeated documents get a row each; other columns are ignored; an empty table on either side
gives no hits. The hash of no items is the hash of the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

WINDOW = 13
#: Bytes of item text in one automaton; about a hundred times that in memory.
BLOCK_BYTES = 4_000_000
#: Bytes of item text whose automata a worker keeps.
KEPT_BYTES = 8_000_000

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def windows(words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield b" ".join(words[i : i + size])


def build(items: list[tuple], size: int = WINDOW):
    """Automaton over the windows of (id, text) pairs; each pattern carries its bytes, words and item ids."""
    import ahocorasick

    owners: dict[bytes, set] = {}
    for item, text in items:
        for window in windows(words_of(text), size):
            owners.setdefault(window, set()).add(item)
    automaton = ahocorasick.Automaton()
    for window, ids in owners.items():
        # one character for each byte; spaces at both ends keep matches on whole words
        automaton.add_word(f" {window.decode('latin-1')} ", (len(window) + 2, window.count(b" ") + 1, frozenset(ids)))
    if owners:
        automaton.make_automaton()
    return automaton


def scan(automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, the hit words as merged (first, end) runs, and the ids of items with matches."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    found = list(automaton.iter(line))
    if not found:
        return len(words), [], set()
    starts = np.cumsum([1, *(len(w) + 1 for w in words[:-1])])
    first = np.searchsorted(starts, [end - length + 2 for end, (length, _, _) in found])
    spans = sorted((int(a), int(a) + n) for a, (_, (_, n, _)) in zip(first, found))
    return len(words), merged(spans), set().union(*(ids for _, (_, _, ids) in found))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hit_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as (start, end) code points of the original text."""
    data = text.encode()
    marked = np.frombuffer(data.translate(_WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[edges[2 * a]]), int(chars[edges[2 * b - 1]])) for a, b in runs]


class _Items:
    """The items of one block; a worker builds their automaton when it has none."""

    def __init__(self, broadcast, size: int):
        self.broadcast, self.id, self.size = broadcast, broadcast._jbroadcast.id(), size

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id, "size": self.size}

    def automaton(self):
        found = _BUILT.pop(self.id, None)
        while found is None and _BUILT and sum(size for size, _ in _BUILT.values()) + self.size > KEPT_BYTES:
            del _BUILT[next(iter(_BUILT))]  # the one that was not used for longest
        _BUILT[self.id] = found = found or (self.size, build(self.broadcast.value))
        return found[1]


_BUILT: dict[int, tuple[int, object]] = {}


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple], int]]:
    """The query set, with its bytes, in blocks of at most ``block_bytes`` (an item above that stands alone), one at a time."""
    block, size = [], 0
    for row in items.where(F.col(text_col).isNotNull()).select(id_col, text_col).toLocalIterator():
        n = len(row[1].encode())
        if block and size + n > block_bytes:
            yield block, size
            block, size = [], 0
        block.append(tuple(row))
        size += n
    yield block, size


def matches(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows and columns with n_words, ``runs`` (hit words as runs), ``spans`` (the same as code points of the original
    text) and ``items`` (ids of items with occurring windows, as sorted strings); columns of these names are replaced."""
    sc = docs.sparkSession.sparkContext
    blocks = [_Items(sc.broadcast(block), size) for block, size in item_blocks(items, item_id, item_text, block_bytes)]
    schema = "n_words long, runs array<struct<first:long,end:long>>, spans array<struct<start:long,end:long>>, items array<string>"
    arrow = arrow_schema(schema)

    def find(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        found = [[0, [], set()] for _ in texts]
        for block in blocks:
            automaton = block.automaton()
            for each, text in zip(found, texts):
                each[0], runs, ids = scan(automaton, text)
                each[1] += runs
                each[2] |= ids
        rows = []
        for (n, runs, ids), text in zip(found, texts):
            runs = merged(sorted(runs)) if len(blocks) > 1 else runs
            spans = hit_spans(text, runs) if runs else []
            rows.append((n, [{"first": a, "end": b} for a, b in runs], [{"start": a, "end": b} for a, b in spans], sorted(str(i) for i in ids if i is not None)))
        columns = list(zip(*rows)) or [[]] * len(arrow)
        return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], fields=list(arrow))

    rows = docs.drop("n_words", "runs", "spans", "items").select(F.struct("*").alias("_row"), F.arrow_udf(find, schema)(text_col).alias("_found"))
    return rows.select("_row.*", "_found.*")


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and at least a twentieth of the words)."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["first"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )

