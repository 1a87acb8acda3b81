"""Removal of repeated byte strings with a sparse suffix array, built by a distributed merge sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a document before, or earlier in the
same one). Every string of that length holds one anchor, chosen by its own bytes alone: the leftmost of its 8-byte grams
with the smallest hash. Equal strings have the same anchor at the same place, so only the suffixes that start at anchors
are sorted, each with the bytes that its strings reach before and after the anchor; every byte string is still examined.

1. Runs: a task sorts the anchor suffixes of some megabytes of text, keeps one of equal ones (the others are repeats of
   it, known at once), front-codes them (length of the prefix shared with the suffix before, and the rest) and cuts the
   run at splitters taken from a bounded sample of documents.
2. Exchange: the pieces are shuffled by range. Anchors that share their gram meet, but for the grams that are frequent in
   the sample: their strings are parted into those that reach ``AHEAD`` bytes beyond the start of the anchor, dealt by
   these bytes, and the others, which have the remaining bytes before it, dealt by those. Equal strings still meet, and
   one gram is spread over all ranges.
3. Merge: a loser tree merges the pieces of a range. Each loser keeps the length of the prefix it shares with the suffix
   that beat it, a new suffix brings the one from its front code, and characters are compared only beyond these.
4. Suffixes whose neighbours share enough are candidates; their strings are looked up by hash and compared byte by byte,
   and all but the first of equal strings give an interval to remove. Intervals are joined to their documents.

A string shared by any number of documents costs one suffix for each run, not for each document.

Defined results: null text is empty; texts under ``LENGTH`` bytes lose nothing but may not repeat either; of rows with
equal ids the order is by a hash of the text, and of wholly equal rows one counts as first; null ids come first; other
columns are ignored; an empty table gives no rows; texts of any length are taken in segments.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, measured, struct_of, written

LENGTH = 100
GRAM = 8
GRAMS = LENGTH - GRAM + 1
#: Bytes of text whose suffixes are one run, and bytes that are scanned at a time.
RUN_BYTES = 12_000_000
#: Bytes of input whose suffixes meet in one range of the merge at most.
RANGE_BYTES = 16_000_000
SEGMENT = 250_000
#: Documents, and anchors of each, that the splitters are taken from at most.
SAMPLE_DOCS, SAMPLE_ANCHORS = 4000, 64
#: A gram with more than a quarter of a range's share of the sample, and this many anchors in it, is frequent.
FREQUENT = 16
#: Bytes from the anchor on that one part of a frequent gram's strings has in common with its equals.
AHEAD = LENGTH // 2 + GRAM // 2
#: Candidate suffixes whose strings are matched together; whole groups are kept together beyond it.
TOGETHER = 8_000
#: Pairs of strings that are compared at a time.
COMPARED = 50_000

_U = np.uint64
_rng = np.random.default_rng(100)
_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = _U(int(_rng.integers(2**40, 2**62)) | 1)
_POWER = _U(pow(int(_BASE), LENGTH, 1 << 64))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last, gram): the strings that start at first..last have that anchor; gram is its first 8 bytes as
    a number in byte order."""
    parts = [_anchors(data, at, min(len(data), at + SEGMENT + LENGTH - 1)) for at in range(0, max(1, len(data) - LENGTH + 1), SEGMENT)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(data: bytes, start: int, stop: int) -> tuple[np.ndarray, ...]:
    n = stop - start - LENGTH + 1  # strings
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    b = np.frombuffer(data, np.uint8, stop - start, start).astype(np.uint64)
    m = len(b) - GRAM + 1
    gram = b[:m].copy()
    for k in range(1, GRAM):
        gram <<= _U(8)
        gram |= b[k : m + k]
    order = (gram ^ _U(0x5851F42D4C957F2D)) * _U(0x9E3779B97F4A7C15)
    order ^= order >> _U(32)
    order *= _U(0xD6E8FEB86659FD93)
    order = (order >> _U(24) << _U(24)) | np.arange(m, dtype=np.uint64)  # of equal hashes the leftmost
    # smallest of GRAMS neighbours: the smallest up to the end of a block and from the start of the next one
    padded = np.full(-(-m // GRAMS) * GRAMS, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = order
    blocks = padded.reshape(-1, GRAMS)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[GRAMS - 1 : GRAMS - 1 + n]) & _U((1 << 24) - 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return at[first] + start, first + start, last + start, gram[at[first]]


def shared_prefix(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    n = min(len(x), len(y))
    if x[known:n] == y[known:n]:
        return n
    at = known
    while x[at] == y[at]:
        if at - known == 8:  # long: by one subtraction of numbers
            a, b = int.from_bytes(x[at:n], "big"), int.from_bytes(y[at:n], "big")
            return n - ((a ^ b).bit_length() + 7) // 8
        at += 1
    return at


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, tuple]]:
    """Merges sorted runs of (suffix, prefix shared with the one before in its run, ...) with a loser tree; gives the
    prefix shared with the suffix given out before, and the entry.

    ``shares[r]`` is how much the head of run r shares with the last winner of the match it is in. Of two heads that share
    different lengths with the same smaller suffix the one that shares more is smaller, without any comparison.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    keys = [h[0] if h else None for h in heads]
    shares = [0 if h else -1 for h in heads]
    losers = [0] * size

    def match(x: int, y: int) -> tuple[int, int]:
        """(winner, loser) of two heads that share equally much with what came before."""
        if keys[x] is None:
            return y, x
        if keys[y] is None:
            return x, y
        a, b = keys[x], keys[y]
        at = shared_prefix(a, b, shares[x])
        if a[at : at + 1] <= b[at : at + 1]:
            shares[y] = at
            return x, y
        shares[x] = at
        return y, x

    def build(node: int) -> int:
        if node >= size:
            return node - size
        x, y = build(2 * node), build(2 * node + 1)
        if shares[x] < 0 or shares[y] < 0:
            winner, loser = (x, y) if shares[x] >= 0 else (y, x)
        else:
            shares[x] = shares[y] = 0
            winner, loser = match(x, y)
        losers[node] = loser
        return winner

    winner = build(1) if size > 1 else 0
    if size > 1:
        shares[winner] = 0
    while keys[winner] is not None:
        yield shares[winner], heads[winner]
        head = next(runs[winner], None)
        heads[winner] = head
        keys[winner], shares[winner] = (head[0], head[1]) if head else (None, -1)
        node = (winner + size) >> 1
        while node:
            other = losers[node]
            mine, its = shares[winner], shares[other]
            if its > mine:
                losers[node], winner = winner, other
            elif its == mine and mine >= 0:
                winner, losers[node] = match(winner, other)
            node >>= 1


def _pack(suffixes: list[bytes], before: list[bytes], strings: np.ndarray, docs: np.ndarray, places: np.ndarray) -> bytes:
    """A front-coded piece of a run, sorted by suffix."""
    import zstandard

    shares = [0, *(shared_prefix(a, b, 0) for a, b in zip(suffixes, suffixes[1:]))]
    columns = [
        np.array([len(suffixes)], np.int64).tobytes(),
        np.array(shares, np.uint8).tobytes(),
        np.array([len(s) for s in suffixes], np.uint8).tobytes(),
        np.array([len(b) for b in before], np.uint8).tobytes(),
        strings.astype(np.uint8).tobytes(),
        docs.astype(np.int64).tobytes(),
        places.astype(np.int64).tobytes(),
        b"".join([s[k:] for s, k in zip(suffixes, shares)]),
        b"".join(before),
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(columns))


def _unpack(blob: bytes) -> Iterator[tuple]:
    """(suffix, shared, before, strings, document, anchor), one at a time."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at = 8
    shares, lengths, before, strings = (data[at + k * n : at + (k + 1) * n] for k in range(4))
    at += 4 * n
    docs = np.frombuffer(data, np.int64, n, at).tolist() if n else []
    places = np.frombuffer(data, np.int64, n, at + 8 * n).tolist() if n else []
    at += 16 * n
    back = at + sum(lengths) - sum(shares)
    suffix = b""
    for k in range(n):
        end = at + lengths[k] - shares[k]
        suffix = suffix[: shares[k]] + data[at:end]
        at = end
        yield suffix, shares[k], data[back : back + before[k]], strings[k], docs[k], places[k]
        back += before[k]


def _run(rows: list[tuple[int, bytes]], splitters: np.ndarray, hot: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """Pieces (range, blob) of one run; range -1 has intervals that need no merge.

    What an anchor's strings are is looked up by a hash of their bytes, and the bytes are compared before they count as
    known. An entry is five numbers; suffixes become bytes of their own only while they are sorted and packed.
    """
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    known: dict[int, int] = {}
    gone: list[tuple[int, int, int]] = []
    owner, place, starts, ends, grams = array("q"), array("q"), array("q"), array("q"), array("Q")
    docs = np.array([d for d, _ in rows], np.int64)
    for k in np.argsort(docs, kind="stable").tolist():  # an earlier document keeps its strings
        doc, data = rows[k]
        for a, first, last, gram in zip(*(x.tolist() for x in anchors(data))):
            text = data[first : last + LENGTH]
            at = known.setdefault(digest(text, a - first), len(owner))
            if at < len(owner) and a - first == place[at] - starts[at] and text == rows[owner[at]][1][starts[at] : ends[at]]:
                if gone and gone[-1][0] == doc and gone[-1][2] >= first:
                    gone[-1] = (doc, gone[-1][1], last + LENGTH)
                else:
                    gone.append((doc, first, last + LENGTH))
                continue
            owner.append(k)
            place.append(a)
            starts.append(first)
            ends.append(last + LENGTH)
            grams.append(gram)
    known.clear()
    if gone:
        yield -1, np.array(gone, np.int64).tobytes()
    if not owner:
        return
    owner, place, starts, ends = (np.frombuffer(x, np.int64) for x in (owner, place, starts, ends))
    grams = np.frombuffer(grams, np.uint64)
    often = np.isin(grams, hot)
    usual = np.flatnonzero(~often)
    into = np.searchsorted(splitters, grams[usual], side="right")
    yield from _pieces(rows, docs, owner[usual], place[usual], starts[usual], ends[usual], into, False)
    if often.any():
        owner, place, starts, ends = (x[often] for x in (owner, place, starts, ends))
        border = place - LENGTH + AHEAD  # the first string that reaches AHEAD bytes beyond the anchor's start
        for ahead in (True, False):
            first, end = (np.maximum(starts, border), ends) if ahead else (starts, np.minimum(ends, border - 1 + LENGTH))
            some = np.flatnonzero(end - first >= LENGTH)
            texts = zip(owner[some].tolist(), place[some].tolist())
            cut = lambda k, a: rows[k][1][a : a + AHEAD] if ahead else rows[k][1][a - LENGTH + AHEAD - 1 : a]
            into = np.array([ranges + digest(cut(k, a), int(ahead)) % ranges for k, a in texts], np.int64)
            yield from _pieces(rows, docs, owner[some], place[some], first[some], end[some], into, True)


def _pieces(rows, docs, owner, place, starts, ends, into, dealt: bool) -> Iterator[tuple[int, bytes]]:
    """Entries as sorted, packed pieces of their ranges. Ranges follow the order of suffixes unless they are dealt by hash."""
    suffixes = [rows[k][1][a:end] for k, a, end in zip(owner.tolist(), place.tolist(), ends.tolist())]
    numbers = into.tolist()
    key = (lambda i: (numbers[i], suffixes[i])) if dealt else suffixes.__getitem__
    order = np.array(sorted(range(len(suffixes)), key=key), np.int64)
    into = into[order]
    cuts = np.flatnonzero(np.diff(into)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        mine = order[start:stop]
        if not len(mine):
            continue
        before = [rows[k][1][first:a] for k, first, a in zip(owner[mine].tolist(), starts[mine].tolist(), place[mine].tolist())]
        strings = ends[mine] - LENGTH - starts[mine] + 1
        yield int(into[start]), _pack([suffixes[i] for i in mine.tolist()], before, strings, docs[owner[mine]], place[mine])


def runs(docs: DataFrame, splitters: np.ndarray, hot: np.ndarray, ranges: int) -> DataFrame:
    """(range, blob) of all runs of (doc, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            made = list(_run(rows, splitters, hot, ranges))
            return pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], names=["range", "blob"]
            )

        rows, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and len(data := text.encode()) >= LENGTH:
                    rows.append((doc, data))
                    size += len(data)
                    if size >= RUN_BYTES:
                        yield out(rows)
                        rows, size = [], 0
        if rows:
            yield out(rows)
        rows = []
        hand_back()

    return docs.select("doc", "text").mapInArrow(make, "range int, blob binary")


def split_points(docs: DataFrame, n: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """From a bounded sample of the n documents: grams that cut the anchors into equal ranges, and the frequent ones."""
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [anchors((t or "").encode())[3] for t in batch.column(0).to_pylist()]
            grams = [g[:: max(1, len(g) // SAMPLE_ANCHORS)] for g in grams]
            flat = np.concatenate([np.empty(0, np.uint64), *grams]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["gram"])

    sample = docs.select("text").sample(min(1.0, SAMPLE_DOCS / n), 8).mapInArrow(some, "gram long")
    grams = np.sort(np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64))
    if not len(grams):
        return grams, grams
    each, count = np.unique(grams, return_counts=True)
    hot = each[count > max(FREQUENT, len(grams) / (4 * ranges))]  # at most four for each range
    return np.unique(grams[np.linspace(0, len(grams) - 1, ranges + 1).astype(int)[1:-1]]), hot


def repeats(group: list[tuple]) -> tuple[np.ndarray, ...]:
    """(doc, start, end) of the strings that came before in a batch of whole gram groups.

    The strings of all candidates are found by running hashes over their bytes, and their bytes are compared before any
    is called a repeat. Candidates stand in document order, so the first of equal strings is the one that stays.
    """
    group.sort(key=lambda e: (e[4], e[5]))
    n, width = len(group), 2 * LENGTH
    text = np.zeros((n, width), np.uint8)
    for k, (suffix, _, before, _, _, _) in enumerate(group):
        text[k, LENGTH - len(before) : LENGTH + len(suffix)] = np.frombuffer(before + suffix, np.uint8)
    running = np.zeros((n, width + 1), np.uint64)
    for j in range(width):
        running[:, j + 1] = running[:, j] * _BASE + _VALUES[text[:, j]]
    back = np.array([len(e[2]) for e in group])
    count = np.array([e[3] for e in group])
    column = np.arange(width - LENGTH + 1)
    valid = (column >= (LENGTH - back)[:, None]) & (column < (LENGTH - back + count)[:, None])
    hashed = (running[:, LENGTH:] - running[:, :-LENGTH] * _POWER)[valid]  # of the string that starts at each column
    del running
    _, where, inverse = np.unique(hashed, return_index=True, return_inverse=True)
    again = np.flatnonzero(where[inverse] != np.arange(len(inverse)))
    row, start = np.nonzero(valid)
    strings = np.lib.stride_tricks.sliding_window_view(text, LENGTH, axis=1)
    first = where[inverse[again]]
    del hashed, where, inverse
    same = np.ones(len(again), bool)
    for at in range(0, len(again), COMPARED):
        x, y = again[at : at + COMPARED], first[at : at + COMPARED]
        same[at : at + COMPARED] = (strings[row[x], start[x]] == strings[row[y], start[y]]).all(axis=1)
    if not same.all():  # different strings of one hash: tell all of this batch apart by their bytes
        seen: dict[bytes, int] = {}
        again = np.array([k for k in range(len(row)) if seen.setdefault(strings[row[k], start[k]].tobytes(), k) != k], np.int64)
    gone = np.zeros(valid.shape, bool)
    gone[row[again], start[again]] = True
    edges = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    _, stop = np.nonzero(edges == -1)
    doc, place = (np.array([e[i] for e in group], np.int64) for i in (4, 5))
    return doc[row], place[row] - LENGTH + start, place[row] - LENGTH + stop - 1 + LENGTH


def _merged(pieces: pa.Table) -> pa.Table:
    """Intervals to remove, from the pieces of one range."""
    names = ["doc", "start", "end"]
    if pieces["range"][0].as_py() < 0:
        gone = np.concatenate([np.frombuffer(b.as_py(), np.int64).reshape(-1, 3) for b in pieces["blob"]])
        return pa.Table.from_arrays([pa.array(gone[:, k]) for k in range(3)], names=names)
    found, batch, group = [], [], []
    shared_before = 0  # of the last entry of the group with the one before it
    need = lambda e: LENGTH - len(e[2])  # noqa: E731  bytes that a partner shares beyond the anchor at least
    last = None

    def close():
        nonlocal batch
        if len(group) > 1:
            batch += group
        group.clear()
        if len(batch) >= TOGETHER:
            found.append(repeats(batch))
            batch = []

    for shared, entry in merge([_unpack(b.as_py()) for b in pieces["blob"]]):
        if last is not None and max(shared_before, shared) >= need(last):
            group.append(last)
        if shared < GRAM:
            close()
        last, shared_before = entry, shared
    if last is not None and shared_before >= need(last):
        group.append(last)
    close()
    if batch:
        found.append(repeats(batch))
    out = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3
    hand_back()
    return pa.Table.from_arrays([pa.array(x) for x in out], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """All rows and columns with ``kept`` (binary: the remaining bytes; as text without the pieces of characters that were
    cut), ``spans`` (removed runs of bytes as start and end) and n_bytes; columns of these names are replaced."""
    docs = docs.drop("kept", "spans", "n_bytes")
    rows = docs.select(F.col(id_col).alias("_id"), F.struct("*").alias("_row"))
    text = F.col("_row")[text_col]
    kind = docs.schema[id_col].dataType.simpleString()
    odd = docs.groupBy(id_col).agg(F.count("*").alias("_n")).where(F.col(id_col).isNull() | (F.col("_n") > 1))
    if kind in ("bigint", "int") and odd.isEmpty():
        rows = rows.select(F.col("_id").cast("long").alias("doc"), "_row")
    else:  # a number for each row that keeps the order of the documents
        key = ["_id", F.xxhash64(text)]
        rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
        rows = written(rows.select(F.monotonically_increasing_id().alias("doc"), "_row"))
    texts = rows.select("doc", text.alias("text"))
    n, size = measured(texts)
    ranges = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    pieces = runs(texts, *split_points(texts, n, ranges), ranges)
    dealt = F.when(F.col("range") < 0, F.pmod(F.xxhash64("blob"), F.lit(ranges)))
    gone = pieces.groupBy("range", dealt).applyInArrow(_merged, "doc long, start long, end long")
    spans = gone.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = rows.join(spans, "doc", "left")

    def cut(text, starts, ends):
        data, gone = (text or "").encode(), []
        for a, b in sorted(zip(starts or [], ends or [])):
            if gone and a <= gone[-1]["end"]:
                gone[-1]["end"] = max(gone[-1]["end"], b)
            else:
                gone.append({"start": a, "end": b})
        edges = [0, *(e for g in gone for e in (g["start"], g["end"])), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
        return kept.decode("utf-8", "ignore") if as_text else kept, gone, len(data)

    schema = ("kept string," if as_text else "kept binary,") + " spans array<struct<start:long,end:long>>, n_bytes long"
    made = struct_of(cut, schema)(text, F.col("starts"), F.col("ends"))
    return joined.select("_row", made.alias("_made")).select("_row.*", "_made.*")


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256."""
    return removed.select(
        id_col,
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
