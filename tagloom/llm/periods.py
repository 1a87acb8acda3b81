"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are equal) of at least 3 q and ``SHORTEST`` words that no
neighbouring word extends. The texts of a batch become one array of numbers, with numbers of its own for each text, so
that nothing is found across texts.

1. Suffix array by doubling: after the round for m words all suffixes are sorted by their first m words, and those whose
   first m words are unique take no part in later rounds. The suffixes that begin with a dyadic block of m words (at a
   multiple of m) are an interval of the array, which is noted in that round.
2. A wavelet matrix over the suffixes that share at least ``FIRST`` words with another one answers, for a block and a
   neighbouring window of starts, how many occurrences there are, and which is the k-th (range successor). A run of period
   q holds a block of the largest dyadic length up to q, and that block again q words later.
3. Occurrences of a block in a window no longer than twice the block form one arithmetic progression. One or two of them
   are candidates themselves. Three or more say that the block has the period d of the progression; then the run is longer
   than the stretch of period d around the block, and q is the distance of the ends (or of the starts) of that stretch and
   the one around the progression.
4. A candidate period is extended to both sides; what is long enough is a run.

Defined results: null and empty texts have no words and no runs; repeated rows and null ids are kept row for row; other
columns are ignored; an empty table gives no rows; a text of any length is taken whole, its task holds some 60 bytes for
each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ROWS, arrow_schema, hand_back

#: Words and periods that a run has at least; the first dyadic block is as long as every run of a shorter period can hold.
SHORTEST, PERIODS = 24, 3
FIRST = 8
#: Words whose suffixes are sorted together; a longer text stands alone.
BATCH_WORDS = 200_000

_U = np.uint64


class WaveletMatrix:
    """Counts and k-th values of ranges of an array of numbers below 2 to the power ``bits``; all queries take arrays."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        values = values.astype(np.int64)
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            packed = np.zeros(len(values) // 64 + 1, _U)
            packed.view(np.uint8)[: -(-len(values) // 8)] = np.packbits(ones, bitorder="little")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed)[:-1], dtype=np.int64)))
            values = np.concatenate((values[~ones], values[ones]))
            self.levels.append((bit, packed, before, len(values) - int(ones.sum())))

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before a place."""
        word = at >> 6
        below = (_U(1) << (at & 63).astype(_U)) - _U(1)
        return before[word] + np.bitwise_count(packed[word] & below)

    def less(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of lo..hi are below the bound."""
        beyond, size, found = bound >> len(self.levels) > 0, hi - lo, np.zeros(len(lo), np.int64)
        for bit, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, lo), self._ones(packed, before, hi)
            one = (bound >> bit & 1).astype(bool)
            found += np.where(one, hi - lo - (b - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return np.where(beyond, size, found)

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of lo..hi."""
        found = np.zeros(len(lo), np.int64)
        for bit, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, lo), self._ones(packed, before, hi)
            n = hi - lo - (b - a)
            one = k >= n
            k = np.where(one, k - n, k)
            found |= one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return found


def dyadic_blocks(codes: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple]]:
    """(suffixes, blocks): the suffixes that share ``FIRST`` words with another one, in order, and for each dyadic length
    (length, places, lo, hi) of the blocks that occur again; lo..hi is the interval of ``suffixes`` that begin with one."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.concatenate(([True], codes[order][1:] != codes[order][:-1]))
    rank, places, found, kept, m = np.empty(n, np.int64), np.arange(n), [], None, 1
    while True:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(places)))
        rank[order[places]] = np.repeat(places[starts], sizes)
        again = np.repeat(sizes > 1, sizes)
        size, places = np.repeat(sizes, sizes)[again], places[again]
        at = order[places]
        if m >= FIRST:
            kept = places if kept is None else kept
            aligned = at % m == 0
            lo = np.searchsorted(kept, rank[at[aligned]])
            found.append((m, at[aligned], lo, lo + size[aligned]))
        if not len(places) or PERIODS * 2 * m > max(longest, SHORTEST):
            break
        after = at + m
        inside = after < ends[at]
        key = rank[at] * (n + 1)
        key[inside] += rank[after[inside]] + 1
        sort = np.argsort(key, kind="stable")
        order[places], key = at[sort], key[sort]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        m *= 2
    return (order[kept] if kept is not None else np.empty(0, np.int64)), found


class _Stretches:
    """Maximal stretches of a given period around places, remembered by period."""

    def __init__(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        self.codes, self.begins, self.ends, self.known = codes, begins, ends, {}

    def around(self, place: int, period: int) -> tuple[int, int]:
        """The stretch that holds ``place`` and ``place + period``: all words ``period`` apart within it are equal."""
        last = self.known.get(period)
        if last and last[0] <= place and place + period < last[1]:
            return last
        end, begin = int(self.ends[place]), int(self.begins[place])
        x, y = self.codes[place : end - period], self.codes[place + period : end]
        ahead = _equal(x, y)
        x, y = self.codes[begin:place][::-1], self.codes[begin + period : place + period][::-1]
        found = place - _equal(x, y), place + period + ahead
        self.known[period] = found
        return found


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two arrays share from their start, looked at in pieces that grow."""
    at, step = 0, 64
    while at < len(x):
        differ = x[at : at + step] != y[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return len(x)


def _candidates(suffixes: np.ndarray, blocks: list[tuple], stretches: _Stretches) -> np.ndarray:
    """(period, place) of stretches to look at, sorted, each once."""
    pairs = [np.empty((0, 2), np.int64)]
    matrix = WaveletMatrix(suffixes, max(1, len(stretches.codes)).bit_length())
    for m, place, lo, hi in blocks:
        windows = [(1, m + 1), (m + 1, 2 * m)] if m == FIRST else [(m, 2 * m)]
        for start, stop in windows:
            before = matrix.less(lo, hi, place + start)
            n = matrix.less(lo, hi, place + stop) - before
            some = n > 0
            if not some.any():
                continue
            s, a, b, c, n = place[some], lo[some], hi[some], before[some], n[some]
            first = matrix.kth(a, b, c)
            second = np.where(n > 1, matrix.kth(a, b, np.minimum(c + 1, c + n - 1)), first)
            pairs += [np.stack((x - s, s), 1) for x in (first, second)]
            for s_, x, y in zip(*(v[n > 2].tolist() for v in (s, first, second))):
                d = y - x
                own, its = stretches.around(s_, d), stretches.around(x, d)
                if own != its:
                    pairs.append(np.array([(e - o, s_) for o, e in zip(own, its) if start <= e - o < stop], np.int64).reshape(-1, 2))
    return np.unique(np.concatenate(pairs), axis=0)


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    long = [k for k, words in enumerate(texts) if len(words) >= SHORTEST]
    if not long:
        return found
    sizes = np.array([len(texts[k]) for k in long], np.int64)
    number = dict.fromkeys(w for k in long for w in texts[k])
    number = dict(zip(number, range(len(number))))
    codes = np.fromiter((number[w] for k in long for w in texts[k]), np.int64, int(sizes.sum()))
    limits = np.concatenate(([0], np.cumsum(sizes)))
    codes += np.repeat(np.arange(len(long)), sizes) * len(number)
    begins, ends = np.repeat(limits[:-1], sizes), np.repeat(limits[1:], sizes)
    suffixes, blocks = dyadic_blocks(codes, ends, int(sizes.max()))
    stretches = _Stretches(codes, begins, ends)
    known: dict[tuple[int, int], int] = {}
    for period, place in _candidates(suffixes, blocks, stretches).tolist():
        if place + period < ends[place]:
            start, end = stretches.around(place, period)
            if end - start >= max(SHORTEST, PERIODS * period):
                known.setdefault((start, end), period)  # periods ascend, so the smallest is kept
    owner = np.searchsorted(limits, [s for s, _ in known], side="right") - 1
    for of, ((start, end), period) in zip(owner.tolist(), known.items()):
        found[long[of]].append((start - int(limits[of]), end - start, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    dropped = bytearray(len(words))
    for start, length, period in runs:
        dropped[start + period : start + length] = b"\1" * (length - period)
    return [w for w, gone in zip(words, dropped) if not gone] if runs else words


def words_of(name: int | None, text: str | None) -> list[bytes]:
    """Words between ASCII white space; bytes split at exactly these six characters."""
    return (text or "").encode().split()


RUNS = "runs array<struct<start:long,length:long,period:long>>"


def periodic(
    docs: DataFrame,
    make: Callable[[list[bytes], list[tuple[int, int, int]]], tuple],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: Callable[[int | None, str | None], list[bytes]] = words_of,
) -> DataFrame:
    """id and, in the columns of ``schema``, what ``make`` gives for the words and the runs of each text. ``words`` takes
    the id and the text. One map: no shuffle, and memory follows a batch of texts."""
    of_id = docs.select(id_col).schema[0].dataType.simpleString()
    fields = arrow_schema(f"`{id_col}` {of_id}, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            rows = [(name, *make(w, runs)) for name, w, runs in zip(names, texts, find_runs(texts))]
            return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), fields)], schema=fields)

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                for name, text in zip(*(c.slice(at, ROWS).to_pylist() for c in whole.columns)):
                    own = words(name, text)
                    if texts and size + len(own) > BATCH_WORDS:
                        yield out()
                        names, texts, size = [], [], 0
                    names.append(name)
                    texts.append(own)
                    size += len(own)
        if texts:
            yield out()
        names, texts = [], []
        hand_back()

    return docs.select(id_col, text_col).mapInArrow(run, fields_text(id_col, of_id, schema))


def fields_text(id_col: str, kind: str, schema: str) -> str:
    return f"`{id_col}` {kind}, {schema}"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``runs`` of each text, and ``collapsed``: its words without the repetitions, between single spaces."""

    def make(words, found):
        listed = [{"start": a, "length": n, "period": q} for a, n, q in found]
        return listed, b" ".join(collapsed(words, found)).decode()

    return periodic(docs, make, f"{RUNS}, collapsed string", id_col, text_col)


DIGESTS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """Number of runs, the run with the greatest exponent, and digests of all runs and of the words that stay."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2] or (r[1] * best[2] == best[1] * r[2] and (r[0], r[2]) < (best[0], best[2])):
            best = r
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in found).encode()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *shown, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()
