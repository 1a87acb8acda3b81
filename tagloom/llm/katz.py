"""Language-model scores by Katz backoff: Good-Turing discounted n-gram counts and exactly normalised backoff weights.

The model has bigrams over unigrams over one unknown word. Texts are kept as blocks, each with its own numbering of its
words. Every block asks the n-gram tables once for each of its distinct n-grams, not once for each token:

1. ``unigrams``: the tables are partitioned by word. A part adds up the blocks' counts, numbers its words and answers
   each block with counts and numbers, in the order in which the block asked.
2. ``bigrams``: partitioned by first word, and those of a frequent first word by both words, so that no word, however
   frequent, has more than a part's share. A part answers with bigram counts and with what the backoff weight of each
   first word needs: how many of its bigrams occur 1 to K times, the sum of the larger counts, and the unigram mass of
   all words seen after it.
3. Evaluation goes through each block's tokens: the discounted bigram probability where the bigram was seen, else the
   backoff weight of the word before times the unigram probability, which itself backs off to the unknown word.

Words are known by 64-bit hashes. The words before a text and after it are one end mark, which counts as a token once.

Defined results: null and empty texts are one end mark; a null id trains like the id "" (remainder 0); repeated rows are
documents of their own; other columns are ignored; an empty table gives no rows; without training documents all words
are unknown, and an unknown word then has probability 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, hand_back, measured, written

#: Counts up to this are discounted.
K = 5
#: Tokens in a block, and bytes of input for each part of the tables at most.
BLOCK_TOKENS = 3_000_000
PART_BYTES = 16_000_000
#: A first word with more than this share of a part's tokens is dealt over all parts.
FREQUENT = 4
MODULUS, HELD_OUT = 7, 2

_END = b""
_STATS = K + 2  # bigrams of count 1..K, sum of the larger counts, unigram mass of the words seen


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS == HELD_OUT


def pack(values: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    import zstandard

    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def discounts(n: list[int]) -> np.ndarray:
    """Katz discount ratios d[1..K] from the numbers n[r] of n-grams that occur r times (r up to K + 1).

    Where the Good-Turing estimates give no ratio between 0 and 1 (as on few data), half a count is taken off instead.
    """
    d = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        ratio = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = ratio if 0 < ratio < 1 else (r - 0.5) / r
    return d


class Unigrams:
    """Probabilities of words from their counts; the mass taken off goes to the unknown word."""

    def __init__(self, total: int, n: list[int]):
        self.total, self.d = total, discounts(n)
        kept = sum(n[r] * r * (self.d[r] - 1) for r in range(1, K + 1)) / total if total else -1.0
        self.unknown = -kept
        if total and self.unknown <= 0:  # no rare words at all: one count more than seen, for the unknown word
            self.unknown = 1 / (total + 1)
            self.d = self.d * total / (total + 1)
        self.most = total / (total + 1) if total and kept >= 0 else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        ratio = np.where(counts <= K, self.d[np.minimum(counts, K)], self.most)
        return np.where(counts > 0, ratio * counts / max(1, self.total), self.unknown)


def encode(docs: DataFrame, parts: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks (kind 0) and what they ask the unigram tables (kind 1)."""
    import xxhash

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"kind int, part int, block long, ids array<{kind}>, a binary, b binary, c binary"
    arrow = arrow_schema(schema)

    def rows(block: int, ids: list, sizes: list, tokens: list, words: dict[bytes, int]):
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        part = (hashes % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((hashes, part))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        own = place[np.concatenate(tokens)]
        sizes = np.array(sizes, np.int32)
        held = np.array([held_out(i) for i in ids])
        train = np.repeat(~held, sizes)
        counts = np.bincount(own[train], minlength=len(order))
        hashes, part = hashes[order], part[order]
        yield 0, 0, block, ids, pack(sizes), pack(own), pack(held.view(np.uint8))
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p in range(parts):
            if cuts[p] < cuts[p + 1]:
                mine = slice(cuts[p], cuts[p + 1])
                yield 1, p, block, None, pack(hashes[mine]), pack(counts[mine]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, sizes, tokens, n, words = [], [], [], 0, {_END: 0}

        def out():
            made = list(zip(*rows(block, ids, sizes, tokens, words)))
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, arrow)], schema=arrow)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                split = (text or "").encode().lower().split()
                split.append(_END)
                for w in set(split):
                    words.setdefault(w, len(words))
                ids.append(doc)
                sizes.append(len(split))
                tokens.append(np.fromiter(map(words.__getitem__, split), np.int32, len(split)))
                n += len(split)
                if n >= BLOCK_TOKENS:
                    yield out()
                    block += 1
                    ids, sizes, tokens, n, words = [], [], [], 0, {_END: 0}
        if ids:
            yield out()
        hand_back()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


_ANSWER = "block long, part int, a binary, b binary, n array<long>, word long, stats array<double>"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def unigrams(asked: DataFrame, parts: int) -> DataFrame:
    """Answers for each block and part: counts (a) and numbers (b) of its words; block -1 has sums over a part: tokens,
    words, and words that occur 1 to K + 1 times."""
    arrow = arrow_schema(_ANSWER)

    def add_up(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        hashes = [unpack(a.as_py(), np.uint64) for a in rows["a"]]
        known, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([unpack(b.as_py(), np.int64) for b in rows["b"]]), len(known)).astype(np.int64)
        number = np.empty(len(known), np.int64)
        number[np.argsort(-counts, kind="stable")] = np.arange(len(known))
        number = number * parts + part
        out, at = [], 0
        for block, h in zip(rows["block"].to_pylist(), hashes):
            mine = inverse[at : at + len(h)]
            at += len(h)
            out.append((block, part, pack(counts[mine]), pack(number[mine]), None, None, None))
        rare = [int((counts == r).sum()) for r in range(1, K + 2)]
        out.append((-1, part, None, None, [int(counts.sum()), int((counts > 0).sum()), *rare], None, None))
        return _table(out, arrow)

    return asked.groupBy("part").applyInArrow(add_up, _ANSWER)


class Block:
    """A block's tokens with what the unigram tables answered: counts and numbers of its words in their order."""

    def __init__(self, row: pa.Table, answers: pa.Table):
        self.id = row["block"][0].as_py()
        self.sizes, self.tokens = unpack(row["a"][0].as_py(), np.int32), unpack(row["b"][0].as_py(), np.int32)
        self.held = unpack(row["c"][0].as_py(), np.uint8) > 0
        answers = answers.sort_by("part")
        self.counts = np.concatenate([unpack(a.as_py(), np.int64) for a in answers["a"]])
        self.numbers = np.concatenate([unpack(b.as_py(), np.int64) for b in answers["b"]])
        # the end mark is the last token of every text, and stands before its first one
        before = np.concatenate((self.tokens[-1:], self.tokens[:-1])).astype(np.int64)
        self.pairs, self.inverse = np.unique(before << 32 | self.tokens, return_inverse=True)
        self.first, self.second = self.pairs >> 32, self.pairs & 0xFFFFFFFF

    def parts(self, parts: int, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Part of each distinct pair, and whether its first word is frequent."""
        frequent = self.counts[self.first] * FREQUENT * parts >= max(1, total)
        x, y = self.numbers[self.first].astype(np.uint64), self.numbers[self.second].astype(np.uint64)
        mix = np.uint64(0x9E3779B97F4A7C15)
        mixed = (x + np.uint64(1)) * mix
        mixed = np.where(frequent, (mixed ^ (mixed >> np.uint64(31)) ^ y) * mix, mixed)
        return ((mixed ^ (mixed >> np.uint64(33))) % np.uint64(parts)).astype(np.int64), frequent

    def in_parts(self, parts: int, total: int) -> Iterator[tuple[int, np.ndarray]]:
        """(part, places of its pairs, ordered by the numbers of their words); the same on every call."""
        part, _ = self.parts(parts, total)
        order = np.lexsort((self.numbers[self.second], self.numbers[self.first], part))
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            if cuts[p] < cuts[p + 1]:
                yield p, order[cuts[p] : cuts[p + 1]]


def ask_bigrams(blocks: DataFrame, answered: DataFrame, parts: int, total: int) -> DataFrame:
    """(part, block, a: first words, how many pairs each and whether it is frequent, b: second words, their counts and the
    block's training counts of the pairs)."""

    schema = "part int, block long, a array<binary>, b array<binary>"
    arrow = arrow_schema(schema)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        block, out = Block(left, right), []
        train = np.repeat(~block.held, block.sizes)
        counts = np.bincount(block.inverse[train], minlength=len(block.pairs))
        _, frequent = block.parts(parts, total)
        for p, at in block.in_parts(parts, total):
            first = block.numbers[block.first[at]]
            start = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            runs = np.diff(np.append(start, len(first)))
            a = (first[start], runs.astype(np.int32), frequent[at][start].astype(np.uint8))
            b = (block.numbers[block.second[at]], block.counts[block.second[at]], counts[at].astype(np.int32))
            out.append((p, block.id, [pack(x) for x in a], [pack(x) for x in b]))
        return _table(out, arrow)

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(ask, schema)


def bigrams(asked: DataFrame, base: Unigrams) -> DataFrame:
    """Answers for each block and part: training counts of its pairs (a) and the backoff figures of its first words (b);
    block -1: pairs that occur 1 to K + 1 times; block -2: a part's share in the figures of a frequent word."""
    arrow = arrow_schema(_ANSWER)

    def add_up(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        heads = [[unpack(x, t) for x, t in zip(a.as_py(), (np.int64, np.int32, np.uint8))] for a in rows["a"]]
        tails = [[unpack(x, t) for x, t in zip(b.as_py(), (np.int64, np.int64, np.int32))] for b in rows["b"]]
        words, word_of = np.unique(np.concatenate([h[0] for h in heads]), return_inverse=True)
        frequent = np.zeros(len(words), bool)
        frequent[word_of] = np.concatenate([h[2] for h in heads]) > 0
        first = np.repeat(word_of, np.concatenate([h[1] for h in heads]))
        nexts, second = np.unique(np.concatenate([t[0] for t in tails]), return_inverse=True)
        mass = np.zeros(len(nexts))
        mass[second] = base.probability(np.concatenate([t[1] for t in tails]))
        pairs, inverse = np.unique(first.astype(np.int64) << 32 | second, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([t[2] for t in tails]), len(pairs)).astype(np.int64)
        head, tail = pairs >> 32, pairs & 0xFFFFFFFF
        stats = np.zeros((len(words), _STATS))
        for r in range(1, K + 1):
            stats[:, r - 1] = np.bincount(head[counts == r], minlength=len(words))
        stats[:, K] = np.bincount(head, np.where(counts > K, counts, 0), len(words))
        stats[:, K + 1] = np.bincount(head, np.where(counts > 0, mass[tail], 0.0), len(words))
        out, at, word_at = [], 0, 0
        for block, h, t in zip(rows["block"].to_pylist(), heads, tails):
            mine, own = inverse[at : at + len(t[0])], word_of[word_at : word_at + len(h[0])]
            at, word_at = at + len(t[0]), word_at + len(h[0])
            out.append((block, part, pack(counts[mine].astype(np.int64)), pack(stats[own].ravel()), None, None, None))
        rare = [int((counts == r).sum()) for r in range(1, K + 2)]
        out.append((-1, part, None, None, rare, None, None))
        out += [(-2, part, None, None, None, int(words[w]), stats[w].tolist()) for w in np.flatnonzero(frequent)]
        return _table(out, arrow)

    return asked.groupBy("part").applyInArrow(add_up, _ANSWER)


def backoff(stats: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, scale) of first words: the bigrams of a word have ``scale`` times their discounted probabilities, and
    weight times the unigram mass of all other words is what they leave.

    Where no bigram of a word is rare enough to be discounted, one count in c + 1 is left.
    """
    c = np.maximum(counts, 1)
    used = (stats[:, :K] @ (np.arange(1, K + 1) * d[1:]) + stats[:, K]) / c
    scale = np.where(1 - used < 1e-9, c / (c + 1), 1.0)
    rest = np.maximum(1 - stats[:, K + 1], 1e-300)
    weight = np.where(counts > 0, (1 - used * scale) / rest, 1.0)
    return weight, np.where(counts > 0, scale, 1.0)


def evaluate(
    blocks: DataFrame, answers: DataFrame, parts: int, base: Unigrams, words: int, d: np.ndarray, frequent: dict, id_col: str
) -> DataFrame:
    """Scores of every document. The ids are handed through as Arrow values and never become numbers of another kind."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = arrow_schema(schema)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, right.filter(pc.equal(right["level"], 1)))
        seen = np.zeros(len(block.pairs), np.int64)
        stats = np.zeros((len(block.numbers), _STATS))
        second = right.filter(pc.equal(right["level"], 2))
        replies = {p: k for k, p in enumerate(second["part"].to_pylist())}
        for p, at in block.in_parts(parts, base.total):
            k = replies[p]
            seen[at] = unpack(second["a"][k].as_py(), np.int64)
            first = block.first[at]
            start = np.concatenate(([True], first[1:] != first[:-1]))
            stats[first[start]] = unpack(second["b"][k].as_py(), np.float64).reshape(-1, _STATS)
        for k in np.flatnonzero(block.counts * FREQUENT * parts >= max(1, base.total)):
            if int(block.numbers[k]) in frequent:
                stats[k] = frequent[int(block.numbers[k])]
        weight, scale = backoff(stats, block.counts, d)
        lower = base.probability(block.counts)
        history = np.maximum(block.counts[block.first], 1)
        ratio = np.where(seen <= K, d[np.minimum(seen, K)], 1.0) * scale[block.first]
        chance = np.where(seen > 0, ratio * seen / history, weight[block.first] * lower[block.second])
        logs = np.log10(chance)[block.inverse]
        plain = np.log10((block.counts + 1) / (base.total + words + 1))[block.tokens]
        ends = np.concatenate(([0], np.cumsum(block.sizes)[:-1]))
        columns = [
            pc.list_flatten(left["ids"]).combine_chunks(),
            block.held,
            block.sizes.astype(np.int64),
            np.add.reduceat((block.counts[block.tokens] > 0).astype(np.int64), ends),
            np.full(len(ends), base.total, np.int64),
            np.add.reduceat(plain, ends),
            np.add.reduceat(logs, ends),
        ]
        return pa.Table.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability of the text)."""
    parts = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), measured(docs, text_col)[1] // PART_BYTES)
    encoded = written(encode(docs, parts, id_col, text_col))
    blocks = encoded.where("kind = 0").select("block", "ids", "a", "b", "c")
    first = written(unigrams(encoded.where("kind = 1").select("part", "block", "a", "b"), parts))
    total, words, *rare = _sums(first, K + 3)
    base = Unigrams(total, [0, *rare])
    given = first.where("block >= 0")
    second = written(bigrams(ask_bigrams(blocks, given.select("block", "part", "a", "b"), parts, total), base))
    d = discounts([0, *_sums(second, K + 1)])
    # words with more than a share of a part's tokens: FREQUENT times the number of parts at most
    shares = second.where("block = -2").groupBy("word").agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(_STATS)])
    frequent = {r[0]: list(r)[1:] for r in shares.collect()}
    both = given.select("block", "part", "a", "b", F.lit(1).alias("level")).unionByName(
        second.where("block >= 0").select("block", "part", "a", "b", F.lit(2).alias("level"))
    )
    return evaluate(blocks, both, parts, base, words, d, frequent, id_col)


def _sums(answers: DataFrame, n: int) -> list[int]:
    row = answers.where("block = -1").agg(*[F.sum(F.col("n")[k]) for k in range(n)]).first()
    return [int(x or 0) for x in row]
