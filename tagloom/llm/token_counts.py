"""Token counts under a unigram model by dynamic programming over a trie.

Texts are split into pre-tokens; the distinct ones of a batch are inserted into a trie of bytes. The best score of every
prefix (the largest sum of token scores over all ways to split it into tokens) depends on the prefix alone, so it is
computed once, when its node is made, whatever number of pre-tokens share it; the number of tokens of the best split is
kept at the nodes where pre-tokens end. A document's count is the sum over its pre-tokens.

The vocabulary is a public rank file that is given and not trained. ``train`` fits the token probabilities to all texts:
the distinct pre-tokens are counted by Spark, each is split once by first scores (Zipf by rank), and the tokens of the
splits are added up; the model is a table of the vocabulary's size. Of splits with equal scores the one with fewer tokens
counts, so counts are unique.

Defined results: null and empty texts have no pre-tokens and no tokens; repeated rows get a row each; other columns are
ignored; an empty table gives no rows and trains a uniform model; a batch holds a bounded number of texts and its trie is
dropped after it.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_pieces, chunks, hand_back

#: Texts that share one trie.
BATCH = 1024
#: Chunks of text whose counts a worker remembers.
REMEMBERED = 400_000
#: Nodes of the trie that a worker keeps before it begins a new one.
NODES = 1_000_000


class Unigram:
    """Token scores: natural logarithms of probabilities, by default of a Zipf distribution over the ranks of the
    vocabulary."""

    def __init__(self, tokens: dict[bytes, int], score: dict[bytes, float] | None = None):
        total = math.log(sum(1 / (rank + 1) for rank in tokens.values()))
        self.score = score or {token: -math.log(rank + 1) - total for token, rank in tokens.items()}
        self.ends = {token[i:] for token in tokens for i in range(len(token))}

    @classmethod
    def load(cls, path: str, counts: dict[int, int] | None = None) -> Unigram:
        """The model of a rank file; with counts of token ids, of one more than the count of each token."""
        with open(path, "rb") as f:
            tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if counts is None:
            return cls(tokens)
        total = math.log(sum(counts.values()) + len(tokens))
        return cls(tokens, {token: math.log(counts.get(rank, 0) + 1) - total for token, rank in tokens.items()})


class Trie:
    """Pre-tokens by their bytes. ``best`` has for each node the score of its prefix's best split, minus its number of
    tokens, and where its last token starts."""

    def __init__(self, model: Unigram):
        self.model = model
        self.edges: dict[int, int] = {}  # (node, byte) as one number, to the node below
        self.best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        self.tokens: dict[bytes, int] = {}  # at the ends of pre-tokens

    def insert(self, word: bytes) -> list[int]:
        """The nodes of a pre-token's prefixes; new ones get their scores."""
        path, edges = [0], self.edges
        for end, byte in enumerate(word, 1):
            edge = path[-1] << 8 | byte
            node = edges.get(edge)
            if node is None:
                node = edges[edge] = len(self.best)
                self.best.append(self._forward(word, end, path))
            path.append(node)
        self.tokens[word] = -self.best[path[-1]][1]
        return path

    def _forward(self, word: bytes, end: int, path: list[int]) -> tuple[float, int, int]:
        score, ends, best, top = self.model.score.get, self.model.ends, self.best, None
        for start in range(end - 1, -1, -1):
            token = word[start:end]
            if token not in ends:
                break
            own = score(token)
            if own is not None:
                total, minus, _ = best[path[start]]
                made = (total + own, minus - 1, start)
                if top is None or made > top:
                    top = made
        if top is None:
            raise ValueError(f"no token ends in {word[:end]!r}; the vocabulary lacks single bytes")
        return top

    def split(self, word: bytes) -> list[bytes]:
        """The tokens of a pre-token's best split."""
        path, end, out = self.insert(word), len(word), []
        while end:
            start = self.best[path[end]][2]
            out.append(word[start:end])
            end = start
        return out[::-1]


def count_tokens(model: Unigram, pretokens: Iterable[bytes], trie: Trie | None = None) -> dict[bytes, int]:
    """Tokens in the best split of each distinct pre-token; a trie that is handed over keeps its nodes for later calls."""
    trie = trie or Trie(model)
    for word in set(pretokens):
        if word not in trie.tokens:
            trie.insert(word)
    return trie.tokens


def _splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def train(docs: DataFrame, path: str, pattern: str, text_col: str = "text", batch: int = BATCH) -> dict[int, int]:
    """How often each token of the vocabulary stands in the best splits of all texts, by first scores."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, found, parts = _splitter(pattern), Counter(), Counter()

        def out():
            for chunk, n in parts.items():
                for piece in chunk_pieces(chunk, find):
                    found[piece] += n
            made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["piece", "n"])
            found.clear()
            parts.clear()
            return made

        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                for text in whole.column(0).slice(start, batch).to_pylist():
                    first, rest = chunks(text, find)
                    found.update(first)
                    parts.update(rest)
                if len(found) + len(parts) > REMEMBERED // 2:
                    yield out()
        yield out()
        hand_back()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.load(path)
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        found: Counter = Counter()
        for whole in batches:
            trie = Trie(model)
            for piece, n in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist()):
                for token in trie.split(piece.encode()):
                    found[ids[token]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["id", "n"])
        hand_back()

    counted = docs.select(text_col).mapInArrow(pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    totals = counted.mapInArrow(split, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {row["id"]: row["n"] for row in totals.collect()}  # at most one row for each token of the vocabulary


class _Kept:
    """What a worker keeps from batch to batch and from task to task: the model, a trie of pre-tokens, and the numbers of
    pre-tokens (from bit 32 on) and tokens of chunks."""

    def __init__(self, model: Unigram):
        self.model, self.trie, self.chunks = model, Trie(model), {}

    def forget(self, wanted: set[str]) -> None:
        """Makes room: chunks that are wanted now stay, the trie is begun anew."""
        if len(self.chunks) > REMEMBERED:
            self.chunks = {c: self.chunks[c] for c in wanted if c in self.chunks}
        if len(self.trie.best) > NODES:
            self.trie = Trie(self.model)


_MODELS: dict[tuple, _Kept] = {}


def _model(path: str, held, number: int | None) -> _Kept:
    """The model used last is kept."""
    if (path, number) not in _MODELS:
        _MODELS.clear()
        _MODELS[path, number] = _Kept(Unigram.load(path, held and held.value))
    return _MODELS[path, number]


def counts(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch: int = BATCH,
    trained: dict[int, int] | None = None,
) -> DataFrame:
    """id, n_pretokens and n_tokens of every whole text, by first scores or by counts of ``train``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    held = None if trained is None else docs.sparkSession.sparkContext.broadcast(trained)  # of the vocabulary's size
    number = held and held._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, kept = _splitter(pattern), _model(path, held, number)
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                split = [chunks(text, find) for text in part.column(1).to_pylist()]
                wanted = set().union(*(rest for _, rest in split))
                kept.forget(wanted)
                known = kept.chunks
                new = {chunk: chunk_pieces(chunk, find) for chunk in wanted if chunk not in known}
                pieces = {p: p.encode() for p in set().union(*new.values(), *(first for first, _ in split))}
                tokens = count_tokens(kept.model, pieces.values(), kept.trie)
                found = {p: tokens[data] for p, data in pieces.items()}
                known.update((chunk, (len(of) << 32) + sum(map(found.__getitem__, of))) for chunk, of in new.items())
                rows = []
                for first, rest in split:  # both sums at once
                    both = sum(map(known.__getitem__, rest), (len(first) << 32) + sum(map(found.__getitem__, first)))
                    rows.append((both >> 32, both & 0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([row[k] for row in rows], pa.int64()) for k in (0, 1)]], names=[id_col, "n_pretokens", "n_tokens"]
                )
        hand_back()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_pretokens long, n_tokens long")
