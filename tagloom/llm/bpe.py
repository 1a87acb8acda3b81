"""Byte-level BPE by prefix dynamic programming.

The merge order of byte-pair encoding gives every byte prefix of a piece exactly one encoding, so one last token per
prefix describes them all: the encoding of a prefix that ends with token ``t`` is the encoding of the prefix before
``t`` followed by ``t``. ``Piece.last`` stores those tokens. A token is the last one of a prefix exactly if it may stand
next to the last token of the prefix before it, which ``Vocabulary.adjacent`` decides from the merges alone. Appending
bytes therefore only extends the table, and an edit recomputes it from the edit on until it has agreed with the old
table over the length of the longest token; the rest is then known to be the same.

Defined results: null text encodes as the empty text (no ids); repeated rows and null ids are kept row for row; other
columns are ignored; an empty table gives an empty result; very long texts are handled piece by piece.
"""

from __future__ import annotations

import base64
import functools
import gc
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_pieces, chunks, hand_back

#: Pieces that a worker remembers before it forgets those that are out of use.
PIECES = 150_000
#: Pairs of tokens whose neighbourhood a vocabulary remembers.
PAIRS = 150_000


class Vocabulary:
    """Tokens by rank and the merges that they imply."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens = {i: t for t, i in ranks.items()}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        self.known_made: set[int] = set()
        #: near[left].get(right): whether the two may stand side by side, as far as that has been asked
        self.near: dict[int, dict[int, bool]] = defaultdict(dict)
        self.n_near = 0
        #: every end of a token: its own id if it is a token, else -1
        self.endings = {t[i:]: -1 for t in ranks for i in range(len(t))} | ranks

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, parts: list[bytes], below: float = float("inf")) -> list[bytes]:
        """Plain merging of the lowest pair first, used to take single tokens apart."""
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte, or for a token that no merges make."""
        if token not in self._split:
            data = self.tokens[token]
            parts = self.merge([data[i : i + 1] for i in range(len(data))], token)
            self._split[token] = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
        return self._split[token]

    def made(self, token: int) -> bool:
        """Whether merges alone make the token; others only stand for a whole piece."""
        if token not in self.known_made and (len(self.tokens[token]) == 1 or self.split(token) is not None):
            self.known_made.add(token)
        return token in self.known_made

    def spine(self, token: int, side: int) -> list[tuple[int, bytes]]:
        """(rank of the merge that makes it, bytes of the token) along one edge, from the single byte up."""
        if (token, side) not in self._spines:
            up, t = [], token
            while (parts := self.split(t)) is not None:
                up.append((t, self.tokens[t]))
                t = parts[side]
            self._spines[token, side] = [(-1, self.tokens[t]), *reversed(up)]
        return self._spines[token, side]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are merged together.

        Follows the merges on both sides of the border in the order of their ranks and asks, before each, whether
        the pair across the border would be merged first. Of equal ranks the leftmost goes first: one inside
        ``left`` goes before the pair, the pair goes before one inside ``right``.
        """
        known = self.near[left].get(right)
        if known is None:
            if self.n_near >= PAIRS:
                self.near.clear()
                self.n_near = 0
            known = self.near[left][right] = self._apart(left, right)
            self.n_near += 1
        return known

    def _apart(self, left: int, right: int) -> bool:
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while True:
            cross = self.ranks.get(a[i][1] + b[j][1])
            up_a = a[i + 1][0] if i + 1 < len(a) else None
            up_b = b[j + 1][0] if j + 1 < len(b) else None
            if up_a is None and up_b is None:
                return cross is None
            if up_b is None or up_a is not None and up_a <= up_b:
                if cross is not None and cross < up_a:
                    return False
                i += 1
            else:
                if cross is not None and cross <= up_b:
                    return False
                j += 1


class Piece:
    """One piece of text with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def _extend(self, stop: int) -> None:
        """Fill in the last tokens of the prefixes up to ``stop`` bytes.

        Looks at the byte strings that end there from the shortest on, for as long as one is the end of any token.
        """
        v, data, last = self.v, self.data, self.last
        ending, near, made = v.endings.get, v.near, v.known_made
        for end in range(len(last) + 1, stop + 1):
            for start in range(end - 1, -1, -1):
                token = ending(data[start:end])
                if token is None:
                    raise ValueError(f"no token ends at byte {end}; the vocabulary lacks single bytes")
                if token < 0:
                    continue
                if start:
                    before = last[start - 1]
                    fits = near[before].get(token)
                    if not (v.adjacent(before, token) if fits is None else fits):
                        continue
                if token in made or v.made(token):
                    last.append(token)
                    break

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of data[start:stop]; returns how many prefixes were computed again."""
        old, shift, edited = self.last, len(new) - (stop - start), start + len(new)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same = old[:start], 0
        for end in range(start + 1, len(self.data) + 1):
            self._extend(end)
            same = same + 1 if end > edited and self.last[-1] == old[end - shift - 1] else 0
            if same >= self.v.longest:
                self.last += old[end - shift :]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.tokens[out[-1]])
        return out[::-1]


def encode_piece(v: Vocabulary, data: bytes) -> tuple[int, ...]:
    """Ids of one match of the splitting pattern; a piece that is a token stands for itself."""
    whole = v.ranks.get(data)
    return (whole,) if whole is not None else tuple(Piece(v, data).ids())


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def encode_sorted(v: Vocabulary, pieces: list[bytes]) -> Iterator[tuple[int, ...]]:
    """Ids of sorted pieces; the table of a prefix that a piece shares with the one before is kept."""
    piece = Piece(v)
    for data in pieces:
        whole = v.ranks.get(data)
        if whole is not None:
            yield (whole,)
            continue
        shared = 0
        for x, y in zip(piece.data, data):
            if x != y:
                break
            shared += 1
        piece.data = data
        del piece.last[shared:]
        piece._extend(len(data))
        yield tuple(piece.ids())


class Encoder:
    """Encodes batches of texts, equal chunks of a batch once; what it remembers is shared by the batches of a worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.v, self.find = vocabulary(path), regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        collects = gc.isenabled()
        gc.disable()  # nothing here refers back to itself, and looking for that takes time
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        find = self.find
        split = [chunks(text, find) for text in texts]
        known = {chunk: chunk_pieces(chunk, find) for chunk in set().union(*(rest for _, rest in split))}
        ids = self.ids(set().union(*known.values(), *(first for first, _ in split)))
        piece = ids.__getitem__
        for chunk, parts in known.items():
            known[chunk] = piece(parts[0]) if len(parts) == 1 else b"".join(map(piece, parts))
        whole = known.__getitem__
        return [np.frombuffer(b"".join([*map(piece, first), *map(whole, rest)]), np.int32) for first, rest in split]

    def ids(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces as 32-bit integers. Those of a bounded number of pieces are remembered; pieces in use stay."""
        out, new, recent, older = {}, [], self.recent, self.older
        for piece in pieces:
            found = recent.get(piece)
            if found is None:
                found = older.get(piece)
                if found is None:
                    new.append(piece.encode())
                    continue
                recent[piece] = found
            out[piece] = found
        new.sort()
        for data, made in zip(new, encode_sorted(self.v, new)):
            piece = data.decode()
            out[piece] = recent[piece] = array("i", made).tobytes()
        if len(recent) > PIECES:
            self.older, self.recent = recent, {}
        return out


@functools.cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_texts(texts: list[str | None], path: str, pattern: str) -> list[np.ndarray]:
    return _encoder(path, pattern).encode(texts)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rows_per_batch: int = 512, decoded: bool = False
) -> DataFrame:
    """id and ``ids`` (array of int) of every whole text, on demand with ``decoded`` (as ``decode`` gives it, without a
    second worker for each task). ``path`` names a rank file that every worker can open."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows_per_batch):
                part = whole.slice(start, rows_per_batch)
                each = encode_texts(part.column(1).to_pylist(), path, pattern)
                ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))
                columns = [part.column(0), ids]
                if decoded:
                    columns.append(_bytes_of(ids, _token_bytes(path)))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])
        _encoder(path, pattern).forget()  # the worker goes on to other work
        hand_back()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>" + (", decoded binary" if decoded else ""))


@functools.cache
def _token_bytes(path: str) -> pa.Array:
    tokens = vocabulary(path).tokens
    return pa.array([tokens.get(i, b"") for i in range(max(tokens) + 1)], pa.binary())


def _bytes_of(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The bytes of all tokens in a row; a text is the part between its first and last token."""
    taken = tokens.take(ids.flatten())
    place = ids.offsets.to_numpy()
    ends = np.frombuffer(taken.buffers()[1], np.int32)[place - place[0]] if len(taken) else np.zeros(len(ids) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), taken.buffers()[2]])


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", rows_per_batch: int = 256) -> DataFrame:
    """All columns and ``decoded`` (binary): the bytes that the ids stand for. Null ids decode to no bytes."""
    schema = encoded.drop("decoded").schema.add("decoded", "binary")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows_per_batch):
                part = whole.slice(start, rows_per_batch)
                ids = pc.fill_null(part.column(names.index(ids_col)), pa.scalar([], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*part.columns, _bytes_of(ids, _token_bytes(path))], names=names)

    return encoded.drop("decoded").mapInArrow(run, schema)


def digests(decoded: DataFrame, id_col: str = "doc_id", also: list[str] = ()) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256, and the columns named in ``also``."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *also,
    )
