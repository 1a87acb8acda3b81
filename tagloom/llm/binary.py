"""Token ids as binary files with Elias-Fano boundaries.

A file holds the ids of consecutive documents one after the other, as 16-bit numbers where the vocabulary allows it, and
two rising sequences in Elias-Fano form: the places where documents begin and end, and the names of the documents. A
sequence of n numbers up to u takes about 2 + log2(u / n) bits for each: the low bits as they are, the high ones as ones in
a row of bits at (high part + number before it). ``select`` finds the i-th one from samples of every ``EVERY``-th, which
are packed in as many bits as the row's length needs; no table of 64-bit offsets exists, on disk or in memory.

1. Texts are sorted by document over ranges. The task of a range encodes them, each distinct chunk once, and writes a file
   for every ``FILE_IDS`` ids, under a name of its own that becomes visible by a rename; it returns the entries of its files
   for the manifest. A task that runs twice leaves files that no manifest names.
2. The manifest gets the number of ids before each file. Reading takes the manifest alone and goes through the files in
   ranges of ids.

Defined results: null text is empty and has the end id alone; null ids come first; rows with equal ids stand by a hash of
their texts; repeated rows are kept; ids have to be whole numbers; other columns are ignored; an empty table makes no
files and gives no rows; a text is a document of one file whatever its length.
"""

from __future__ import annotations

import contextlib
import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UNCLEAR, arrow_schema, hand_back, measured, shared_dir, written

#: Id that ends every document.
END = 2
#: Ids of a file at least, unless a range has fewer; and ids that a reader holds at a time.
FILE_IDS = 16_000_000
READ_IDS = 2_000_000
#: Bytes of text of a range at most, unless one document has more.
RANGE_BYTES = 48_000_000
#: Distinct chunks that a worker remembers, the longest that it remembers, and chunks that the library gets at a time.
CHUNKS, LONGEST, TOGETHER = 700_000, 64, 100
#: Marks that often follow a word.
MARKS = ".,"
#: Bytes of texts that are encoded at a time.
BATCH_BYTES = 6_000_000
#: Ones between two samples of ``select``, and documents of a batch that a reader gives out.
EVERY = 256
DOCS = 10_000

MAGIC = b"EFTOKENS"
#: width of ids, documents, those without a name, ids, smallest name, bytes of the two sequences
_HEAD = struct.Struct("<8sIQQQqQQ")
_SEQUENCE = struct.Struct("<QQBBQ")  # numbers, bits of the row, low bits, bits of a sample, samples


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers in ``width`` bits each, one after the other."""
    if not width or not len(values):
        return np.empty(0, np.uint8)
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(bits.ravel(), bitorder="little")


def unpack_bits(data: np.ndarray, first: int, n: int, width: int) -> np.ndarray:
    """Numbers first..first+n of those that ``pack_bits`` packed."""
    if not width or not n:
        return np.zeros(n, np.uint64)
    start, stop = first * width, (first + n) * width
    bits = np.unpackbits(data[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 : start % 8 + n * width]
    return bits.reshape(n, width).astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))


class EliasFano:
    """A rising sequence of unsigned numbers."""

    def __init__(self, n: int, length: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample_bits: int, samples: np.ndarray):
        self.n, self.length, self.low_bits, self.low, self.high = n, length, low_bits, low, high
        self.sample_bits, self.samples = sample_bits, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        length = int(ones[-1]) + 1 if n else 0
        row = np.zeros(length, np.uint8)
        row[ones] = 1
        sample_bits = max(1, length.bit_length())
        low = pack_bits(values & np.uint64((1 << low_bits) - 1), low_bits)
        return cls(n, length, low_bits, low, np.packbits(row, bitorder="little"), sample_bits, pack_bits(ones[::EVERY], sample_bits))

    def to_bytes(self) -> bytes:
        head = _SEQUENCE.pack(self.n, self.length, self.low_bits, self.sample_bits, len(self.samples))
        return b"".join((head, self.samples.tobytes(), self.low.tobytes(), self.high.tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, length, low_bits, sample_bits, samples = _SEQUENCE.unpack_from(data)
        rest = np.frombuffer(data, np.uint8, offset=_SEQUENCE.size)
        low = samples + -(-n * low_bits // 8)
        return cls(n, length, low_bits, rest[samples:low], rest[low:], sample_bits, rest[:samples])

    def select(self, i: int) -> int:
        """Place of the i-th one: from the sample before it, by counting ones byte by byte."""
        at = int(unpack_bits(self.samples, i // EVERY, 1, self.sample_bits)[0])
        left = i % EVERY
        byte, inside = at // 8, int(self.high[at // 8]) >> at % 8 << at % 8
        while (ones := inside.bit_count()) <= left:
            left -= ones
            byte += 1
            inside = int(self.high[byte])
        for _ in range(left):
            inside &= inside - 1
        return 8 * byte + (inside & -inside).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        return (self.select(i) - i) << self.low_bits | int(unpack_bits(self.low, i, 1, self.low_bits)[0])

    def part(self, first: int, n: int) -> np.ndarray:
        """Numbers first..first+n."""
        if not n:
            return np.empty(0, np.uint64)
        start, stop = self.select(first), self.select(first + n - 1) + 1
        bits = np.unpackbits(self.high[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 : start % 8 + stop - start]
        high = (np.flatnonzero(bits) + start - np.arange(first, first + n)).astype(np.uint64)
        return high << np.uint64(self.low_bits) | unpack_bits(self.low, first, n, self.low_bits)


def file_bytes(names: list[int | None], ids: list[bytes], width: int) -> list[bytes]:
    """The parts of a file: head, boundaries, names and the ids, given by document in order."""
    limits = np.concatenate(([0], np.cumsum([len(x) // width for x in ids])))
    named = np.array([n for n in names if n is not None], np.int64)
    least = int(named[0]) if len(named) else 0
    bounds = EliasFano.of(limits).to_bytes()
    own = EliasFano.of(named.view(np.uint64) - np.int64(least).astype(np.uint64)).to_bytes()
    head = _HEAD.pack(MAGIC, width, len(names), len(names) - len(named), int(limits[-1]), least, len(bounds), len(own))
    return [head, bounds, own, *ids]


class TokenFile:
    """A file for reading: documents by number without reading the others."""

    def __init__(self, path: str):
        self.file = _file_system(path)[0].open_input_file(_file_system(path)[1])
        magic, self.width, self.n, self.unnamed, self.n_ids, self.least, bounds, own = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} holds no token ids")
        self.bounds = EliasFano.from_bytes(self.file.read_at(bounds, _HEAD.size))
        self.own = EliasFano.from_bytes(self.file.read_at(own, _HEAD.size + bounds))
        self.start = _HEAD.size + bounds + own

    def names(self, first: int, n: int) -> list[int | None]:
        empty = min(n, max(0, self.unnamed - first))
        found = self.own.part(max(0, first - self.unnamed), n - empty) + np.int64(self.least).astype(np.uint64)
        return [None] * empty + found.view(np.int64).tolist()

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids first..first+n of the file."""
        return np.frombuffer(self.file.read_at(n * self.width, self.start + first * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        first = self.bounds[i]
        return self.ids(first, self.bounds[i + 1] - first)

    def crcs(self, limits: list[int]) -> list[int]:
        """Checksum of each document between the limits, as 32-bit numbers; ids are read some at a time."""
        out, held, start = [], np.empty(0, np.uint16), 0
        for first, end in zip(limits, limits[1:]):
            crc, at = 0, first
            while at < end:
                if not start <= at < start + len(held):
                    start, held = at, self.ids(at, min(READ_IDS, limits[-1] - at))
                stop = min(end, start + len(held))
                crc = zlib.crc32(held[at - start : stop - start].astype("<u4"), crc)
                at = stop
            out.append(crc)
        return out


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Encoder:
    """Ids of texts by a tokenizer file. A text is cut before its single spaces, where no piece of the vocabulary's pattern
    reaches across, and every chunk that has been met keeps its ids. New chunks go to the library together, as a text of
    their own: each begins with the only token of it that begins with a space."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = max(self.tokenizer.get_vocab_size(), end + 1)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = np.array([end], self.kind).tobytes()
        self.begins = np.zeros(size, bool)  # tokens that begin with a space, as the vocabulary writes it
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token[:1] == "\u0120"]] = True
        self.known: dict[str, bytes] = {}
        self.marks = dict(zip(MARKS, self.plain(list(MARKS))))

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, fresh: list[str]) -> None:
        """Keeps the ids of chunks. Letters and a mark after them are two pieces, so the mark does not make a new chunk."""
        marked = [c for c in fresh if c[-1:] in self.marks and c[:-1].isalpha()]
        if marked:
            told = set(marked)
            self.learn(list({c[:-1] for c in marked} - self.known.keys()) + [c for c in fresh if c not in told])
            self.known.update((c, self.known[c[:-1]] + self.marks[c[-1]]) for c in marked)
            return
        fresh = [c for c in fresh if c not in self.known]
        usual = [c for c in fresh if c and c.strip() == c]
        data = b"".join(self.plain([" " + " ".join(usual[at : at + TOGETHER]) for at in range(0, len(usual), TOGETHER)]))
        limits = (np.flatnonzero(self.begins[np.frombuffer(data, self.kind)]) * self.width).tolist() + [len(data)]
        if len(limits) != len(usual) + 1:
            raise ValueError("chunks of a text and their tokens differ in number")
        self.known.update((c, data[a:b]) for c, a, b in zip(usual, limits, limits[1:]))
        odd = [c for c in fresh if not c or c.strip() != c]
        self.known.update(zip(odd, self.plain([" " + c for c in odd])))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text with the end id."""
        listed = texts.to_pylist()
        whole = np.array([bool(t and UNCLEAR.search(t)) for t in listed], bool)  # not to be cut
        cut = pc.split_pattern(pc.if_else(pa.array(whole), "", pc.fill_null(texts, "")), " ")
        starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        codes, chunks = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = [t if w else (t or "").partition(" ")[0] for t, w in zip(listed, whole.tolist())]
        if len(self.known) > CHUNKS:  # what this batch has again stays
            self.known = {c: self.known[c] for c in chunks if c in self.known}
        self.learn([c for c in chunks if c not in self.known])
        # a text is its first chunk, which has no space before it, the others, and the end
        made = [*map(self.known.__getitem__, chunks), *self.plain(first), self.end]
        codes[starts[:-1]] = len(chunks) + np.arange(len(listed))
        codes = np.insert(codes, starts[1:], len(made) - 1)
        data, sizes = np.frombuffer(b"".join(made), self.kind), np.fromiter(map(len, made), np.int64, len(made)) // self.width
        begin, n = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.cumsum(n)
        ids = data[np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        for c in chunks:
            if len(c) > LONGEST:
                del self.known[c]
        limits = np.concatenate(([0], ends[starts[1:] + np.arange(len(listed))])) * self.width
        return [ids[a:b] for a, b in zip(limits.tolist(), limits[1:].tolist())]


@functools.lru_cache(1)
def _encoder(path: str, end: int) -> _Encoder:
    """Kept by a worker from task to task."""
    return _Encoder(path, end)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, n) of consecutive texts with some megabytes together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = sizes[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, side="right")))
        yield first, stop - first
        first = stop


MANIFEST = "path string, first long, tie long, number int, n_docs long, n_ids long"


def token_files(docs: DataFrame, path: str, folder: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes all texts with the tokenizer in the file ``path``, writes them in the order of ids below ``folder`` (else a
    new one in the shared folder) and gives the manifest: path, documents and ids of each file, and ``base``, the ids of all
    files before it."""
    spark: SparkSession = docs.sparkSession
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} has to be a whole number")
    folder = folder or f"{shared_dir(spark)}/tagloom-{uuid.uuid4().hex}"
    # the number makes rows with equal ids and texts differ, so that no key is bound to one range
    keys = [F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("row")]
    texts = docs.select(*keys, F.col(text_col).alias("text"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), measured(texts)[1] // RANGE_BYTES + 1)
    fields = arrow_schema(MANIFEST)
    files, inside = _file_system(folder)
    files.create_dir(inside, recursive=True)

    def write(names: list, held: list[bytes], width: int) -> str:
        files, inside = _file_system(folder)
        name = f"{inside}/{uuid.uuid4().hex}"
        with files.open_output_stream(f"{name}.part") as f:
            for piece in file_bytes(names, held, width):
                f.write(piece)
        files.move(f"{name}.part", f"{name}.tokens")
        return f"{folder}/{name.rpartition('/')[2]}.tokens"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, end)
        names, held, size, rows, tie = [], [], 0, [], None

        def close():
            rows.append((write(names, held, encode.width), names[0], tie, len(rows), len(names), size))

        for batch in batches:
            for part in (batch.slice(at, n) for at, n in _slices(batch.column(2))):
                for name, own, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encode(part.column(2))):
                    if not names:
                        tie = own
                    names.append(name)
                    held.append(ids)
                    size += len(ids) // encode.width
                    if size >= file_ids:
                        close()
                        names, held, size = [], [], 0
        if names:
            close()
        names, held = [], []
        hand_back()
        columns = zip(*rows) if rows else [[]] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=fields)

    sorted_ = texts.repartitionByRange(ranges, "id", "tie", "row").sortWithinPartitions("id", "tie", "row")
    made = written(sorted_.select("id", "tie", "text").mapInArrow(run, MANIFEST))
    order = Window.orderBy(F.asc_nulls_first("first"), "tie", "number")  # a row for each file
    before = F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return written(made.withColumn("base", before))


def read_files(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    schema = "id long, start long, n_tokens long, ids_crc32 long"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = TokenFile(path)
                for first in range(0, tokens.n, DOCS):
                    n = min(DOCS, tokens.n - first)
                    limits = tokens.bounds.part(first, n + 1).astype(np.int64)
                    columns = [tokens.names(first, n), limits[:-1] + base, np.diff(limits), tokens.crcs(limits.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)
                with contextlib.suppress(OSError):
                    tokens.file.close()
        hand_back()

    parts = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    return manifest.select("path", "base").repartition(parts).mapInArrow(run, schema)
