"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on the full shingle sets.

Two small collections of ``HALVES`` half keys each (``ROWS`` minhashes to a half key) are computed; every pair of a first
and a second half key is the key of one table. So ``HALVES`` squared tables of ``2 * ROWS`` minhashes need only
``2 * HALVES * ROWS`` minhashes.  A pair of similarity 0.8 shares no table with probability 4e-4, one of 0.9 with 4e-7.

Equal shingle sets are one class from the start. Within a bucket no pairs are listed:

1. Classes in a bucket are compared by signature with its smallest class only (a star); what may be similar makes loose
   clusters.
2. A cluster's full sets are compared with each other, and only the links that hold its parts together are given out:
   less than one for each member. In a large cluster all members are compared with a few leads first; what the leads
   connect is not compared with itself again, and blocks of the members left over meet each other and all others.
3. Buckets that still hold several clusters are looked at again: members of different clusters are compared by their
   signatures, and the few pairs that may reach the threshold are confirmed on the full sets too.

Buckets are found by a range partitioning over (key, class), which splits a hot bucket over tasks; the parts of a bucket
are joined through one row for each task border. Stars of a hot class are dealt over tasks by a salt. What is kept on
disk at a time is one signature row for each document and the members of shared buckets. Copies of a text are combined
before their text is shuffled, and rows without words are joined with nothing.

Defined results: null, empty or white-space texts have no shingles and are linked with nothing; a text of fewer words
than a shingle is one shingle; repeated rows are equal documents and get a row each; a null id is never the name of a
component unless all are null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hand_back, map_texts, written
from .graph import components

HALVES = 12
ROWS = 3
N_HASHES = 2 * HALVES * ROWS
#: Pairs whose signatures agree less than this are not confirmed: over four deviations below a similarity of 0.8.
LEAST_AGREEMENT = 0.6
#: Members of a star, or of a block of a bucket, that one task handles together.
STAR = 4096
BLOCK = 2048
#: Shingles in a block of a cluster at most, as far as it has several members.
BLOCK_SHINGLES = 1_000_000
#: A cluster of more than this many blocks is compared with this many leads before its blocks meet.
LARGE, LEADS = 2, 3

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_ADD = _rng.integers(1, 2**63, N_HASHES, dtype=np.uint64)
_MUL = _rng.integers(1, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    for w in set(words):
        known[w] = digest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        return np.array([digest(h.tobytes(), len(h))], np.uint64)
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out ^= out >> np.uint64(29)
        out *= _MIX
        out += h[k : len(h) - size + 1 + k]
    out ^= out >> np.uint64(32)
    return np.unique(out * _MIX)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the set, in pieces of bounded memory."""
    least = np.full(N_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        x = (hashes[at : at + 4096, None] ^ _ADD) * _MUL
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=0), out=least)
    return least * _MIX


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Of each document: doc, n (shingles), node (hash of the set), the half keys a and b, one byte of each minhash,
    and the packed text for later confirmation."""
    import xxhash

    def one(i, text):
        hashes = shingle_hashes(text, size)
        if not len(hashes):
            return i, 0, None, None, None, None, None
        least = signature(hashes)
        halves = [_signed(xxhash.xxh3_64_intdigest(part.tobytes())) for part in least.reshape(2 * HALVES, ROWS)]
        node = _signed(xxhash.xxh3_64_intdigest(hashes.tobytes()))
        packed = zlib.compress(text.encode().lower(), 1)
        return i, len(hashes), node, halves[:HALVES], halves[HALVES:], (least >> np.uint64(56)).astype(np.uint8).tobytes(), packed

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, n long, node long, a array<long>, b array<long>, sig binary, packed binary"
    return map_texts(docs, [id_col, text_col], one, schema)


def buckets(classes: DataFrame) -> DataFrame:
    """(key, first, node): the members of every key that two or more classes share, with the smallest class that stood
    in the same task; a part of a bucket that may go on in another task is kept whatever its size."""
    keys = F.flatten(
        F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(i, j, x, y)))
    )
    rows = classes.select(F.explode(keys).alias("key"), "node")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "first", "node", "border"]
        held_key = held_node = held_first = None
        told = opening = True  # whether the held row has been emitted; whether its run is the first of the task
        for batch in batches:
            key, node = (np.asarray(c) for c in (batch.column(0), batch.column(1)))
            if not len(key):
                continue
            new = np.concatenate(([held_key is None or key[0] != held_key], key[1:] != key[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(start >= 0, node[start], held_first if held_first is not None else 0)
            again = ~new
            alone = new & ~np.concatenate((again[1:], [False]))
            alone[-1] = False  # the next batch may go on with it
            runs = np.flatnonzero(new)
            if held_key is None:
                opened = runs[1] if len(runs) > 1 else len(key)
            else:
                opened = (runs[0] if len(runs) else len(key)) if opening else 0
            border = np.arange(len(key)) < opened
            emit = (again | new & np.concatenate((again[1:], [False]))) | border
            last_told = bool(emit[-1])
            if held_key is not None and not told and again[0]:
                yield pa.RecordBatch.from_arrays([pa.array([held_key]), pa.array([held_first]), pa.array([held_node]), pa.array([opening])], names=names)
            out = np.flatnonzero(emit)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(first[out]), pa.array(node[out]), pa.array(border[out])], names=names)
            opening = bool(border[-1])
            held_key, held_node, held_first, told = key[-1], node[-1], first[-1], last_told
        if held_key is not None:  # the last run may go on in the next task
            yield pa.RecordBatch.from_arrays([pa.array([held_key]), pa.array([held_first]), pa.array([held_node]), pa.array([True])], names=names)

    return written(dealt.mapInArrow(shared, "key long, first long, node long, border boolean"))


def stars(found: DataFrame) -> DataFrame:
    """Candidate links (a, b): members with the smallest class of their part of a bucket, and the parts of a bucket,
    of which there are at most two for each task, with the smallest of all."""
    inner = found.where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    parts = found.where("border").select("key", "first").distinct()
    least = parts.groupBy("key").agg(F.min("first").alias("a"), F.max("first").alias("most")).where("a <> most")
    across = parts.join(least, "key").where("first <> a").select("a", F.col("first").alias("b"))
    return inner.unionByName(across).distinct()


def agreeing(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs that set sizes and signatures let reach the threshold."""
    of = lambda side: classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * int(round(threshold * 100))
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, N_HASHES) for k in (2, 3))
            near = (x == y).mean(axis=1) >= LEAST_AGREEMENT
            yield batch.select([0, 1]).filter(pa.array(near))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(close, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold.

    Each member's packed text goes once to each task that holds its star; the star's own text leads the way, and a star
    of many members is dealt over several tasks, each with a copy of that one text.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    tasks = F.ceil(F.col("degree") / STAR).cast("int")
    spread = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), tasks).alias("salt"))
    members = spread.join(texts, F.col("b") == F.col("node")).select("a", "salt", F.lit(1).alias("kind"), "b", "packed")
    leads = degree.join(texts, F.col("a") == F.col("node")).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), tasks.cast("long") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), "packed"
    )
    rows = leads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    percent = int(round(threshold * 100))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, kind, b, packed in zip(*(c.to_pylist() for c in batch.columns)):
                mine = shingle_hashes(zlib.decompress(packed).decode(), size)
                if kind == 0:
                    lead, own = a, mine
                elif a == lead:
                    common = len(np.intersect1d(own, mine, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(mine) - common):
                        a_out.append(a)
                        b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return rows.select("a", "kind", "b", "packed").mapInArrow(check, "a long, b long")


def met(rows: DataFrame, main: Column, blocks: Column, main_blocks: Column) -> DataFrame:
    """Deals rows to (i, j), the pairs of blocks that meet: blocks of all rows but those of the main part (0 to
    ``blocks`` - 1) meet each other and those of the main part (beyond), which do not meet each other."""
    first, many = F.when(main, blocks).otherwise(F.lit(0)), F.when(main, main_blocks).otherwise(blocks)
    own = (first + F.pmod(F.xxhash64("node"), many)).cast("int")
    others = F.when(main, blocks).otherwise(blocks + main_blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), others - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    return rows.where(others > 0).withColumns({"own": own, "p": F.explode(pairs)}).withColumns({"i": F.col("p.i"), "j": F.col("p.j")})


def block_count(members: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(members / BLOCK, F.least(members, shingles / BLOCK_SHINGLES))).cast("int")


def led(clusters: DataFrame, large: DataFrame, texts, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of large clusters: confirmed links of every member with the leads, and (node, main) of the lead with the most links
    and of the members that it is linked with."""
    members = clusters.join(large, "component", "left_semi")
    place = F.row_number().over(Window.partitionBy("component").orderBy("node"))
    leads = members.withColumn("place", place).where(F.col("place") <= LEADS).select("component", F.col("node").alias("a"))
    pairs = members.select("component", F.col("node").alias("b")).join(leads, "component").where("a <> b").select("a", "b")
    links = written(confirmed(pairs, texts(members), size, threshold))
    best = links.groupBy("a").count().join(leads, "a").groupBy("component").agg(F.max_by("a", "count").alias("a")).select("a")
    main = links.join(best, "a", "left_semi").select(F.col("b").alias("node")).unionByName(best.select(F.col("a").alias("node")))
    return links, main.withColumn("main", F.lit(True))


def cluster_links(clusters: DataFrame, classes: DataFrame, texts, size: int, threshold: float) -> DataFrame:
    """Confirmed links (a, b) that connect what is linked within each cluster, from all pairs of its full sets but those
    that leads have connected.

    Blocks of a large cluster meet in pairs, each pair in a group of its own; rows of a group come sorted, so that a task
    holds two blocks at a time.
    """
    sized = clusters.join(classes.select("node", "n"), "node")
    whole = sized.groupBy("component").agg(block_count(F.count("*"), F.sum("n")).alias("blocks"))
    large = written(whole.where(F.col("blocks") > LARGE).select("component"))
    links, main = None, F.lit(False)
    if not large.isEmpty():
        links, parts = led(clusters, large, texts, size, threshold)
        sized, main = sized.join(parts, "node", "left"), F.coalesce("main", F.lit(False))
    sized = sized.select("component", "node", "n", main.alias("main"))
    part = lambda m: block_count(F.count_if(F.col("main") == m), F.coalesce(F.sum(F.when(F.col("main") == m, F.col("n"))), F.lit(0)))
    sizes = sized.groupBy("component").agg(part(False).alias("blocks"), part(True).alias("main_blocks"))
    rows = sized.join(sizes, "component").join(texts(clusters), "node")
    dealt = met(rows, F.col("main"), F.col("blocks"), F.col("main_blocks")).select("component", "i", "j", "own", "node", "packed")
    key = ["component", "i", "j"]
    sorted_rows = dealt.repartition(*key).sortWithinPartitions(*key, "node")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []
        for batch in batches:
            found = []
            for component, i, j, own, node, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (component, i, j) != group:
                    found += linked(group, members, threshold)
                    group, members = (component, i, j), []
                members.append((own, node, shingle_hashes(zlib.decompress(packed).decode(), size)))
            yield _pairs_batch(found)
        yield _pairs_batch(linked(group, members, threshold))
        members = []
        hand_back()

    found = sorted_rows.mapInArrow(solve, "a long, b long")
    return found if links is None else found.unionByName(links)


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def linked(group: tuple | None, members: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """Links that connect all members of two blocks (or one) that links of the threshold connect."""
    if group is None or len(members) < 2:
        return []
    left = [m for m in members if m[0] == group[1]]
    right = left if group[1] == group[2] else [m for m in members if m[0] == group[2]]
    if not left or not right:
        return []
    near = similar([m[2] for m in left], [m[2] for m in right], threshold)
    found, open_left, open_right = [], set(range(len(left))), np.ones(len(right), bool)
    while open_left:  # a breadth-first forest from side to side
        start = open_left.pop()
        if left is right:
            open_right[start] = False
        frontier = [(start, True)]
        while frontier:
            at, on_left = frontier.pop()
            if on_left:
                reached = np.flatnonzero(near[at] & open_right)
                open_right[reached] = False
                found += [(left[at][1], right[k][1]) for k in reached]
                if left is right:
                    open_left.difference_update(reached.tolist())
                    frontier += [(k, True) for k in reached.tolist()]
                else:
                    frontier += [(k, False) for k in reached.tolist()]
            else:
                reached = [k for k in np.flatnonzero(near[:, at]).tolist() if k in open_left]
                open_left.difference_update(reached)
                found += [(left[k][1], right[at][1]) for k in reached]
                frontier += [(k, True) for k in reached]
    return found


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each set on the left and each on the right reach the threshold, from their exact common elements."""
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    percent = int(round(threshold * 100))
    _, code = np.unique(np.concatenate(left + right), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate((n, m)))
    shared = np.bincount(code) > 1  # elements of one set only are in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = number[code[keep]], owner[keep]
    common = np.zeros((len(left), len(right)), np.float32)
    step = 2048
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, b = np.searchsorted(code, (at, at + step))
        part = np.zeros((len(left) + len(right), step), np.float32)
        part[owner[a:b], code[a:b] - at] = 1
        common += part[: len(left)] @ part[len(left) :].T
    return 100 * common >= percent * (n[:, None] + m[None, :] - common)


def rest(found: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """Candidate links between members of one bucket that are in different clusters."""
    member = found.select("key", "node").distinct().join(clusters, "node", "left")
    member = member.withColumn("component", F.coalesce("component", "node"))
    parts = member.groupBy("key", "component").agg(F.count("*").alias("members"))
    open_ = (
        parts.groupBy("key")
        .agg(F.max_by("component", "members").alias("largest"), F.max("members").alias("most"), F.sum("members").alias("all"))
        .where(F.col("all") > F.col("most"))
    )
    blocks = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    rows = member.join(open_, "key").join(classes.select("node", "n", "sig"), "node")
    rows = rows.withColumn("main", F.col("component") == F.col("largest"))
    dealt = met(rows, F.col("main"), blocks, F.ceil(F.col("most") / BLOCK).cast("int"))
    dealt = dealt.select("key", "i", "j", "own", "node", "component", "n", "sig")
    percent = int(round(threshold * 100))
    key = ["key", "i", "j"]
    sorted_rows = dealt.repartition(*key).sortWithinPartitions(*key, "node")

    def meet(group: tuple | None, members: list[tuple]) -> list[tuple[int, int]]:
        if group is None or len(members) < 2:
            return []
        own, node, component, n = (np.array([m[k] for m in members]) for k in range(4))
        sig = np.frombuffer(b"".join(m[4] for m in members), np.uint8).reshape(-1, N_HASHES)
        left, right = np.flatnonzero(own == group[1]), np.flatnonzero(own == group[2])
        out = []
        for at in left:
            others = right[right > at] if group[1] == group[2] else right
            others = others[(component[others] != component[at]) & (np.minimum(n[others], n[at]) * 100 >= np.maximum(n[others], n[at]) * percent)]
            if len(others):
                near = others[(sig[others] == sig[at]).mean(axis=1) >= LEAST_AGREEMENT]
                out += [(min(int(node[at]), int(node[k])), max(int(node[at]), int(node[k]))) for k in near]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []
        for batch in batches:
            out = []
            for k, i, j, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, i, j) != group:
                    out += meet(group, members)
                    group, members = (k, i, j), []
                members.append(member)
            yield _pairs_batch(out)
        yield _pairs_batch(meet(group, members))
        members = []
        hand_back()

    return sorted_rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links reach) and kept (whether that is the document's own)."""
    base = written(signatures(docs, size, id_col, text_col))
    full = base.where("n > 0")
    first = lambda c: F.first(c).alias(c)
    classes = written(full.groupBy("node").agg(F.min("doc").alias("doc"), first("n"), first("a"), first("b"), first("sig")))
    found = buckets(classes)

    def texts(nodes: DataFrame) -> DataFrame:
        # copies are combined before the shuffle; both sides grow with the input: a shuffled join at every size
        wanted = nodes.select("node").distinct().hint("shuffle_merge")
        return full.groupBy("node").agg(first("packed")).join(wanted, "node")

    clusters = written(components(agreeing(stars(found), classes, threshold)))
    links = written(cluster_links(clusters, classes, texts, size, threshold))
    more = written(rest(found, classes, clusters, threshold))
    scratch = [base, classes, found, clusters, more, links]
    if not more.isEmpty():
        ends = more.select(F.col("a").alias("node")).union(more.select("b"))
        links = written(links.unionByName(confirmed(more, texts(ends), size, threshold)))
        scratch.append(links)
    named = components(links).join(classes.select("node", "doc"), "node")
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    group = named.join(least, "component").select("node", "least")
    own = classes.select("node", F.col("doc").alias("class_doc")).join(group, "node", "left")
    # written tables on both sides: a class of very many copies is a skewed partition that Spark can split, and all tables
    # that hold texts or signatures can go before the result is read
    own = written(own.select("node", F.coalesce("least", "class_doc").alias("least")))
    members = written(base.select("doc", "n", "node"))
    discard(*scratch)
    named = members.where("n > 0").join(own.hint("shuffle_merge"), "node").select("doc", "n", "least")
    empty = members.where("n = 0").select("doc", "n", F.col("doc").alias("least"))
    return (
        named.unionByName(empty)
        .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
