"""Periodic runs, divergence of sources and token files against brute-force versions, and their edge cases."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tagloom.llm import binary, divergence, periods, queries
from tagloom.llm.common import written
from tagloom.llm.oracles import ORACLE_SQL

from .test_text_operators import ODD, collected, made_up, table

DATA = "/root/testdata/sf0.001"
generated = pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated data here")


@pytest.fixture
def as_input(spark, tmp_path):
    def save(rows):
        table(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return save


# ---------------------------------------------------------------- periodic runs
def slow_runs(words):
    """Every period against every place."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rnd):
    """Words of a small alphabet with periodic stretches, whose periods may be nearly periodic themselves."""
    n, letters, kind = rnd.choice([0, 5, 23, 24, 25, 60, 150, 400]), rnd.choice([1, 2, 2, 3, 10]), rnd.randrange(5)
    words = [b"%d" % rnd.randrange(letters) for _ in range(n)]
    for _ in range(rnd.randrange(1, 4) if kind and n else 0):
        p, start = rnd.choice([1, 2, 3, 5, 8, 9, 12, 15, 16, 17, 31, 40]), rnd.randrange(n)
        base = [b"%d" % rnd.randrange(letters) for _ in range(p)]
        if kind == 2:
            base = [base[i % min(p, 3)] for i in range(p)]
            base[rnd.randrange(p)] = b"x"
        if kind == 3:
            base = [b"0"] * (p - 1) + [b"1"]
        for i in range(start, min(n, start + p * rnd.randrange(2, 9) + rnd.randrange(p))):
            words[i] = base[(i - start) % p]
    return words


def test_runs_against_every_period():
    for seed in range(500):
        rnd = random.Random(seed)
        texts = [repetitive(rnd) for _ in range(rnd.randrange(1, 5))]
        assert periods.find_runs(texts) == [slow_runs(w) for w in texts]


def test_runs_of_long_repetitions():
    """One word, a period of nearly one word, and a text of many copies: time stays near linear."""
    one, nearly = [b"a"] * 60_000, ([b"a"] * 999 + [b"b"]) * 60
    copies = [b"%d" % (k % 7919) for k in range(60_000)]
    assert periods.find_runs([one, nearly, copies]) == [
        [(0, 60_000, 1)],
        sorted([(0, 60_000, 1000), *((1000 * k, 999, 1) for k in range(60))], key=lambda r: (r[0], r[2])),
        [(0, 60_000, 7919)],
    ]


def test_wavelet_matrix():
    rnd = np.random.default_rng(1)
    values = rnd.permutation(1000)[:777]
    matrix = periods.WaveletMatrix(values, 10)
    lo = rnd.integers(0, 777, 300)
    hi = np.minimum(777, lo + rnd.integers(1, 200, 300))
    bound = rnd.integers(0, 1100, 300)
    assert matrix.less(lo, hi, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, bound)]
    k = rnd.integers(0, hi - lo)
    assert matrix.kth(lo, hi, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo, hi, k)]


def expected_digest(name, text):
    words = (text or "").encode().split()
    h, n = (zlib.crc32(str(name).encode()) if name is not None else 1), len(words)
    if h % 10 == 0 and n:
        a, original = h // 10 % n, list(words)
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [original[a + (i - a) % p] if i >= a else original[i] for i in range(n)]
    found = slow_runs(words)
    best = max(found, key=lambda r: (1000000 * r[1] // r[2], -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digests = ("".join(f"{s},{m},{q}\n" for s, m, q in found).encode(), b" ".join(kept))
    return (name, len(found), *shown, *(hashlib.sha256(d).hexdigest() for d in digests))


def test_period_query(spark, as_input):
    rows = [r for r in ODD if len(r[1] or "") < 10_000] + [(k + 100, t) for k, (_, t) in enumerate(made_up(5, 150))] + [(400, "a b " * 30), (400, "a b " * 30)]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i)
    found = queries.op11_periods(spark, as_input(rows))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(expected_digest(*r)) for r in rows)


@generated
def test_period_query_on_generated_texts(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("length(text) < 8000").collect()
    found = {r.doc_id: tuple(r) for r in queries.op11_periods(spark, DATA).collect()}
    assert any(r[1] for r in found.values())
    for r in texts:
        assert found[r.doc_id] == expected_digest(*r)


def test_runs_operator(spark):
    rows = collected(periods.runs(table(spark, [(1, "x " + "go home now " * 10 + "then"), (2, None)])))
    assert [r.asDict() for r in rows[0]["runs"]] == [{"start": 1, "length": 30, "period": 3}]
    assert rows[0]["collapsed"] == "x go home now then" and rows[1]["collapsed"] == "" and rows[1]["runs"] == []
    assert periods.runs(table(spark, [])).collect() == []


# ---------------------------------------------------------------- divergence of sources
def slow_audit(rows, least, top):
    """(lang, source, part, item, value, rank) from plain dictionaries; rows are (lang, source, text)."""
    import re

    counts, in_docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        sources[lang].add(source)
        counts[lang, source].update(words)
        in_docs[lang].update(set(words))
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        total = Counter()
        for s in own:
            total.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in own}, share(total)
        for s in own:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own - {s}]
            term = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


def spread(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{'abcdefghij'[k % 10]}{'xyz' * (k // 10)}" for k in range(60)] + ["Été", "日本", "The"]
    rows = []
    for _ in range(n):
        lang, source = rnd.choice(["en", "en", "en", "de", None]), f"s{min(int(rnd.expovariate(0.5)), 6)}"
        shift = int(source[1:]) * 7
        rows.append((lang, source, " ".join(vocabulary[min(62, int(rnd.expovariate(0.08)) + shift) % 63] for _ in range(rnd.randrange(40)))))
    return rows + [("xx", "lonely", "few words"), ("yy", "a", None), ("yy", None, ""), ("yy", "b", "alone"), ("en", "quiet", " 12 ")]


def audited(spark, rows, **how):
    docs = spark.createDataFrame([(k, *r, "c", 1) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n long")
    return sorted(map(tuple, divergence.audit(docs, **how).collect()))


def test_divergence_against_dictionaries(spark, monkeypatch):
    rows = spread(3, 400)
    want = slow_audit(rows, 30, 5)
    assert {r[2] for r in want} == {"pair", "term"} and audited(spark, rows, least=30, top=5) == want
    assert audited(spark, rows[:60], least=2, top=50) == slow_audit(rows[:60], 2, 50)
    monkeypatch.setattr(divergence, "HELD", 20)  # counts are handed on in many parts
    assert audited(spark, rows[:60], least=2, top=50) == slow_audit(rows[:60], 2, 50)
    assert audited(spark, []) == []


def test_tiles_and_blocks_make_every_joint_table(spark, monkeypatch):
    rows = spread(4, 200)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    kept = written(divergence.kept_terms(divergence.partial_counts(docs), 3))
    groups = written(divergence.groups_of(docs, kept))
    levels = divergence.level_rows(kept, groups)
    names = {r.lang: r.s for r in groups.groupBy("lang").agg({"source": "collect_list"}).toDF("lang", "s").collect()}
    want = Counter()
    for r in kept.collect():
        of = {c.source: c.n for c in r.cells}
        own = [of.get(s, 0) for s in sorted(names[r.lang])]
        want.update((r.lang, a, b, own[a], own[b]) for b in range(len(own)) for a in range(b))
    found = lambda: Counter({tuple(r)[:5]: r.n for r in divergence.joint_tables(levels).collect()})
    assert found() == want
    with monkeypatch.context() as m:
        m.setattr(divergence, "TILE", 2)
        m.setattr(divergence, "TERMS", 5)
        assert found() == want
        small = audited(spark, rows, least=3, top=9)
    assert audited(spark, rows, least=3, top=9) == small == slow_audit(rows, 3, 9)


def test_shares_are_exact_beyond_long(spark):
    big = spark.createDataFrame([(5_000_000_000_000, 9_000_000_000_000_000, 40_000_000)], "n long, size long, v long")
    assert big.select(divergence.share("n", "size", "v")).first()[0] == 1 + 10**9 * (5 * 10**12 + 5) // (9 * 10**15 + 5 * 4 * 10**7)


@generated
def test_divergence_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    sql = ORACLE_SQL["op12_divergence"]
    found = queries.op12_divergence(spark, DATA)
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(want.fetchall())


# ---------------------------------------------------------------- token files
def test_bits_and_sequences():
    rnd = random.Random(2)
    for n, most in ((0, 1), (1, 0), (1, 2**63), (5, 3), (1000, 10**6), (3000, 2**64 - 1), (700, 50), (2000, 2**40)):
        values = np.array(sorted(rnd.randrange(most + 1) for _ in range(n)), np.uint64)
        made = binary.EliasFano.of(values)
        read = binary.EliasFano.from_bytes(made.to_bytes() + b"more")
        assert [read[i] for i in range(n)] == values.tolist()
        for _ in range(20):
            a = rnd.randrange(n + 1)
            b = rnd.randrange(a, n + 1)
            assert read.part(a, b - a).tolist() == values[a:b].tolist()
        if n >= 700:  # near log2(u / n) + 2 bits for each
            assert len(made.to_bytes()) * 8 <= n * (max(0.0, np.log2(max(most, n) / n)) + 3) + 600


def expected_files(rows):
    """From the library's own encoding of every whole text, one after the other."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer(queries.TOKENIZER_FILE)[0])
    tokenizer.encode_special_tokens = True
    tie = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))  # noqa: E731  Spark's hash
    made = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), tie(t)) for i, t in rows]
    made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    out, start = [], 0
    for i, ids, _ in made:
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


SPACES = [
    (-5, "ends in space "), (-(2**62), "  two  and   three \n\n new \n"), (2**62, "<|endoftext|> as text <|endoftext|>"), (50, " 　wide   x"),
    (51, "tab\t and em    mixed "), (52, "it's we'll 123 4567 日本語 🙂 x" + "y" * 300), (52, "other"), (None, "z"), (None, None),
]


def test_file_query(spark, as_input):
    rows = ODD + SPACES + [(k + 100, t) for k, (_, t) in enumerate(made_up(6, 120))]
    assert sorted(map(repr, map(tuple, queries.op13_binary(spark, as_input(rows)).collect()))) == sorted(map(repr, expected_files(rows)))


@generated
def test_file_query_on_generated_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_binary(spark, DATA).collect())) == expected_files(rows)


def test_many_files_and_single_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "CHUNKS", 50)
    monkeypatch.setattr(binary, "TOGETHER", 7)
    rows = ODD + [(k, t) for k, (_, t) in enumerate(made_up(7, 90))]
    path = queries.tokenizer(queries.TOKENIZER_FILE)[0]
    manifest = binary.token_files(table(spark, rows), path, str(tmp_path), file_ids=500)
    files = manifest.orderBy("base").collect()
    want = expected_files(rows)
    assert len(files) > 15 and len(os.listdir(tmp_path)) == len(files)  # nothing else is left
    assert sorted(map(repr, map(tuple, binary.read_files(manifest).collect()))) == sorted(map(repr, want))
    at = 0
    for f in files:
        tokens = binary.TokenFile(f.path)
        assert tokens.n == f.n_docs and tokens.n_ids == f.n_ids and tokens.width == 2
        for i in (0, tokens.n // 2, tokens.n - 1):
            name, start, n, crc = want[at + i]
            ids = tokens.document(i)
            assert (tokens.names(i, 1)[0], f.base + tokens.bounds[i], len(ids), zlib.crc32(ids.astype("<u4"))) == (name, start, n, crc)
        at += tokens.n
    monkeypatch.setattr(binary, "READ_IDS", 7)
    last = binary.TokenFile(files[-1].path)
    assert last.crcs(last.bounds.part(0, last.n + 1).tolist()) == [r[3] for r in want[len(want) - last.n :]]


def test_no_documents_and_other_names(spark, tmp_path):
    path = queries.tokenizer(queries.TOKENIZER_FILE)[0]
    assert binary.read_files(binary.token_files(table(spark, []), path, str(tmp_path))).collect() == []
    with pytest.raises(ValueError, match="whole number"):
        binary.token_files(table(spark, []), path, id_col="lang")
    with pytest.raises(ValueError, match="no token ids"):
        (tmp_path / "x").write_bytes(b"y" * 100)
        binary.TokenFile(str(tmp_path / "x"))
