"""Every stage of the pipeline against a brute-force version of its own input."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline as P
from tagloom.llm.queries import tokenizer
from tests.llm.test_text_operators import made_up, slow_components, slow_removal

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_quality(text):
    """Whether a text passes the rules of the policy, from their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words), sum(map(len, words))
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    often = {w for w, k in Counter(windows).items() if k > 1}
    repeated = len({i + k for i, w in enumerate(windows) if w in often for k in range(5)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    fails = (
        n < 10, 100 * repeated > 20 * n, 2 * len(re.findall(r"[#*$%&|<>]", text)) > n, 2 * (len(lines) - len(set(lines))) > len(lines),
        10 * upper > 6 * letters, chars < 2 * n, chars > 15 * n,
    )
    return not any(fails)


def slow_contaminated(text, items):
    """The contract's rule, by looking for every window of every item at every word."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    words, hit = split(text), set()
    for item in map(split, items):
        for k in range(max(1, len(item) - 12) if item else 0):
            window = item[k : k + 13]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
    return bool(hit) and 20 * len(hit) >= len(words)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_stages(spark, tmp_path):
    import tiktoken

    from tagloom.llm import bpe

    rows = made_up(11, 160) + [(800, None), (801, "junk### " * 30), (802, "short"), (803, "SHOUTING WORDS " * 4 + "ALL DAY LONG IN EVERY SINGLE LINE")]
    rnd = random.Random(4)
    item = " ".join(f"bench{k}" for k in range(40))
    rows += [(900 + k, item if k < 2 else " ".join(rnd.choice(["alpha", "beta", f"g{k}", f"h{n}"]) for n in range(80))) for k in range(6)]
    rows += [(910, " ".join(f"own{n}" for n in range(900)) + " " + item), (911, " ".join(f"more{n}" for n in range(700)) + " " + item), (912, " ".join(f"z{n}" for n in range(30_000)))]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = at.columns
    path, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.vocabulary(path).ranks, special_tokens={})
    for name, stage in P.STAGES:
        given = {r["doc_id"]: r["text"] for r in at.collect()}
        out = stage(spark, at, str(tmp_path)).cache()
        got = {r["doc_id"]: r for r in out.collect()}
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        if name == "quality_rules":
            assert got.keys() == {i for i, t in given.items() if slow_quality(t)} and {802, 801, 800, 803}.isdisjoint(got)
        elif name == "near_duplicates":
            want = slow_components(list(given.items()), 5)
            assert got.keys() == {i for i, (_, c) in want.items() if i == c}
        elif name == "repeated_passages":
            want = slow_removal(list(given.items()))
            assert {i: r["text"] for i, r in got.items()} == {i: b.decode("utf-8", "ignore") for i, b in want.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        elif name == "benchmark_passages":
            assert got.keys() == {i for i, t in given.items() if not slow_contaminated(t, [item])}
            assert 900 in given and 900 not in got and 910 in got
        else:
            assert got.keys() == given.keys()
            for i, r in got.items():
                ids = library.encode_ordinary(given[i])
                assert r["ids"] == ids and r["n_tokens"] == len(ids)
                assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(given[i].encode()).hexdigest()
        at = out
    assert P.run(spark, str(tmp_path)).count() == at.count()


def test_stages_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, null, empty and very long texts; and a table without rows."""
    fine = " ".join(f"word{k}" for k in range(40))
    rows = [(None, fine), (1, fine + " more"), (1, fine + " more"), (2, None), (3, ""), (4, "x " * 50_000), (5, " ".join(f"long{k}" for k in range(60_000))), (None, None), (1, " ".join(f"else{k}" for k in range(50)))]
    spark.createDataFrame([(1, "bench")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (rows, []):
        at = documents(spark, given)
        kept = {}
        for name, stage in P.STAGES:
            at = stage(spark, at, str(tmp_path)).cache()
            kept[name] = sorted((repr(r["doc_id"]) for r in at.collect()))
        if not given:
            assert not any(kept.values())
            continue
        assert kept["quality_rules"] == ["1", "1", "1", "5", "None"]
        assert kept["near_duplicates"] == ["1", "1", "5"] == kept["repeated_passages"] == kept["benchmark_passages"] == kept["tokens"]


def test_ledger_and_ablations(spark, tmp_path):
    rows = [(1, "a b"), (2, "### " * 20), (3, " ".join(f"fine{k}" for k in range(20))), (4, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    ledger = P.rule_ledger(spark, str(tmp_path))
    assert {r["doc_id"]: r["fail_bits"] == 0 for r in ledger.collect()} == {1: False, 2: False, 3: True, 4: False}
    found = {r["rule"]: r for r in P.rule_ablation(spark, str(tmp_path)).collect()}
    assert found["few_words"]["n_failed"] == 2 and found["shouting"]["n_only"] == 0


def test_one_row_of_each_group_survives(spark):
    text = {k: " ".join(f"{k}{n}" for n in range(60)) for k in "abcdef"}
    near = {k: v.rsplit(" ", 1)[0] + " end" for k, v in text.items()}
    rows = [
        (None, near["a"], "-"), (5, text["a"], "kept"), (6, near["a"], "-"),  # a named document before one without id
        (None, text["b"], "kept"),  # alone and without id
        (None, text["c"], "one of c"), (None, near["c"], "one of c"), (None, text["c"], "one of c"),
        (7, text["d"], "one of d"), (7, text["d"], "one of d"), (7, near["d"], "one of d"),
        (5, text["e"], "-"), (3, near["e"], "kept"),  # the id 5 is kept for another text
        (None, text["f"], "-"), (9, near["f"], "kept"), (9, None, "kept"), (None, " ", "kept"), (None, None, "kept"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number string").repartition(3)
    out = P.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    want = [r[2] for r in rows if r[2] == "kept"] + ["one of c", "one of d"]
    assert sorted(r["number"] for r in out.collect()) == sorted(want)
