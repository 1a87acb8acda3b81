"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores one failure bit for each rule beside the
measurements. A policy is a named mask over those bits, so applying another version of it, or asking what
each rule of it costs (``ablation``), is arithmetic on stored bits and reads no text again.

Defined results: a null or empty text has no words and fails ``few_words``; a null id is kept as it is; repeated
rows each get their own row; other columns of the input are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, struct_of

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 5


class Rule(NamedTuple):
    bit: int
    name: str
    fails: Column | None = None


def rules() -> list[Rule]:
    """Every rule with its fixed bit; bits are never given to another rule."""
    n = F.col("n_words")
    return [
        Rule(0, "few_words", n < 10),
        Rule(1, "repeated_windows", 100 * F.col("n_repeat_words") > 20 * n),
        Rule(2, "symbols", 2 * F.col("n_symbols") > n),
        Rule(3, "repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule(4, "shouting", 10 * F.col("n_upper") > 6 * F.col("n_letters")),
        Rule(5, "short_words", F.col("word_chars") < 2 * n),
        Rule(6, "long_words", F.col("word_chars") > 15 * n),
        Rule(7, "many_words", n > 100_000),
    ]


#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "shouting", "short_words", "long_words"),
    "strict": ("few_words", "repeated_windows", "symbols", "repeated_lines", "shouting", "short_words", "long_words", "many_words"),
}

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
    "n_repeat_words long, n_upper long, n_letters long"
)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more in the text."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered = Counter(windows), bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered[i : i + WINDOW] = b"\1" * WINDOW
    return sum(covered)


def measure(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode()
    words = data.split()  # bytes split at exactly these six white-space characters
    lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
    without = lambda chars: len(data) - len(data.translate(None, chars))
    upper = without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return (
        len(words),
        len(text or "") - without(SPACES),
        without(SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        upper,
        upper + without(b"abcdefghijklmnopqrstuvwxyz"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements and ``fail_bits`` (bit b is set where the rule with that bit fails)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    measured = map_texts(
        docs, [id_col, text_col], lambda i, text: (i, *measure(text)), f"`{id_col}` {id_type}, {MEASURES}"
    )
    return measured.withColumn("fail_bits", fail_bits())


def fail_bits() -> Column:
    """One number with a bit for every rule, from the measurements."""
    bits = F.lit(0).cast("long")
    for rule in rules():
        bits = bits + F.when(rule.fails, F.lit(1 << rule.bit)).otherwise(0)
    return bits


def passing(docs: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that no rule of the policy rejects."""
    row = docs.select(F.struct(*docs.columns).alias("row"), struct_of(measure, MEASURES)(F.col(text_col)).alias("m"))
    judged = row.select("row", "m.*").withColumn("fail_bits", fail_bits())
    return judged.where(verdict(policy)).select("row.*")


def mask(policy: str) -> int:
    bit = {r.name: r.bit for r in rules()}
    return sum(1 << bit[name] for name in POLICIES[policy])


def verdict(policy: str, bits: str = "fail_bits") -> Column:
    """True where no rule of the policy fails."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(kept: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only it rejects (they would come back
    without it). One aggregation over the stored bits; each task sends a single row."""
    m, chosen = mask(policy), [r for r in rules() if r.name in POLICIES[policy]]
    one = kept.agg(
        F.count_if(~verdict(policy)).alias("rejected"),
        *[F.count_if(F.col("fail_bits").bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"failed_{r.bit}") for r in chosen],
        *[F.count_if(F.col("fail_bits").bitwiseAND(F.lit(m)) == (1 << r.bit)).alias(f"only_{r.bit}") for r in chosen],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.col(f"failed_{r.bit}").alias("n_failed"),
                F.col(f"only_{r.bit}").alias("n_only"),
                (F.col("rejected") - F.col(f"only_{r.bit}")).alias("rejected_without"),
            )
            for r in chosen
        ]
    )
    return one.select(F.inline(rows))
