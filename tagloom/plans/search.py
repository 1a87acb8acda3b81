"""Searches over tags, words of documentation pages, roles and suggestions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import contains, required, sorted_page, starts_with
from .keys import Tables

#: More hits than this are no useful answer.
MOST_HITS = 1_000_000
_SPEC = {"count_all": [], "key": [], "value": []}


def tokens(text: str) -> list[str]:
    """Words of a search text, as the index has them; ``\\w`` without the underscore is a letter or digit."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _hits(t: Tables, field: str | None, text: str) -> DataFrame:
    """Tags whose field holds all words of the text, or in quotes the words one after the other.

    The postings of each word are found by the word, so stored ones are read from the buckets of these words alone.
    Positions relative to the word's place in the phrase are equal where the phrase stands, so one aggregation decides. A
    hit needs as many different words as there are.
    """
    words, postings = tokens(text), t["search_postings"]
    phrase = len(text) > 1 and text[0] == text[-1] == '"'
    if not words:
        return postings.where("false").select("key", "value", "count_all").distinct()
    rows = postings.where(F.col("token").isin(*set(words)))
    if field:
        rows = rows.where(F.col("field") == field)
    if phrase:
        places = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(words)])
        rows = rows.withColumn("p", F.explode(F.filter(places, lambda p: p["w"] == F.col("token")))).withColumn("pos", F.explode("positions"))
        by = ["field", F.col("pos") - F.col("p.i")]
        enough = F.countDistinct("p.i") == len(words)
    else:
        by, enough = ([F.col("field")] if field else []), F.countDistinct("token") == len(set(words))
    return rows.groupBy("key", "value", "count_all", *by).agg(enough.alias("ok")).where("ok").select("key", "value", "count_all").distinct()


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """The rows, or none if they are more than ``most``. Only a count is looked at."""
    few = rows.limit(most + 1).agg((F.count("*") <= most).alias("few"))
    return rows.crossJoin(F.broadcast(few)).where("few").drop("few")


def by_key_and_value(t: Tables, query: str, sort=None, order="desc", page=None, rp=None, most: int = MOST_HITS) -> DataFrame:
    """Tags by words of the key, of the value (``=value``), of each (``key=value``) or of any of them."""
    required(query=query)
    if "=" in query:
        key, _, value = query.partition("=")
        parts = [_hits(t, f, x) for f, x in (("key", key), ("value", value)) if x]
        rows = parts[0] if parts else _hits(t, None, "")
        for other in parts[1:]:
            rows = rows.join(other, ["key", "value", "count_all"], "left_semi")
    else:
        rows = _hits(t, None, query)
    return sorted_page(_bounded(rows, most), _SPEC, sort, order, page, rp)


def by_value(t: Tables, query: str, sort=None, order="desc", page=None, rp=None) -> DataFrame:
    """Tags by words of the value."""
    return sorted_page(_hits(t, "value", query or ""), _SPEC, sort, order, page, rp)


#: Characters of the strings that stored words are found by.
GRAM = 3


def by_keyword(t: Tables, query: str, sort=None, order="asc", page=None, rp=None) -> DataFrame:
    """Keys and tags whose documentation has the text in its words. Where grams of the words are stored, only the keys and
    tags that have all grams of the text are looked at."""
    required(query=query)
    text, words = query.lower(), t["words"]
    if len(text) >= GRAM and "word_grams" in getattr(t, "prepared", ()):
        grams = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
        found = t["word_grams"].where(F.col("gram").isin(*grams)).groupBy("key", "value").agg(F.count("*").alias("n"))
        words = words.join(found.where(F.col("n") == len(grams)).drop("n"), ["key", "value"], "left_semi")
    rows = words.where(F.array_join("words", ",").contains(text)).select("key", F.nullif("value", F.lit("")).alias("value"))
    return sorted_page(rows, {"key": [], "value": []}, sort, order, page, rp)


def by_role(t: Tables, query: str, sort=None, order="desc", page=None, rp=None) -> DataFrame:
    """Roles that contain the text."""
    required(query=query)
    rows = t["relation_roles"].where(contains("role", query)).select("rtype", "role", "count_all")
    return sorted_page(rows, {"count_all": [], "rtype": [], "role": []}, sort, order, page, rp)


def suggest(t: Tables, term: str, k: int = 10) -> DataFrame:
    """The best completions of ``key``, ``key=value`` or ``=value``; a plain term completes keys only."""
    key, sign, value = term.partition("=")
    rows = t["suggestions"]
    if not sign:
        rows = rows.where(F.col("value").isNull() & starts_with("key", key))
    else:
        rows = rows.where(starts_with("value", value))
        rows = rows.where(starts_with("key", key)) if key else rows
    return rows.select("key", "value", "score").orderBy(F.desc("score"), "key", "value").limit(k)
