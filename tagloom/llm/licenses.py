"""Licence scans with a positional index of rare words, in DataFrame functions only.

Each template is a run of words with mandatory key phrases. The index holds, for the words with the highest inverse
document frequency among the templates' key phrases, their postings (template, position), as two map literals: one of the
rarest word of each template, one of the next. A file's index words are looked up; each posting proposes the place where
its template would start, as one number of template and place, and the proposals of both maps are intersected. The words
at a candidate are then compared with the template: the mandatory phrases must stand there word for word, and the share
of equal words must reach the template's limit.

Index words are taken from the mandatory phrases, so the look-up loses no match. All work is within a row: nothing is
shuffled, collected or capped, files without any index word cost one set look-up per word, and the expression does not
grow with the number of templates, only its literals do.

Defined results: null and empty texts have no words, no places and no labels; repeated rows get a row each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: One word of lower-cased text: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A candidate is a number: the template times this, and its first word beyond a margin longer than any template.
SPAN, MARGIN = 1 << 32, 1 << 12


class Template(NamedTuple):
    label: str
    text: str
    #: Key phrases that must stand at their places, of two words at least in all.
    keys: tuple[str, ...]
    #: Share of the words that must be equal.
    limit: float = 0.8
    base: bool = False


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _template(label: str, text: str, *keys: str, limit: float = 0.8, base: bool = False) -> Template:
    words = " ".join(_words(text))
    return Template(label, words, tuple(" ".join(_words(k)) for k in keys) or (words,), limit, base)


#: Base phrases stand for themselves; the others are well-known names, notices and terms in the words of the licences.
TEMPLATES = (
    _template("cc-by", "cc by", limit=1.0, base=True),
    _template("gpl", "general public license", limit=1.0, base=True),
    _template("reserved", "all rights reserved", limit=1.0, base=True),
    _template("agpl", "GNU Affero General Public License", "Affero General Public License"),
    _template("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License"),
    _template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "source and binary forms"),
    _template("cc-by-nc", "cc by nc", limit=1.0),
    _template("cc-by-nd", "cc by nd", limit=1.0),
    _template("cc-by-sa", "cc by sa", limit=1.0),
    _template("cc0", "To the extent possible under law, the author has waived all copyright", "extent possible under law"),
    _template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    _template("lgpl", "GNU Lesser General Public License", "Lesser General Public License"),
    _template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "hereby granted, free of charge"),
    _template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License", "Mozilla Public License"),
    _template("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _template(
        "apache-2.0-notice",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied.""",
        "in compliance with the License", "apache org licenses", "WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    _template(
        "mit-terms",
        """to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software.""",
        "deal in the Software without restriction", "all copies or substantial portions of the Software",
    ),
    _template(
        "bsd-terms",
        """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        "Redistributions of source code", "Redistributions in binary form", "following disclaimer in the documentation",
    ),
    _template(
        "gpl-notice",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
        "redistribute it and/or modify it", "Free Software Foundation", limit=0.75,
    ),
    _template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.""",
        "express or implied warranty", "authors be held liable",
    ),
    _template(
        "boost",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license""",
        "person or organization obtaining a copy", "accompanying documentation",
    ),
    _template(
        "epl-2.0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0""",
        "accompanying materials", "Eclipse Public License",
    ),
)


def idf(templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of each word among the templates."""
    df = Counter(w for t in templates for w in set(t.text.split()))
    return {w: math.log(len(templates) / n) for w, n in df.items()}


def key_positions(t: Template) -> list[int]:
    """Places of the words of the key phrases in their template, each phrase where it first stands."""
    words, out = t.text.split(), []
    for key in map(str.split, t.keys):
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out += range(at, at + len(key))
    return sorted(set(out))


def index(templates: tuple[Template, ...] = TEMPLATES) -> list[dict[str, list[tuple[int, int]]]]:
    """Two maps from words to postings (template, position): of each template's rarest key word, and of the next one;
    ties go to the first in the template."""
    weight = idf(templates)
    maps: list[dict[str, list[tuple[int, int]]]] = [defaultdict(list), defaultdict(list)]
    for k, t in enumerate(templates):
        words = t.text.split()
        rarest = sorted(key_positions(t), key=lambda i: (-weight[words[i]], i))
        for postings, i in zip(maps, rarest, strict=False):
            postings[words[i]].append((k, i))
    return maps


def _literal(values: list) -> Column:
    return F.array(*map(F.lit, values))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """id, n_words and ``places``: every verified place as struct (t: number of the template, first: its first word,
    counted from 0, share: of equal words)."""
    maps = index(templates)
    rare = sorted(set().union(*maps))
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    words = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda h: h["w"].isin(rare))
    looked = words.withColumn("hits", F.when(F.arrays_overlap("words", _literal(rare)), hits))

    def proposed(postings: dict[str, list[tuple[int, int]]]) -> Column:
        offsets = {w: _literal([k * SPAN + MARGIN - i for k, i in p]) for w, p in postings.items()}
        table = F.create_map(*[c for w, p in offsets.items() for c in (F.lit(w), p)])
        return F.flatten(
            F.transform(
                F.filter("hits", lambda h: h["w"].isin(list(postings))),
                lambda h: F.transform(F.element_at(table, h["w"]), lambda offset: offset + h["at"]),
            )
        )

    bodies = F.array(*[_literal(t.text.split()) for t in templates])
    keys = F.array(*[_literal(key_positions(t)) for t in templates])
    limits = _literal([t.limit for t in templates])

    def place(candidate: Column) -> Column:
        t = F.shiftright(candidate, 32).cast("int")
        first = (candidate.bitwiseAND(F.lit(SPAN - 1)) - F.lit(MARGIN)).cast("int")
        return F.struct(t.alias("t"), first.alias("first"))

    def stands(p: Column) -> Column:
        body = F.element_at(bodies, p["t"] + 1)
        return (p["first"] >= 0) & F.forall(
            F.element_at(keys, p["t"] + 1), lambda i: F.get("words", p["first"] + i).eqNullSafe(F.element_at(body, i + 1))
        )

    def measured(p: Column) -> Column:
        body = F.element_at(bodies, p["t"] + 1)
        equal = F.zip_with(F.slice("words", p["first"] + 1, F.size(body)), body, lambda a, b: F.when(a.eqNullSafe(b), 1).otherwise(0))
        share = F.aggregate(equal, F.lit(0), lambda n, x: n + x) / F.size(body).cast("double")
        return F.struct(p["t"].alias("t"), p["first"].alias("first"), share.alias("share"))

    both = F.array_intersect(proposed(maps[0]), proposed(maps[1]))
    found = F.filter(F.transform(F.filter(F.transform(both, place), stands), measured), lambda p: p["share"] >= F.element_at(limits, p["t"] + 1))
    none = F.array().cast("array<struct<t:int,first:int,share:double>>")
    return looked.select(
        F.col("id").alias(id_col),
        F.size("words").cast("long").alias("n_words"),
        F.when(F.col("hits").isNotNull(), found).otherwise(none).alias("places"),
    )


def labelled(found: DataFrame, id_col: str = "doc_id", templates=TEMPLATES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score (the largest share, 0 without places)."""
    names = _literal([t.label for t in templates])
    is_base = [k for k, t in enumerate(templates) if t.base]
    base = F.filter("places", lambda p: p["t"].isin(is_base))

    def labels(places) -> Column:
        return F.array_join(
            F.array_sort(F.array_distinct(F.transform(places, lambda p: F.element_at(names, p["t"] + 1)))), ","
        )

    return found.withColumn("base", base).select(
        id_col,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["first"])).cast("long").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
