"""License scan by a positional index of rare words.

Templates are standing passages of licences, several for each of the common ones. Every template has key phrases
that a finding must hold, and the index holds the rarest words of those phrases, by their frequency in all
documents, with their places in the template. A file looks its own words up there; each hit proposes ``file
place - template place`` as the template's start, and a start on which all of a template's indexed words
agree is a candidate. It is a finding if the key phrases stand where that start says.

A file that holds a template's key phrases holds all of its indexed words, whichever these are. So corpus
counts decide how few places are looked at, and never what is found: labels of a text do not depend on
other texts. Templates are fixed and few, so the index is a literal in the plan; everything else is by row
and no row is shuffled.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.registry import query, stored, table
from demur.session import str_lit


class Template(NamedTuple):
    """``keys``: phrases of the text that have to stand at their places."""

    label: str
    text: str
    keys: tuple[str, ...]


# standing passages of common licences (fixed values)
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files the software to deal in the software without restriction",
        ("hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind",
        ("required by applicable law", "without warranties or conditions of any kind"),
    ),
    Template(
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license version 3",),
    ),
    Template(
        "gpl",
        "you can redistribute it and or modify it under the terms of the gnu general public license as"
        " published by the free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    Template(
        "lgpl",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        ("gnu affero general public license",),
    ),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template(
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "mpl-2.0",
        "subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is"
        " hereby granted",
        ("for any purpose with or without fee",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("unencumbered software released into the public domain",),
    ),
    Template(
        "mit",
        "the above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the software",
        ("shall be included in all copies or substantial portions of the software",),
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0",
        ("www apache org licenses license 2 0",),
    ),
    Template(
        "apache-2.0",
        "see the license for the specific language governing permissions and limitations under the license",
        ("language governing permissions and limitations under the license",),
    ),
    Template(
        "gpl-2.0",
        "this work is licensed under the gnu general public license version 2",
        ("gnu general public license version 2",),
    ),
    Template(
        "gpl-family",
        "this program is distributed in the hope that it will be useful but without any warranty without even the"
        " implied warranty of merchantability or fitness for a particular purpose see the gnu",
        ("in the hope that it will be useful but without any warranty", "fitness for a particular purpose see the gnu"),
    ),
    Template(
        "gpl-family",
        "either version 3 of the license or at your option any later version",
        ("of the license or at your option any later version",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms are permitted",),
    ),
    Template(
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer",
        ("redistributions of source code must retain the above copyright notice",),
    ),
    Template(
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistributions in binary form must reproduce the above copyright notice",),
    ),
    Template(
        "bsd-3-clause",
        "contributors may be used to endorse or promote products derived from this software without specific prior"
        " written permission",
        ("endorse or promote products derived from this software without specific prior written permission",),
    ),
    Template(
        "isc",
        "provided that the above copyright notice and this permission notice appear in all copies the software is"
        " provided as is and the author disclaims all warranties with regard to this software",
        ("this permission notice appear in all copies", "disclaims all warranties with regard to this software"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held"
        " liable for any damages arising from the use of this software",
        ("authors be held liable for any damages arising from the use of this software",),
    ),
    Template(
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"
        " and accompanying documentation covered by this license",
        ("person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    ),
    Template(
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        ("eclipse public license",),
    ),
    Template(
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights",
        ("waived all copyright and related or neighboring rights",),
    ),
    Template("spdx-mit", "spdx license identifier mit", ("license identifier mit",)),
    Template("spdx-apache-2.0", "spdx license identifier apache 2 0", ("identifier apache 2 0",)),
)
# phrases that count wherever they stand, with their labels (fixed values)
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# rarest words of a template's key phrases that the index holds
RARE_BY_TEMPLATE = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"
VOCABULARY = sorted({w for p in (*(k for t in TEMPLATES for k in t.keys), *(p for p, _ in BASE_PHRASES)) for w in p.split()})
# every phrase, and a key of every template, has one of these words (asserted below)
SIGNS = (
    "license", "hereby", "applicable", "cc", "commons", "redistribution", "redistributions", "mozilla", "fee", "unencumbered",
    "identifier", "substantial", "gnu", "endorse", "disclaims", "liable", "waived",
)


def _list(words) -> str:
    return "array(" + ", ".join(str_lit(w) for w in words) + ")"


def scan_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_words, w, licence_words``: the words themselves only of texts that need a look.

    A text needs a look if one of ``SIGNS`` is among its words; without them no phrase can be there, and
    of every template a key is missing. Null is an empty text.
    """
    text = F.expr(f"translate(coalesce(cast(`{text_col}` as string), ''), '{UPPER}', '{LOWER}')")
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    df = df.withColumn("w", F.expr(f"regexp_extract_all(t, '{WORD}', 0)"))
    licence_words = f"array_intersect({_list(VOCABULARY)}, w)"
    return df.select(
        "doc_id",
        F.expr("cast(size(w) as bigint) as n_words"),
        F.expr(f"if(arrays_overlap({licence_words}, {_list(SIGNS)}), w, null) as w"),
        F.expr(f"{licence_words} as licence_words"),
    )


def word_weights(words: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every licence word over all rows; the vocabulary bounds the result."""
    counted = words.select(F.explode("licence_words").alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counted}
    n = words.count()
    return {w: math.log((1 + n) / (1 + found.get(w, 0))) for w in VOCABULARY}


def _key_places(t: Template) -> list[int]:
    """First place of each key phrase in a template."""
    text = t.text.split()
    return [next(i for i in range(len(text)) if text[i : i + len(k.split())] == k.split()) for k in t.keys]


def _index(weights: dict[str, float]) -> list[tuple[Template, list[tuple[str, int]]]]:
    """For every template the rarest words of its key phrases, with their places."""
    out = []
    for t in TEMPLATES:
        at: dict[str, int] = {}
        for key, place in zip(t.keys, _key_places(t)):
            for i, w in enumerate(key.split()):
                at.setdefault(w, place + i)
        rare = sorted(at, key=lambda w: (-weights[w], w))[:RARE_BY_TEMPLATE]
        out.append((t, [(w, at[w]) for w in rare]))
    return out


def _places(phrase: str) -> str:
    """Starts of a phrase among the words ``w``."""
    first, *rest = phrase.split()
    more = "".join(f" and w[i + {k}] = {str_lit(x)}" for k, x in enumerate(rest, 1))
    last = len(rest)
    return f"filter(transform(w, (x, i) -> if(x = {str_lit(first)} and i + {last} < size(w){more}, i, null)), i -> i is not null)"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found`` for every row.

    ``n_base`` and the two places are those of ``BASE_PHRASES`` (null where there is none). ``labels`` has
    the labels of the phrases and of the templates found, sorted; ``score`` is the best share of a found
    template's words that stand in place, 0.6 at least for a bare phrase and 0 for nothing. ``found`` lists
    ``(label, start, share)``. Null and empty texts have no word; repeated rows are scanned one by one;
    other columns of the input are not carried.
    """
    words = stored(scan_words(docs, id_col, text_col), "words")
    index = _index(word_weights(words))
    df = words
    for k, (phrase, _) in enumerate(BASE_PHRASES):
        df = df.withColumn(f"b{k}", F.expr(f"if(w is null, cast(array() as array<int>), {_places(phrase)})"))
    # every (rare word, place in its template) proposes starts; equal starts are counted
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, (_, rare) in enumerate(index):
        for word, at in rare:
            postings.setdefault(word, []).append((k, at))
    cases = " ".join(
        f"when {str_lit(word)} then array("
        + ", ".join(f"named_struct('k', {k}, 's', i - {at})" for k, at in spots)
        + ")"
        for word, spots in sorted(postings.items())
    )
    rare_words = _list(sorted(postings))
    df = df.withColumn(
        "v",
        F.expr(
            f"if(w is null, null, sort_array(flatten(filter(transform(w, (x, i) -> if(array_contains({rare_words}, x), "
            f"case x {cases} end, null)), x -> x is not null))))"
        ),
    )
    # a start's votes are its run in the sorted list; the run's first entry stands for it
    need = "array(" + ", ".join(str(len(rare)) for _, rare in index) + ")"
    df = df.withColumn(
        "c",
        F.expr(
            "if(v is null, null, filter(transform(filter(transform(v, (x, j) -> named_struct('x', x, 'j', j)), "
            "y -> y.j = 0 or v[y.j - 1] <> y.x), "
            f"y -> named_struct('k', y.x.k, 's', y.x.s, 'n', size(filter(slice(v, y.j + 1, {RARE_BY_TEMPLATE}), z -> z = y.x)))), "
            f"y -> y.n >= {need}[y.k]))"
        ),
    )
    # the key phrases stand at the template's start plus their own place
    checks = []
    for k, (t, _) in enumerate(index):
        parts = []
        for key, at in zip(t.keys, _key_places(t)):
            part = key.split()
            parts.append(
                f"y.s + {at} >= 0 and slice(w, greatest(y.s + {at}, 0) + 1, {len(part)}) = {_list(part)}"
            )
        checks.append(f"when {k} then " + " and ".join(parts))
    labels = _list([t.label for t, _ in index])
    texts = "array(" + ", ".join(_list(t.text.split()) for t, _ in index) + ")"
    share = f"size(filter({texts}[y.k], (x, i) -> get(w, y.s + i) = x)) / cast(size({texts}[y.k]) as double)"
    df = df.withColumn(
        "found",
        F.expr(
            f"if(c is null, null, transform(filter(c, y -> case y.k {' '.join(checks)} end), "
            f"y -> named_struct('label', {labels}[y.k], 'start', y.s, 'share', {share})))"
        ),
    )
    base = "concat(" + ", ".join(f"b{k}" for k in range(len(BASE_PHRASES))) + ")"
    base_labels = "concat(" + ", ".join(
        f"if(size(b{k}) > 0, array({str_lit(label)}), cast(array() as array<string>))"
        for k, (_, label) in enumerate(BASE_PHRASES)
    ) + ")"
    none = "cast(array() as array<struct<label:string,start:int,share:double>>)"
    found = f"coalesce(found, {none})"
    return df.select(
        "doc_id",
        "n_words",
        F.expr(f"cast(size({base}) as bigint) as n_base"),
        F.expr(f"cast(array_min({base}) as bigint) as first_word"),
        F.expr(f"cast(array_max({base}) as bigint) as last_word"),
        F.expr(f"array_join(sort_array(array_distinct({base_labels})), ',') as base_labels"),
        F.expr(
            f"array_join(sort_array(array_distinct(concat({base_labels}, transform({found}, y -> y.label)))), ',') as labels"
        ),
        F.expr(
            f"greatest(if(size({base}) > 0, 0.6D, 0D), coalesce(array_max(transform({found}, y -> y.share)), 0D)) as score"
        ),
        F.expr(f"{found} as found"),
    )


assert all(re.search(rf"\b{re.escape(k)}\b", t.text) for t in TEMPLATES for k in t.keys)
assert all(any(not {*SIGNS}.isdisjoint(k.split()) for k in t.keys) for t in TEMPLATES)
assert all(not {*SIGNS}.isdisjoint(p.split()) for p, _ in BASE_PHRASES) and {*SIGNS} <= {*VOCABULARY}


@query("op5_license_scan")
def op5_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))
