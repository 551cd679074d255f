"""Licence notices in documents, by the Dice coefficient over word bigrams.

Each line, each paragraph and the whole text are normalised (lower case, runs of anything but
a-z and 0-9 are one space) and compared to every licence template whose size allows the
threshold: with m and n distinct bigrams, 2 * common / (m + n) >= t needs
min(m, n) / max(m, n) >= t / (2 - t). Column expressions only: no shuffle, no Python.

A text is looked at closer only if it holds an anchor word. Anchors are chosen so that this
loses nothing: a match shares at least ``least`` of a template's n bigrams, so any
n - least + 1 of them include a shared one, and so many hold an anchor of the template.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Public licence notices: a key and one notice or paragraph each.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]


def normalise(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip().split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The sizes that can reach the threshold against n bigrams."""
    ratio = threshold / (2 - threshold)
    return math.ceil(n * ratio - 1e-9), math.floor(n / ratio + 1e-9)


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every unit that matches a template holds one at least."""
    chosen: set[str] = set()
    for _, text in templates:
        grams = bigrams(normalise(text))
        need = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9) + 1
        count = lambda have: sum(any(w in have for w in g.split()) for g in grams)
        words = sorted({w for g in grams for w in g.split()}, key=lambda w: (-min(len(w), 7), -sum(w in g.split() for g in grams), w))
        have = {w for w in chosen if w in words}
        for w in words:
            if count(have) >= need:
                break
            have.add(w)
        if count(have) < need:
            raise ValueError(f"a template is too short: {text!r}")
        chosen |= have
    return sorted(w for w in chosen if not any(o != w and o in w for o in chosen))


def _units(text: Column) -> Column:
    lines, paragraphs = F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n")
    return F.array_distinct(F.concat(lines, paragraphs, F.array(text)))


def matches(text: Column, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """ARRAY<STRUCT<unit: INT, licence: STRING, dice: DOUBLE>> of a text's matches, with units
    numbered over distinct lines, paragraphs and the whole text. Null and empty texts: none."""
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array(*[F.lit(g) for g in grams]).alias("g")) for k, t in templates for grams in [bigrams(normalise(t))] for lo, hi in [size_bounds(len(grams), threshold)]])
    has = lambda c: _any([F.contains(c, F.lit(a)) for a in anchors(templates, threshold)])

    def grams_of(unit: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(unit, "[^a-z0-9]+", " ")), " ")
        n = F.size(words)
        pairs = F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))

    low = F.lower(text)
    close = F.filter(F.transform(_units(low), lambda u, i: F.struct(i.alias("i"), u.alias("u"))), lambda x: has(x["u"]))
    gramed = F.transform(close, lambda x: F.struct(x["i"].alias("i"), grams_of(x["u"]).alias("g")))

    def against(x: Column) -> Column:
        size = F.size(x["g"])
        fit = F.filter(known, lambda t: (size >= t["lo"]) & (size <= t["hi"]))
        said = F.transform(fit, lambda t: F.struct(x["i"].cast("int").alias("unit"), t["k"].alias("licence"), (F.lit(2.0) * F.size(F.array_intersect(x["g"], t["g"])) / (size + F.size(t["g"]))).alias("dice")))
        return F.filter(said, lambda m: m["dice"] >= threshold)

    found = F.flatten(F.transform(gramed, against))
    return F.when(has(low), found).otherwise(F.array().cast("array<struct<unit:int,licence:string,dice:double>>"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id``, ``licence`` (the best match; of equals the last by name; null
    without a match), ``dice`` (rounded to 6 places, null without), ``n_matches`` (units that
    match, counted for each licence) and ``licences`` (all, sorted, joined by commas; null
    without). One row a document, repeated rows included."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(matches(F.col("text"), templates, threshold), F.array().cast("array<struct<unit:int,licence:string,dice:double>>")).alias("m"))
    best = F.array_max(F.transform("m", lambda x: F.struct(x["dice"].alias("dice"), x["licence"].alias("licence"))))
    names = F.array_sort(F.array_distinct(F.transform("m", lambda x: x["licence"])))
    distinct = F.array_distinct(F.transform("m", lambda x: F.struct(x["unit"].alias("u"), x["licence"].alias("k"))))
    return found.select("doc_id", best["licence"].alias("licence"), F.round(best["dice"], 6).alias("dice"), F.size(distinct).cast("long").alias("n_matches"), F.when(F.size(names) > 0, F.concat_ws(",", names)).alias("licences"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for :func:`scan`: every unit against every template by its bigrams. Units without
    a bigram of any template, or with over 1000, can reach no threshold and are left out first."""
    rows = ", ".join(f"('{k}', [{', '.join(repr(g) for g in bigrams(normalise(t)))}])" for k, t in templates)
    return f"""
    WITH template(k, g) AS (VALUES {rows}),
    unit AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), chr(10)) || regexp_split_to_array(lower(text), '\\n[ \\t\\r]*\\n') || [lower(text)])) AS u FROM documents),
    words AS (SELECT doc_id, u, string_split(trim(regexp_replace(u, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM unit),
    gram AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words),
    hit AS (SELECT doc_id, u, k, 2.0::DOUBLE * len(list_intersect(gram.g, template.g)) / (len(gram.g) + len(template.g)) AS dice FROM gram, template
            WHERE len(gram.g) BETWEEN 1 AND 1000 AND list_has_any(gram.g, template.g)),
    best AS (SELECT doc_id, arg_max(k, {{'d': dice, 'k': k}}) AS licence, max(dice) AS dice, count(DISTINCT {{'u': u, 'k': k}}) AS n, string_agg(DISTINCT k, ',' ORDER BY k) AS licences
             FROM hit WHERE dice >= {threshold} GROUP BY doc_id)
    SELECT d.doc_id, b.licence, round(b.dice, 6) AS dice, coalesce(b.n, 0)::BIGINT AS n_matches, b.licences FROM documents d LEFT JOIN best b USING (doc_id)
    """
