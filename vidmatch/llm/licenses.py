"""Licence notices in documents: Dice coefficient over word bigrams.

Every line and every paragraph of a text is normalised (ASCII letters and digits in
lower case, all else a blank) and compared with licence templates by the Dice
coefficient of their sets of word bigrams. Sizes bound the coefficient: with ``a`` and
``b`` bigrams it is at most ``2 min(a, b) / (a + b)``, so templates of other sizes are
not compared at all. Built from array functions alone: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.8

#: Words that tell a licence from its siblings: versions and restrictions. A text and a
#: template must have the same ones, however similar the rest is.
MARKS = ["1", "2", "3", "4", "affero", "endorse", "lesser", "nc", "nd", "noderivatives", "noncommercial", "sa", "sharealike"]

# Public licence notices.
GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} "
    "as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
    "later version."
)
GNU_KINDS = [
    ("GPL-2.0", "General Public License", "2"),
    ("GPL-3.0", "General Public License", "3"),
    ("AGPL-3.0", "Affero General Public License", "3"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
]
CREATIVE_COMMONS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is '
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # The opening of both; the third clause makes it the other licence.
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    *[(n, f"This work is licensed under the GNU {kind}, version {v}.") for n, kind, v in GNU_KINDS],
    *[(n, GNU.format(what=w, kind=kind, version=v)) for n, kind, v in GNU_KINDS for w in ("program", "library")],
    *[(f"CC-{n}-4.0", f"Licensed under CC {n} 4.0.") for n in CREATIVE_COMMONS],
    *[
        (f"CC-{n}-4.0", f"This work is licensed under a Creative Commons {words} 4.0 International License.")
        for n, words in CREATIVE_COMMONS.items()
    ],
]


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def template_marks(text: str) -> list[str]:
    return sorted(set(template_words(text)) & set(MARKS))


def template_bigrams(text: str) -> list[str]:
    """The set of word bigrams of a template, in order."""
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Smallest and largest set that can reach the threshold with one of ``n``; a little wide."""
    return int(threshold / (2 - threshold) * n), int((2 - threshold) / threshold * n) + 1


def _units(text: Column) -> Column:
    """Lines and paragraphs, each different one once."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n")))


def _bigrams(words: Column) -> Column:
    pairs = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)),
    )
    return F.array_distinct(pairs)


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row for each row of ``docs``: key, license, dice, notices.

    A template counts for a unit only if both have the same ``MARKS``: a version or a
    restriction makes another licence, however alike the rest. ``license`` is the template
    of the highest coefficient (of equal ones that of most marks, then the first by
    name), null where none reaches the threshold; ``notices`` counts the different
    lines and paragraphs that reach it for some template. A null text is empty and
    has no notice; units of fewer than two words have no bigrams and match nothing.
    Repeated rows give repeated results; other columns are ignored. ``templates`` is
    a list of the caller's, compared within the row: it should stay in the hundreds.
    """
    listed = [(name, grams, template_marks(t)) for name, t in templates if (grams := template_bigrams(t))]
    if not listed:
        return docs.select(
            key, F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"), F.lit(0).cast("long").alias("notices")
        )
    least = min(size_bounds(len(g), threshold)[0] for _, g, _ in listed)
    literal = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(size_bounds(len(g), threshold)[0]).alias("low"),
                F.lit(size_bounds(len(g), threshold)[1]).alias("high"),
                F.array(*map(F.lit, g)).alias("grams"),
                F.array(*map(F.lit, m)).cast("array<string>").alias("marks"),
            )
            for name, g, m in listed
        ]
    )
    every = F.array(*map(F.lit, dict.fromkeys(g for _, grams, _ in listed for g in grams)))

    def matches(unit: Column) -> Column:
        """Templates of fitting size and the same marks, and their coefficients: (dice, marks, name)."""
        grams = unit["grams"]
        fitting = F.filter(literal, lambda t: F.size(grams).between(t["low"], t["high"]) & (t["marks"] == unit["marks"]))
        return F.transform(
            fitting,
            lambda t: F.struct(
                (F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))).alias("dice"),
                F.size(t["marks"]).alias("marks"),
                t["name"].alias("name"),
            ),
        )

    clean = lambda u: F.trim(F.regexp_replace(F.translate(u, UPPER, LOWER), "[^a-z0-9]+", " "))
    listed_marks = F.array(*map(F.lit, MARKS))
    unit = lambda w: F.struct(_bigrams(w).alias("grams"), F.array_sort(F.array_intersect(w, listed_marks)).alias("marks"))
    # Best of a unit: highest coefficient, then most marks, then first name.
    order = lambda m: F.struct((-m["dice"]).alias("less"), (-m["marks"]).alias("marks"), m["name"].alias("name"))
    best = lambda found: F.get(F.array_sort(F.transform(found, order)), F.lit(0))
    return (
        docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
        .select(key, F.transform(_units("text"), lambda u: F.split(clean(u), " ")).alias("units"))
        .select(key, F.transform(F.filter("units", lambda w: F.size(w) > least), unit).alias("units"))
        .select(key, F.filter("units", lambda u: (F.size(u["grams"]) >= least) & F.arrays_overlap(u["grams"], every)).alias("units"))
        .select(key, F.transform("units", lambda u: best(F.filter(matches(u), lambda m: m["dice"] >= threshold))).alias("found"))
        .select(key, F.array_sort(F.filter("found", lambda m: m.isNotNull())).alias("found"))
        .select(
            key,
            F.get("found", F.lit(0))["name"].alias("license"),
            F.round(-F.get("found", F.lit(0))["less"], 6).alias("dice"),
            F.size("found").cast("long").alias("notices"),
        )
    )


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    quoted_list = lambda words: f"[{', '.join(map(quoted, words))}]::VARCHAR[]"
    values = ", ".join(f"({quoted(n)}, {quoted_list(template_bigrams(t))}, {quoted_list(template_marks(t))})" for n, t in templates if template_bigrams(t))
    return rf"""
WITH templates(name, grams, marks) AS (VALUES {values}),
units AS (SELECT row_number() OVER () AS r, doc_id, list_distinct(list_concat(string_split(coalesce(text, ''), chr(10)),
 regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n'))) AS units FROM documents),
words AS (SELECT r, u, list_filter(string_split(regexp_replace(translate(u, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '),
 lambda w: w <> '') AS words FROM (SELECT r, unnest(units) AS u FROM units)),
grams AS (SELECT r, u, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams,
 list_sort(list_distinct(list_filter(words, lambda w: list_contains({quoted_list(MARKS)}, w)))) AS marks
 FROM words WHERE len(words) > 1),
found AS (SELECT g.r, g.u, t.name, len(t.marks) AS marks, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
 FROM grams g JOIN templates t ON t.marks = g.marks AND 2.0::DOUBLE * least(len(g.grams), len(t.grams)) / (len(g.grams) + len(t.grams)) >= {threshold - 1e-9}),
best AS (SELECT r, count(DISTINCT u) AS notices, arg_min(name, (-dice, -marks, name)) AS license, max(dice) AS dice
 FROM found WHERE dice >= {threshold} GROUP BY r)
SELECT u.doc_id, b.license, round(b.dice, 6) AS dice, coalesce(b.notices, 0) AS notices FROM units u LEFT JOIN best b ON b.r = u.r"""
