"""Licence scans: normalised text against licence templates by the Dice coefficient over word
bigrams, with DataFrame functions only.

Units are the whole text, its paragraphs, its lines, and windows: as many words as a template has, from a
word where one of its bigrams begins, whatever lines and comment marks stand between them. So a notice is
found inside a longer line and in a wrapped header above code. A window is made only where the template's
bigrams lie dense enough to reach the threshold, and of windows that overlap only the one that shares most
counts: the others are cut askew. A unit is compared with a template only if their numbers of distinct bigrams allow the threshold: with
``a`` and ``b`` bigrams, Dice is at most ``2 min(a, b) / (a + b)``. A unit is named by its best template
alone, and a unit inside a better one of another name (the first line of a notice, without its version)
doesn't count, so that a text under one licence is not taken for its neighbours. Texts without the words that any
match must hold are not cut up at all. Everything happens inside the row; nothing is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# SPDX names of licences whose identifier line is searched for.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause",
        "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only",
        "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
        "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]

# Public licence statements and texts, by paragraph.
STATEMENTS: list[tuple[str, str]] = [
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU Affero General Public License as published by the Free Software Foundation, "
     "either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
     "use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed "
     "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
     "ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be "
     "used to endorse or promote products derived from this software without specific prior written "
     "permission."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
     "License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
     "International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
     "International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or "
     "neighboring rights to this work."),
    ("cc0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related "
     "and neighboring rights to this software to the public domain worldwide. This software is "
     "distributed without any warranty."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the "
     "Eclipse Public License 2.0 which is available at"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation; either "
     "version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
     "or without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the "
     "terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
     "either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
     "either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
     "v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event "
     "will the authors be held liable for any damages arising from the use of this software."),
]

TEMPLATES = STATEMENTS + [
    (re.sub("-(only|or-later)$", "", name.lower()), f"SPDX-License-Identifier: {name}") for name in SPDX]


def words_of(text: str) -> list[str]:
    """Words of a template: runs of ASCII letters and digits, lower-cased."""
    return [x for x in re.split("[^a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER))) if x]


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, sorted."""
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def bounds(size: int, least: float) -> tuple[float, float]:
    """Numbers of bigrams with which a unit can reach the threshold."""
    return size * least / (2 - least), size * (2 - least) / least


def telling_words(grams: list[list[str]], least: float) -> list[str]:
    """Words of which every text that matches a template must hold one.

    A match shares at least ``least / (2 - least)`` of the template's bigrams. If the bigrams that
    hold one of the words are more than the rest of them, a text without these words cannot match.
    """
    chosen: list[str] = []
    everywhere: dict[str, int] = {}
    for g in grams:
        for w in {w for x in g for w in x.split()}:
            everywhere[w] = everywhere.get(w, 0) + 1
    for g in grams:
        spare = len(g) * (1 - least / (2 - least))
        while sum(any(w in chosen for w in x.split()) for x in g) <= spare:
            open_ = {w for x in g for w in x.split()} - set(chosen)
            chosen.append(max(open_, key=lambda w: (len(w) > 5, everywhere[w], len(w), w)))
    return chosen


def unit_words(unit: Column) -> Column:
    """Words of a unit: runs of ASCII letters and digits, lower-cased."""
    folded = F.translate(unit, UPPER, LOWER)
    return F.filter(F.split(folded, "[^a-z0-9]+"), lambda w: w != "")


def all_bigrams(words: Column) -> Column:
    """The bigrams of a list of words, in order."""
    n = F.size(words)
    return F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))),
                      F.slice(words, 2, F.greatest(n - 1, F.lit(0))),
                      lambda a, b: F.concat_ws(" ", a, b))


def fewest_shared(size: int, least: float) -> int:
    """Distinct bigrams that a unit must share with a template of ``size`` to reach the threshold."""
    return math.ceil(bounds(size, least)[0] - 1e-9)


def windows(pairs: Column, template: str, least: float) -> Column:
    """Distinct bigrams of windows of a template's length in a text's ``pairs``: those that begin with one of
    the template's bigrams, share enough distinct ones with it, and share no fewer than any window that
    overlaps them (ties: the first). None if the text shares too few."""
    grams, length = bigrams(template), len(words_of(template)) - 1
    need = fewest_shared(len(grams), least)

    def counted(shared: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1),
                      lambda i: F.array_contains(shared, F.get(pairs, i)))
        return F.flatten(F.transform(F.array(at), lambda p: F.filter(
            F.transform(p, lambda x, j: F.when(F.get(p, j + need - 1) - x < length, F.struct(
                x.alias("at"), F.size(F.array_intersect(
                    F.slice(pairs, x + 1, F.lit(length)), shared)).alias("n")))),
            lambda c: c.isNotNull() & (c["n"] >= need))))

    def peaks(found: Column) -> Column:
        def better(q: Column, c: Column) -> Column:
            return ((F.abs(q["at"] - c["at"]) < length)
                    & ((q["n"] > c["n"]) | ((q["n"] == c["n"]) & (q["at"] < c["at"]))))

        return F.filter(found, lambda c, k: ~F.exists(
            F.slice(found, F.greatest(k - length, F.lit(0)) + 1, F.lit(2 * length + 1)),
            lambda q: better(q, c)))

    shared = F.array_intersect(pairs, F.array(*[F.lit(x) for x in grams]))
    enough = F.filter(F.array(shared), lambda x: F.size(x) >= need)
    return F.transform(F.flatten(F.transform(F.transform(enough, counted), peaks)),
                       lambda c: F.array_distinct(F.slice(pairs, c["at"] + 1, F.lit(length))))


def matches(text: Column, templates: list[tuple[str, str]], least: float) -> Column:
    """array<struct<dice, license>>: the best template of each distinct unit (ties: the last name) that
    reaches the threshold. Units are equal if their distinct bigrams in order are."""
    table = [(name, t, grams) for name, t in templates if (grams := bigrams(t))]
    smallest = min(bounds(len(g), least)[0] for *_, g in table)
    parts = F.array_distinct(F.concat(
        F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n")))
    listed = F.filter(F.transform(parts, unit_words), lambda w: F.size(w) > smallest)
    moving = F.flatten(F.transform(
        F.array(all_bigrams(unit_words(text))),
        lambda pairs: F.flatten(F.array(*[windows(pairs, t, least) for _, t, _ in table]))))
    units = F.array_distinct(F.concat(
        F.transform(listed, lambda w: F.array_distinct(all_bigrams(w))), moving))

    def best(unit: Column) -> Column:
        out = []
        for name, _, g in table:
            low, high = bounds(len(g), least)
            shared = F.size(F.array_intersect(unit, F.array(*[F.lit(x) for x in g])))
            dice = 2.0 * shared.cast("double") / (F.size(unit) + len(g)).cast("double")
            fits = F.size(unit).cast("double").between(low - 1e-9, high + 1e-9)
            out.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(name).alias("license"))))
        return F.array_max(F.array(*out))

    def counts(m: Column, found: Column) -> Column:
        return ~F.exists(found, lambda o: (o["m"]["dice"] > m["m"]["dice"])
                         & (o["m"]["license"] != m["m"]["license"])
                         & (F.size(F.array_except(m["unit"], o["unit"])) == 0))

    named = F.filter(F.transform(units, lambda u: F.struct(best(u).alias("m"), u.alias("unit"))),
                     lambda x: x["m"].isNotNull() & (x["m"]["dice"] >= least))
    return F.flatten(F.transform(F.array(named), lambda found: F.transform(
        F.filter(found, lambda m: counts(m, found)), lambda x: x["m"])))


def scan(docs: DataFrame, least: float = LEAST,
         templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_matches (distinct units at or above the threshold),
    licenses (distinct names in order, comma-joined), best and dice (the best match; ties: the last name).

    Null and empty texts match nothing: licenses is empty, best and dice are null.
    """
    templates = templates or TEMPLATES
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    may = F.lit(False)
    for w in telling_words([bigrams(t) for _, t in templates if bigrams(t)], least):
        may = may | low.contains(w)
    found = docs.select(F.col("doc_id"), F.when(may, matches(text, templates, least)).otherwise(
        F.array().cast("array<struct<dice: double, license: string>>")).alias("_m"))
    top = F.array_max("_m")
    return found.select(
        "doc_id", F.size("_m").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("_m")["license"])), ",")
        .alias("licenses"), top["license"].alias("best"), top["dice"].alias("dice"))
