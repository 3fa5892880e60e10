"""Licence scan: Dice coefficient of word bigrams against licence templates, in DataFrame functions only.

A text is looked at line by line, paragraph by paragraph and as a whole. A unit and
a template of n and t different bigrams can only reach the coefficient d if n lies
between t*d/(2-d) and t*(2-d)/d, so most templates are pruned by size. Before that,
texts without any of the words that every sufficient overlap must contain are left
alone; that test is exact, too.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Short licence statements and notices, by SPDX-like name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MIT": (
        "MIT License.",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def plain_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def bigram_set(text: str) -> list[str]:
    """The different bigrams of a template, in order."""
    words = plain_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Numbers of bigrams a unit can have to reach the threshold with a template of ``size``."""
    return ceil(size * threshold / (2 - threshold) - 1e-9), int(size * (2 - threshold) / threshold + 1e-9)


def key_words(bigrams: list[str], threshold: float) -> set[str]:
    """Words one of which is in every unit that reaches the threshold.

    A unit must share ``need`` bigrams. Words are chosen, long ones first as a sign
    of rarity, until fewer bigrams than that are without a chosen one.
    """
    need = size_bounds(len(bigrams), threshold)[0]
    chosen: set[str] = set()
    for word in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (-len(w), w)):
        if sum(not chosen & set(b.split()) for b in bigrams) < need:
            break
        chosen.add(word)
    return chosen


def prepared(templates: dict[str, tuple[str, ...]], threshold: float) -> tuple[list[tuple[str, list[str], int, int]], list[str]]:
    """Templates with bigrams and size bounds, and the key words of all."""
    rows, words = [], set()
    for name, texts in sorted(templates.items()):
        for text in texts:
            bigrams = bigram_set(text)
            rows.append((name, bigrams, *size_bounds(len(bigrams), threshold)))
            words |= key_words(bigrams, threshold)
    return rows, sorted(words)


def _units(text: Column) -> Column:
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n\\s*\n"), F.array(text)))


def _words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(unit, r"[^\p{L}\p{N}]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    """The different bigrams of a list of words, which must be a column or a lambda's variable."""
    places = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i))))


def _once(column: Column) -> Column:
    """The same value by way of a generator, which keeps the optimizer from computing it once per use."""
    return F.explode(F.array(column))


def find_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document: its id, ``license`` and ``dice`` of the best match, and ``licenses``, all names found.

    The best match has the highest coefficient, ties to the first name. Without a
    match, and for null or empty texts, ``license`` is null, ``dice`` 0 and the list
    empty. Repeated rows are scanned each, empty tables give no rows, other columns
    are not read. There is no shuffle: every document is one row throughout.
    """
    rows, words = prepared(templates, threshold)
    known = F.array(*(
        F.struct(
            F.lit(name).alias("name"), F.array(*map(F.lit, bigrams)).alias("bigrams"), F.lit(len(bigrams)).alias("size"),
            F.lit(low).alias("low"), F.lit(high).alias("high"),
        )
        for name, bigrams, low, high in rows
    ))
    text = F.coalesce(F.lower(df[text_col].cast("string")), F.lit(""))
    may = F.lit(False)
    for word in words:
        may = may | F.contains(F.col("text"), F.lit(word))

    def matches(bigrams: Column) -> Column:
        """Templates within the size bounds that reach the threshold."""
        size = F.size(bigrams)
        near = F.filter(known, lambda t: size.between(t["low"], t["high"]))
        scored = F.transform(
            near,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(bigrams, t["bigrams"])) / (size + t["size"])).alias("dice"), t["name"].alias("name")
            ),
        )
        return F.filter(scored, lambda s: s["dice"] >= threshold)

    smallest, largest = min(r[2] for r in rows), max(r[3] for r in rows)
    sets = F.transform(F.transform(_units(F.col("text")), _words), _bigrams)
    sets = F.filter(sets, lambda b: F.size(b).between(smallest, largest))
    none = F.array().cast("array<array<string>>")
    best = F.reduce(
        "found",
        F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("name")),
        lambda a, b: F.when((b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["name"] < a["name"])), b).otherwise(a),
    )
    found = (
        df.select(df[id_col].alias("id"), _once(text).alias("text"))
        .select("id", _once(F.when(may, sets).otherwise(none)).alias("sets"))
        .select("id", _once(F.flatten(F.transform("sets", matches))).alias("found"))
        .select("id", "found", _once(best).alias("best"))
    )
    names = F.array_sort(F.array_distinct(F.transform("found", lambda s: s["name"])))
    return found.select(F.col("id").alias(id_col), F.col("best.name").alias("license"), F.col("best.dice").alias("dice"), names.alias("licenses"))
