"""Licence scan: text units against templates by the Dice coefficient of their word bigrams.

Native column expressions only; no shuffle. A unit is a line or a paragraph (lines between blank
lines). Text is normalised to lower-case words of letters and digits; a unit's bigrams are a set,
and a unit of one word has that word as its only member.

Pruning is exact. With Dice >= t, the size of a unit's set lies within [t/(2-t), (2-t)/t] times the
template's, and the unit holds at least t/(2-t) of the template's bigrams; so it holds at least one
of any larger share than the rest, and a word of that one. Texts without such a word, and units
outside all size bounds, are passed over.

Null and empty text have no match. Ties go to the template that sorts first by name. Every row gives one row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices as they are commonly written. (name, text)
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    w = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w))


def key_words(templates, threshold: float = THRESHOLD) -> list[str]:
    """Words of which a unit that reaches the threshold holds at least one.

    Of each template so many bigrams, those with the longest words first, that a unit can't lack them all.
    """
    words = set()
    for _, text in templates:
        grams = sorted(template_bigrams(text), key=lambda g: (-max(map(len, g.split())), g))
        needed = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        words |= {max(g.split(), key=lambda w: (len(w), w)) for g in grams[: len(grams) - needed + 1]}
    return sorted(words)


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """Distinct bigrams; a single word stands for itself."""
    pairs = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.element_at(words, i + 2)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(words)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, matches): of every unit that reaches the threshold its best (dice, license)."""
    sets = [(name, template_bigrams(text)) for name, text in sorted(templates)]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(len(g) for _, g in sets) * low, max(len(g) for _, g in sets) * high
    literal = F.array(*[F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, g)).alias("grams")) for n, g in sets])
    text = F.coalesce(F.col("text"), F.lit(""))
    key = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(key_words(templates, threshold))})(?![\p{{L}}\p{{N}}])"
    likely = F.lower(text).rlike(key)
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, "\n[ \t\r]*\n"), lambda p: F.instr(p, "\n") > 0)
    df = docs.select("doc_id", F.when(likely, F.concat(lines, paragraphs)).alias("_u"))
    df = df.select("doc_id", F.filter(F.transform("_u", normalised), lambda u: u.rlike(key)).alias("_u"))
    words = F.transform("_u", lambda u: F.split(u, " "))
    # n words make at most n - 1 distinct bigrams; repeats only lower that, so the upper bound is tested on the set.
    sized = F.filter(words, lambda w: F.size(w) - 1 >= F.lit(least) - 1)
    df = df.select("doc_id", F.transform(sized, bigrams).alias("_g"))

    def best(grams: Column) -> Column:
        fit = F.filter(literal, lambda t: (F.size(grams) >= low * F.size(t.grams) - 1e-9) & (F.size(grams) <= high * F.size(t.grams) + 1e-9))
        dice = F.transform(fit, lambda t: F.struct((2.0 * F.size(F.array_intersect(grams, t.grams)) / (F.size(grams) + F.size(t.grams))).alias("dice"), t.license.alias("license")))
        # Templates stand in order of name, so of equal scores the first is kept.
        return F.aggregate(dice, F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license")), lambda a, d: F.when(d.dice > a.dice, d).otherwise(a))

    fitting = F.filter("_g", lambda g: F.size(g) <= F.lit(most))
    found = F.filter(F.transform(fitting, best), lambda b: b.dice >= threshold - 1e-12)
    return df.select("doc_id", F.coalesce(found, F.array().cast("array<struct<dice:double,license:string>>")).alias("matches"))


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_matches, licenses, best_dice): per document."""
    return scanned.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.license))), ",").alias("licenses"),
        F.coalesce(F.round(F.array_max(F.transform("matches", lambda m: m.dice)), 6), F.lit(0.0)).alias("best_dice"),
    )
