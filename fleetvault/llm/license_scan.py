"""License scans: units of a text against licence notices by Dice coefficient over word bigrams.

A unit is a line, or a paragraph of several lines (lines up to a blank one). Its normal form has
A-Z in lower case and every run of other characters than a-z and 0-9 as one space. A unit matches a
notice when twice the common distinct bigrams are ``percent`` of the bigrams of both, or more.

All on DataFrame functions, without a shuffle: documents never move and are not exploded. Two exact
bounds prune. A match shares so many bigrams with its notice that it contains one of a few chosen
ones (the notice's longest), so texts and units without any are passed over. And a notice whose
size is out of proportion to the unit's is not compared.

Nulls and edge cases: a null or empty text matches nothing, and neither does a unit or notice of
fewer than two words. Ties go to the notice that comes first, then to the earlier unit (lines
before paragraphs). Very long units are compared by their distinct bigrams like any other. Rows
that repeat are scanned each on its own. Other columns, whatever their names, pass in ``row``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvault.llm.state import let

# Usual wordings by which a text says what licence it is under, by SPDX identifier. Fixed values.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("Proprietary", "All rights reserved."),
]
PERCENT = 80
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MATCH = "array<struct<license:string,dice:double,unit:int>>"


def bigrams_of(text: str) -> list[str]:
    """Distinct bigrams of a notice, in order."""
    words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def telling(bigrams: list[str], percent: int) -> list[str]:
    """Bigrams of a notice of which every match contains one.

    A match has at least as many bigrams as it shares, so it shares percent / (200 - percent) of
    the notice's or more, and can lack fewer than the rest.
    """
    least = math.ceil(percent * len(bigrams) / (200 - percent))
    return sorted(bigrams, key=lambda b: (-len(b), b))[: len(bigrams) - least + 1]


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def _bigrams(unit: Column) -> Column:
    def pairs(words: Column) -> Column:
        rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
        return F.array_distinct(F.transform(rest, lambda w, i: F.concat_ws(" ", F.get(words, i), w)))

    return let(F.split(unit, " "), pairs)


def scan(docs: DataFrame, notices=NOTICES, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (text, anything else): the whole ``row``, its matches (license, dice, unit;
    paragraphs are numbered after lines) and the best one's license and dice."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    sized = [(name, bigrams_of(text)) for name, text in notices]
    sized = [(name, found) for name, found in sized if found]
    chosen = sorted({b for _, found in sized for b in telling(found, percent)})
    loose = "(?i)" + "|".join(b.replace(" ", "[^a-z0-9]+") for b in chosen)
    strict = r"(?:^| )(?:" + "|".join(chosen) + r")(?: |$)"
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<unit:int,words:string>>")
    lines = F.split(text, "\n", -1)
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n", -1), lambda p: F.contains(p, F.lit("\n")))
    units = F.transform(F.concat(lines, paragraphs), lambda u, i: F.struct(i.alias("unit"), normal(u).alias("words")))
    likely = F.filter(units, lambda u: F.rlike(u.words, F.lit(strict)))
    df = docs.select(F.struct("*").alias("row"))
    df = df.withColumn("_units", F.when(F.rlike(text, F.lit(loose)), likely).otherwise(none) if chosen else none)
    counted = F.transform("_units", lambda u: F.struct(u.unit.alias("unit"), _bigrams(u.words).alias("own")))
    df = df.withColumn("_own", counted)

    def compared(unit: Column) -> Column:
        each = []
        for order, (name, found) in enumerate(sized):
            own, size = F.size(unit.own), len(found)
            common = F.size(F.array_intersect(unit.own, F.array(*map(F.lit, found))))
            dice = F.when(200 * F.least(own, F.lit(size)) >= percent * (own + size), 2 * common / (own + size))
            each.append(
                F.struct(
                    F.coalesce(dice, F.lit(0.0)).alias("dice"),
                    (-F.lit(order)).alias("order"),
                    F.lit(name).alias("license"),
                )
            )
        return F.array_max(F.array(*each))

    best = F.transform("_own", lambda u: F.struct(u.unit.alias("unit"), compared(u).alias("best")))
    good = F.filter(best, lambda m: m.best.dice >= percent / 100)
    empty = F.array().cast("array<struct<unit:int,best:struct<dice:double,order:int,license:string>>>")
    df = df.withColumn("_good", good if sized else empty)
    matches = F.transform(
        "_good", lambda m: F.struct(m.best.license.alias("license"), m.best.dice.alias("dice"), m.unit.alias("unit"))
    )
    top = F.array_max(
        F.transform(
            "_good",
            lambda m: F.struct(
                m.best.dice.alias("dice"),
                m.best.order.alias("order"),
                (-m.unit).alias("at"),
                m.best.license.alias("license"),
            ),
        )
    )
    return df.select(
        "row",
        matches.cast(MATCH).alias("matches"),
        top.license.alias("license"),
        F.coalesce(top.dice, F.lit(0.0)).alias("dice"),
    )
