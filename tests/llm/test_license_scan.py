"""Licence scans against every unit compared with every notice in plain Python."""

import re

import pytest

from fleetvault.llm import license_scan as scan
from fleetvault.llm.queries import ORACLES, QUERIES
from tests.oracle import difference


def brute(text, percent=80, notices=scan.NOTICES):
    text = text or ""
    units = text.split("\n") + [p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p]
    out = []
    for at, unit in enumerate(units):
        own = set(scan.bigrams_of(unit))
        best = None
        for name, notice in notices:
            other = set(scan.bigrams_of(notice))
            if own and other:
                dice = 2 * len(own & other) / (len(own) + len(other))
                if dice >= percent / 100 and (best is None or dice > best[0]):
                    best = (dice, name)
        if best:
            out.append((best[1], best[0], at))
    return out


WRAPPED = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.

code here"""
ROWS = [
    (1, None, "x"),
    (2, "", "x"),
    (3, "Released under the MIT License.", None),
    (4, "x\nreleased   UNDER the\tmit-license!!\ny", None),
    (5, WRAPPED, None),
    (6, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.\n", None),
    (7, "all rights reserved " * 20_000, None),
    (8, "All rights reserved", "x"),
    (8, "All rights reserved", "x"),
    (None, "This work is licensed under the GNU General Public License, version 3", None),
    (9, "é all rights reserved é\n\n\nLicensed under\nthe Apache License,\nVersion 2.0.\n \nz", None),
    (10, "permission is hereby granted to read this", None),
    (11, "word " * 100_000 + "\nReleased under the MIT License", None),
]


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_against_brute_force(spark, percent):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, license string")
    rows = scan.scan(df, percent=percent).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        want = brute(r.row.text, percent)
        assert [(m.license, m.dice, m.unit) for m in r.matches] == want
        assert r.dice == max([0.0, *(d for _, d, _ in want)])


def test_a_match_has_a_telling_bigram():
    notice = scan.bigrams_of(scan.NOTICES[1][1])
    chosen = scan.telling(notice, 80)
    lacking = [b for b in notice if b not in chosen]
    assert 2 * len(lacking) / (len(lacking) + len(notice)) < 0.8


def test_empty_table_and_no_notices(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert scan.scan(df).collect() == []
    some = spark.createDataFrame([(1, "MIT License")], "doc_id long, text string")
    assert scan.scan(some, notices=[("x", "word")]).first().matches == []


def test_query(spark, sf_dir, con):
    out = QUERIES["op8_license_scan"](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert difference(out, con, ORACLES["op8_license_scan"]) is None
