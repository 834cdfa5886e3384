import regex
from pyspark.sql import functions as F

from tarn.llm import license_scan

from .conftest import documents

#: id -> (line of a text, the name that the library finds in it)
LINES = {
    10: ("All rights reserved.", "All rights reserved"),
    11: ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0 notice"),
    12: ("Licensed under the Mozilla Public License, Version 2.0.", "MPL-2.0 line"),
    13: ("Released under the GNU Lesser General Public License, version 2.1", "LGPL-2.1 line"),
    14: ("Distributed under the GNU Affero General Public License, version 3", "AGPL-3.0 line"),
    15: ("Licensed under the GNU General Public License, version 2.", "GPL-2.0 line"),
    16: ("Released under the ISC License.", "ISC line"),
    17: ("This is free and unencumbered software released into the public domain.", "Unlicense line"),
    18: ("Licensed under CC0 1.0", "CC0-1.0 line"),
    19: ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later line"),
    20: ("Tous droits réservés", "Tous droits réservés"),
}


def test_library_statements(spark, prose):
    rows = [(i, f"{prose(40)}\n{line}\n{prose(40)}", "en", "a") for i, (line, _) in LINES.items()]
    rows += [(50, "ALL RIGHTS RESERVED", "en", "a"), (51, "all rights are reserved", "en", "a"), (52, prose(300), "en", "a"), (53, None, "en", "a"), (54, "All rights reserved. " * 3, "en", "a")]
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, rows), license_scan.library()).collect()}
    for i, (_, name) in LINES.items():
        assert name in got[i].licenses.split("; "), (i, got[i])
        assert got[i].n_licenses == len(got[i].found or [])
    assert [tuple(f) for f in got[10].found] == [("All rights reserved", 40, 43, 1.0)]
    assert got[50].licenses == got[54].licenses == "All rights reserved" and got[54].n_licenses == 1
    assert got[51].n_licenses == got[52].n_licenses == got[53].n_licenses == 0


def test_every_template_is_found_whole_and_with_changed_words(spark, prose):
    names, rows, spans = {}, [], {}
    for i, (name, body, share) in enumerate(license_scan.library()):
        names[i] = name
        rows.append((i, f"{prose(7)}\n{body}\n{prose(7)}", "en", "a"))
        n = len(regex.findall(license_scan.WORD, body.lower()))
        if n >= license_scan.WIDTH:  # a short one may give way to a longer one of its name
            spans[i] = (name, 7, 7 + n, 1.0)
        words = body.split()
        if share < 1 and len(words) > 100:  # one word in 100 changed takes at most 5 shingles of 100 away
            names[10_000 + i] = name
            rows.append((10_000 + i, " ".join("changed" if k % 100 == 30 else w for k, w in enumerate(words)), "en", "a"))
    found = license_scan.scan(documents(spark, rows), license_scan.library()).collect()
    got = {r.doc_id: r.licenses.split("; ") for r in found}
    assert [i for i, name in names.items() if name not in got[i]] == []
    assert [(r.doc_id, spans[r.doc_id]) for r in found if r.doc_id in spans and spans[r.doc_id] not in {tuple(f) for f in r.found}] == []


def test_short_templates_that_share_words(spark):
    got = license_scan.scan(documents(spark, [(1, "x Free Beer", "en", "a"), (2, "free wine", "en", "a")]), {"a": "free beer", "b": "Free, beer!", "c": "wine"}).collect()
    assert {(r.doc_id, r.n_licenses, r.licenses) for r in got} == {(1, 2, "a; b"), (2, 1, "c")}


def test_versions_are_told_apart(spark):
    rows = [(i, f"This work is licensed under the GNU General Public License, version {i}.", "en", "a") for i in (2, 3)]
    rows += [(10 + i, f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {i} of the License, or (at your option) any later version.", "en", "a") for i in (2, 3)]
    rows.append((21, next(body for name, body, _ in license_scan.library() if name == "LGPL-2.1 text"), "en", "a"))
    got = {r.doc_id: r.licenses.split("; ") for r in license_scan.scan(documents(spark, rows), license_scan.library()).collect()}
    assert got[2] == ["GPL line", "GPL-2.0 line"] and got[3] == ["GPL line", "GPL-3.0 line"]
    for i in (2, 3):
        assert f"GPL-{i}.0-or-later notice" in got[10 + i] and f"GPL-{5 - i}.0-or-later notice" not in got[10 + i]
    assert "LGPL-2.1 text" in got[21] and "LGPL-2.0 text" not in got[21]


def test_bit_tables_pass_every_anchor_and_hardly_anything_else(spark):
    anchors = spark.range(1000).select(F.xxhash64("id").alias("h"))
    may_be = license_scan._bit_table(anchors, 1000)
    assert anchors.where(may_be(F.col("h"))).count() == 1000
    assert spark.range(1000, 1_001_000).select(F.xxhash64("id").alias("h")).where(may_be(F.col("h"))).count() < 20


def test_long_texts_without_licenses_are_not_signed(spark, prose, monkeypatch):
    written = {}
    monkeypatch.setattr(license_scan, "cut", lambda df, name, real=license_scan.cut: written.setdefault(name, real(df, name)))
    rows = [(i, " ".join(f"{w}{i}" for w in prose(5000).split()), "en", "a") for i in range(40)] + [(100, f"{prose(9)} {license_scan.TEMPLATES['MIT grant']}", "en", "a")]
    got = license_scan.scan(documents(spark, rows), license_scan.library())
    assert [r.doc_id for r in got.where("n_licenses > 0").collect()] == [100]
    assert [r.doc_id for r in written["license-rows"].where("s is not null").collect()] == [100]
