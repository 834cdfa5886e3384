"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies. DataFrame functions only.

Words are runs of letters and digits (with inner dots and hyphens) in lower
case; a text's shingles are the hashes of WIDTH words in a row. A template with t
shingles belongs to the class of the power of two L with L / 2 < t <= L. Windows
of a class hold 2 L shingles and begin every L, so an occurrence of a template
lies whole in one window; their similarity is at least 0.19 if 80 % of the
template is there, so one of BANDS bands of one row collides with probability
1 - 0.81^64, over 0.999998. Retrieved templates count if the window holds at least
CONTAINED of their shingles.

A share that must stand may be higher than CONTAINED, by template: lines and notices that
differ in a version number only must stand whole. A window that lacks at most m shingles of
a template holds one of any m + 1 of them, so windows without one of these anchors cannot match and are not
signed. Anchors are told by bit tables, one for each class, constants of the plan of at most MAX_BITS bits: a shingle that they take for
an anchor by mistake only costs a signature. Templates are a written table of any size: what is
joined with texts is broadcast up to BROADCAST_ROWS rows, by their count, and merged beyond. A template shorter than WIDTH words is one
shingle of all its words and is looked up at that width, from the plan. Several templates may share a name,
which is then found once, where most of a template stands: from the first to the last of its shingles in the window.

Defined results: null and empty texts hold no license;
rows that repeat an id are rows of their own; empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import json
import pkgutil
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, discard

WIDTH = 5
CONTAINED = 0.8
BANDS = 64
MIN_BITS, MAX_BITS = 1 << 12, 1 << 24
BITS, PROBES = 64, 6  # bits a table has for an anchor, and bits that an anchor sets: of a million other shingles about one passes
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"

# Statements and notices of public licenses, by name.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT line": "Released under the MIT License.",
    "MIT licensed line": "Licensed under the MIT License.",
    "MIT grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
}


def library() -> list[tuple[str, str, float]]:
    """The rows (name, body, contained) of license_texts.jsonl: texts, notices and statements, what the registered query scans with."""
    lines = pkgutil.get_data(__package__, "license_texts.jsonl").decode().splitlines()
    return [(r["name"], r["body"], r["contained"]) for r in map(json.loads, lines)]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def runs(found: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order."""
    at = F.when(F.size(found) >= width, F.sequence(F.lit(1), F.size(found) - (width - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(found, i + k) for k in range(width)]))


def shingles(text: Column) -> Column:
    """Hashes of all runs of WIDTH words, or the one of all words of a shorter text."""

    def of(found: Column) -> Column:
        out = runs(found, WIDTH)
        for width in range(1, WIDTH):
            out = F.when(F.size(found) == width, runs(found, width)).otherwise(out)
        return out

    return F.flatten(F.transform(F.array(words(text)), of))  # the array of one keeps the words from being found again


def _longs(values: Iterable[int]) -> Column:
    """A constant array: a text until the optimizer folds it, as one literal a value is slow to send."""
    values = list(values)
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.expr("cast(array() as array<bigint>)")


def signature(window: Column) -> Column:
    """The smallest hash of the window's shingles under each of BANDS hash functions."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(window, lambda x: F.xxhash64(x, j))))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A table for a join: broadcast if it has few rows, else merged."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def template_table(spark: SparkSession, templates: list[tuple[str, str, float]]) -> tuple[DataFrame, dict[int, dict[int, list[str]]]]:
    """(tid, name, need, share of it that must stand, size class, anchors) of the templates, written; and by width and hash the names of short ones."""
    rows = spark.createDataFrame(templates, "name string, body string, share double")
    rows = rows.select("name", "share", F.size(words(F.col("body"))).alias("n"), F.array_distinct(shingles(F.col("body"))).alias("need")).where("n > 0")
    short: dict[int, dict[int, list[str]]] = {}
    for r in rows.where(F.col("n") < WIDTH).collect():
        names = short.setdefault(r.n, {}).setdefault(r.need[0], [])
        names.extend({r.name} - {*names})
    held = rows.where(F.col("n") >= WIDTH)
    wide = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("need")) - 1e-9)).cast("int")
    may_lack = F.floor((1 - F.col("share")) * F.size("need") + 1e-6).cast("int")
    held = held.select(F.monotonically_increasing_id().alias("tid"), "name", "need", "share", wide.alias("wide"), F.slice(F.array_sort("need"), F.lit(1), may_lack + 1).alias("anchors"))
    return cut(held, "license-templates"), short


def _probes(h: Column, bits: int, probes: int) -> list[Column]:
    """The places of a hash, from its two halves."""
    half = (1 << 32) - 1
    first, step = h.bitwiseAND(F.lit(half).cast("long")), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(half).cast("long"))
    at = [h] + [first + step * k for k in range(1, probes)]
    return [x.bitwiseAND(F.lit(bits - 1).cast("long")) for x in at]


def _bit_table(anchors: DataFrame, rows: int):
    """Whether a shingle may be an anchor: PROBES bits of a table of BITS an anchor or more, as far as MAX_BITS go, fewer in a table that would fill up."""
    bits = max(MIN_BITS, min(MAX_BITS, 1 << (BITS * rows).bit_length()))
    probes = max(1, min(PROBES, 7 * bits // (10 * max(1, rows))))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    places = anchors.select(F.explode(F.array(*_probes(F.col("h"), bits, probes))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("held"))
    table = [0] * (bits // 64)  # at most MAX_BITS / 64 longs, so as many rows are collected
    for r in places.collect():
        table[r["at"]] = r.held
    held = _longs(table)

    def may_be(h: Column) -> Column:
        tests = [F.call_function("shiftright", F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1 for p in _probes(h, bits, probes)]
        return reduce(and_, tests)

    return may_be


def _places(classes: dict[int, object]) -> Column:
    """The windows (wide, k) of each class that hold one of its anchors, from the column hits."""
    none = F.expr("cast(array() as array<struct<wide:int,k:int>>)")

    def of(wide: int, may_be) -> Column:
        own = F.transform(F.filter("hits", lambda x: may_be(x["h"])), lambda x: F.floor(x["pos"] / wide).cast("int"))
        turns = F.filter(F.array_distinct(F.flatten(F.transform(own, lambda k: F.array(k, k - 1)))), lambda k: k >= 0)
        return F.transform(turns, lambda k: F.struct(F.lit(wide).alias("wide"), k.alias("k")))

    return F.concat(none, *[of(w, classes[w]) for w in sorted(classes)])


def _short(found: Column, known: dict[int, dict[int, list[str]]]) -> Column:
    """Templates of fewer than WIDTH words: (name, begin, end, contained)."""
    none = F.expr("cast(array() as array<struct<name:string,begin:int,end:int,contained:double>>)")

    def of(width: int) -> Column:
        hashes = _longs(known[width])
        names = F.array(*[F.array(*map(F.lit, x)) for x in known[width].values()])

        def at(hs: Column) -> Column:
            def match(h: Column) -> Column:
                begin = (F.array_position(hs, h) - 1).cast("int")
                return F.transform(F.element_at(names, F.array_position(hashes, h).cast("int")), lambda n: F.struct(n.alias("name"), begin.alias("begin"), (begin + width).alias("end"), F.lit(1.0).alias("contained")))

            return F.flatten(F.transform(F.array_intersect(hs, hashes), match))

        return F.flatten(F.transform(F.array(runs(found, width)), at))

    return F.concat(none, *[of(width) for width in sorted(known)])


def scan(docs: DataFrame, templates: dict[str, str] | list[tuple[str, str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_licenses, licenses (names in order, joined by "; "), found (name, begin and end in words, containment).

    ``templates`` are bodies by name, of which CONTAINED must stand, or rows (name, body, share that must stand, at least CONTAINED); TEMPLATES if not given.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    held, known = template_table(spark, [(k, v, CONTAINED) for k, v in templates.items()] if isinstance(templates, dict) else list(templates))
    anchors = cut(held.select("wide", F.explode("anchors").alias("h")).distinct(), "license-anchors")
    sizes = dict(anchors.groupBy("wide").count().collect())  # classes are powers of two: few rows
    n_held, n_need = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("need")), F.lit(0))).first()
    may_be = _bit_table(anchors, sum(sizes.values()))
    classes = {w: _bit_table(anchors.where(F.col("wide") == w), n) for w, n in sizes.items()}
    both = F.transform(F.array(words(F.col(text_col))), lambda w: F.struct(runs(w, WIDTH).alias("s"), _short(w, known).alias("short")))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.element_at(both, 1).alias("b")).select("doc_id", "b.*")
    own = own.select("doc_id", "short", "s", F.filter("s", may_be).alias("some"))
    placed = F.filter(F.transform("s", lambda x, i: F.struct(x.alias("h"), i.alias("pos"))), lambda x: may_be(x["h"]))
    own = own.select("doc_id", "short", "s", F.when(F.size("some") > 0, placed).alias("hits")).select("doc_id", "short", "s", F.when(F.col("hits").isNotNull(), _places(classes)).alias("places"))
    held_some = F.size("places") > 0
    rows = cut(own.select("doc_id", "short", F.when(held_some, F.col("s")).alias("s"), F.when(held_some, F.col("places")).alias("places"), F.monotonically_increasing_id().alias("row")), "license-rows")
    # few bytes and much arithmetic: dealt anew, into as many tasks as other shuffles have
    texts = rows.where("s is not null").select("row", "s", "places").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row")
    windows = texts.select("row", "s", F.explode("places").alias("p")).select("row", F.col("p.wide").alias("wide"), (F.col("p.k") * F.col("p.wide")).alias("begin"), F.slice("s", F.col("p.k") * F.col("p.wide") + 1, 2 * F.col("p.wide")).alias("window"))
    bands = cut(held.select("tid", "wide", F.posexplode(signature(F.col("need"))).alias("band", "least")), "license-bands")
    signed = windows.select("row", "wide", "begin", F.posexplode(signature(F.col("window"))).alias("band", "least"))
    pairs = cut(signed.join(_small(bands, n_held * BANDS), ["wide", "band", "least"]).select("row", "begin", "tid").distinct(), "license-pairs")
    templates_of = _small(held.select("tid", "name", "need", "share", "wide"), n_need)
    retrieved = rows.where("s is not null").select("row", "s").join(pairs.hint("merge"), "row").join(templates_of, "tid")
    retrieved = retrieved.withColumn("window", F.slice("s", F.col("begin") + 1, 2 * F.col("wide")))
    shared, back = F.array_intersect("window", "need"), F.reverse("window")
    first = F.array_position("window", F.get(shared, F.lit(0))) - 1
    last = F.size("window") - F.array_position(back, F.get(F.array_intersect(back, F.col("need")), F.lit(0)))
    retrieved = retrieved.withColumn("contained", F.size(shared) / F.size("need")).where(F.col("contained") >= F.col("share"))
    retrieved = retrieved.select("row", "name", "contained", (F.col("begin") + first).cast("int").alias("begin"), (F.col("begin") + last + WIDTH).cast("int").alias("end"))
    exact = retrieved.groupBy("row", "name").agg(F.max(F.struct("contained", (-F.col("begin")).alias("back"), "end")).alias("best"))
    match = F.struct("name", (-F.col("best.back")).alias("begin"), F.col("best.end").alias("end"), F.col("best.contained").alias("contained"))
    found = cut(exact.groupBy("row").agg(F.collect_list(match).alias("long")), "license-found")
    discard(pairs, bands, anchors, held)
    out = rows.select("row", "doc_id", "short").join(found.hint("merge"), "row", "left")
    # a name of the short templates that a longer one of that name was found by already, or that was found before, counts once
    more = F.coalesce("long", F.expr("cast(array() as array<struct<name:string,begin:int,end:int,contained:double>>)"))
    new = F.filter("short", lambda x, i: ~F.exists(more, lambda y: y["name"] == x["name"]) & ~F.exists(F.slice("short", F.lit(1), i), lambda y: y["name"] == x["name"]))
    out = out.select("doc_id", F.sort_array(F.concat(more, new)).alias("found"))
    names = F.transform("found", lambda m: m["name"])
    return out.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(names, "; ").alias("licenses"), F.when(F.size("found") > 0, F.col("found")).alias("found"))
