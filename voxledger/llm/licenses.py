"""License scan: MinHash bands over overlapping windows find templates, containment verifies them.

Words are runs of letters and digits in lower case; shingles are five words.
Templates of LONG shingles or more are cut into windows of WIDTH shingles from
every place, documents into windows from every STEP-th place, so a template that
stands unchanged in a document holds a window of it.  A window has BANDS bands
of ROWS minima each; windows with a share J of equal shingles agree on a band
with probability 1 - (1 - J**ROWS)**BANDS, 0.98 at J = 0.8.  Shorter templates
are looked up by every single shingle, which is the same with windows of one.
Where a band is met, the shingles around it must hold 0.8 of the template's.

All of this happens within the row of a document: nothing is shuffled but the
few matches.  Bands and shingles of the templates go to the tasks as constants
and as a small table; MOST_TEMPLATE_BANDS bounds both, larger lists are searched
in blocks.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.llm.work import let

SHINGLE = 5
WIDTH, STEP, LONG = 8, 4, 11
BANDS, ROWS = 4, 2
CONTAINMENT = 0.8
MOST_TEMPLATE_BANDS = 20_000

#: Notices by which licenses are declared, as their publishers word them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 "
        "through 9 of this document.",
    ],
    "GPL-3.0": [
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ],
    "GPL-2.0": [
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU "
        "General Public License is intended to guarantee your freedom to share and change free software--to make sure the "
        "software is free for all its users.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
}

_SEEDS = [0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x61C8864680B583EB, 0x27D4EB2F165667C5, 0x5851F42D4C957F2D,
          0x14057B7EF767814F, 0x369DEA0F31A53F85, 0x0B5AD4ECEDA1CE2A]


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in order; fewer than five words have none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def joined(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[h[i + k] for k in range(SHINGLE)]))

    hashed = let(words, lambda w: F.transform(w, lambda x: F.xxhash64(x)))
    return let(hashed, lambda h: F.when(F.size(h) >= SHINGLE, joined(h)).otherwise(F.array().cast("array<long>")))


def _bands(window: Column) -> Column:
    """Band values of a window (an array of hashes): minima under different orders, ROWS to a band."""
    low = [F.array_min(F.transform(window, lambda x, s=s: x.bitwiseXOR(F.lit(s)))) for s in _SEEDS[: BANDS * ROWS]]
    return F.array(*[F.xxhash64(F.lit(b), *low[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])


def _windows(sh: Column, step: int) -> Column:
    """(at, bands) of the windows from every step-th shingle; the last one ends with the text."""
    last = F.size(sh) - WIDTH
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.floor((last + step - 1) / step).cast("int") * step, F.lit(step)))
    at = lambda i: F.least(i, last)
    return F.transform(starts, lambda i: F.struct(at(i).alias("at"), _bands(F.slice(sh, at(i) + 1, F.lit(WIDTH))).alias("bands")))


def _inline(spark: SparkSession, rows: list[dict], kinds: str) -> DataFrame:
    """A small table from one literal, so that no Python worker takes part."""
    text = json.dumps(rows, ensure_ascii=False)
    parsed = F.from_json(F.lit(text), f"array<struct<{kinds}>>")
    return spark.range(0, 1, 1, 1).select(F.explode(parsed).alias("r")).select("r.*")


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> list[dict]:
    """license_id, shingles (distinct) and bands of every template, computed as for documents."""
    rows = [{"license_id": k, "text": t} for k, texts in sorted(templates.items()) for t in texts]
    d = _inline(spark, rows, "license_id: string, text: string").select("license_id", shingles(F.col("text")).alias("sh"))
    d = d.where(F.size("sh") > 0)
    long = F.flatten(F.transform(_windows(F.col("sh"), 1), lambda w: w.bands))
    d = d.select("license_id", F.array_distinct("sh").alias("shingles"), F.when(F.size("sh") >= LONG, long).otherwise(F.col("sh")).alias("bands"))
    return [r.asDict() for r in d.collect()]


def _blocks(rows: list[dict]) -> list[list[dict]]:
    out: list[list[dict]] = [[]]
    for r in rows:
        if out[-1] and sum(len(x["bands"]) for x in out[-1]) + len(r["bands"]) > MOST_TEMPLATE_BANDS:
            out.append([])
        out[-1].append(r)
    return out


def _search(d: DataFrame, rows: list[dict]) -> DataFrame:
    """Matches of one block of templates in d (doc_id, text_hash, sh)."""
    spark = d.sparkSession
    short = sorted({b for r in rows if len(r["shingles"]) < LONG for b in r["bands"]})
    long = sorted({b for r in rows if len(r["shingles"]) >= LONG for b in r["bands"]})
    reach = max((len(r["shingles"]) for r in rows), default=0)

    def around(at: Column, sh: Column, width: int) -> Column:
        first = F.greatest(at - width, F.lit(0))
        return F.slice(sh, first + 1, F.lit(2 * width + WIDTH))

    def hits(sh: Column) -> Column:
        found = [F.array().cast("array<struct<at:int,band:long,region:array<long>>>")]
        if short:
            at = F.filter(F.sequence(F.lit(0), F.size(sh) - 1), lambda i: sh[i].isin(short))
            found.append(F.transform(at, lambda i: F.struct(i.alias("at"), sh[i].alias("band"), around(i, sh, LONG).alias("region"))))
        if long:
            met = F.filter(_windows(sh, STEP), lambda w: F.exists(w.bands, lambda b: b.isin(long)))
            found.append(F.flatten(F.transform(met, lambda w: F.transform(
                F.filter(w.bands, lambda b: b.isin(long)),
                lambda b: F.struct(w.at.alias("at"), b.alias("band"), around(w.at, sh, reach).alias("region")),
            ))))
        return F.concat(*[F.coalesce(x, found[0]) for x in found])

    # explode_outer: a plain explode is planned with a test for empty arrays, which computes the array twice
    found = let(F.col("sh"), lambda sh: F.when(F.size(sh) > 0, hits(sh)))
    met = d.select("doc_id", "text_hash", F.explode_outer(found).alias("hit")).select("doc_id", "text_hash", "hit.*").where("band IS NOT NULL")
    bands = sorted({(b, i) for i, r in enumerate(rows) for b in r["bands"]})
    by_band = _inline(spark, [{"band": b, "template": i} for b, i in bands], "band: bigint, template: int")
    by_template = _inline(
        spark, [r | {"template": i} for i, r in enumerate(rows)], "template: int, license_id: string, shingles: array<bigint>"
    )
    share = F.size(F.array_intersect("shingles", "region")) / F.size("shingles")
    return (
        met.join(F.broadcast(by_band), "band").join(F.broadcast(by_template), "template")
        .select("doc_id", "text_hash", "license_id", "at", share.alias("containment"))
        .where(F.col("containment") >= CONTAINMENT)
    )


def license_notices(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document and license with a notice in it: doc_id, license_id, containment (of the best match), first_word.

    Notices that differ in little more than a version match one place alike; there
    the fullest match counts.  first_word is the number of the word at which the
    first match was met.  Null
    and empty texts and such of less than five words match nothing.  Rows with
    equal doc_id and equal text are one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), shingles(text).alias("sh"))
    rows = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    found = reduce(DataFrame.union, [_search(d, block) for block in _blocks(rows)])
    place = found.groupBy("doc_id", "text_hash", "at").agg(
        F.max("containment").alias("best"), F.collect_set(F.struct("containment", "license_id")).alias("all")
    )
    winners = F.explode(F.filter("all", lambda x: x.containment == F.col("best"))).alias("won")
    return (
        place.select("doc_id", "text_hash", "at", winners).select("doc_id", "text_hash", "at", "won.*")
        .groupBy("doc_id", "text_hash", "license_id")
        .agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"))
        .drop("text_hash")
    )
