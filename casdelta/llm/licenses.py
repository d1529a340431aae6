"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact shingle containment verifies them.

All of it is column expressions on one row, so nothing is shuffled. A window is a run of 1, 2, 4 or 8 five-word shingles, the size being
about half a template's length at most; windows of a text overlap by half, those of a template begin at every shingle. Each of
eight permutations gives a band of one minimum. An unbroken stretch of a template holds a window that equals one of the template's,
so all bands collide; a window with one shingle of eight changed (similarity 0.78) is missed with probability 0.22^8.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices of well-known public licenses, as they are put into files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
WORD = "[a-z0-9]+"
SIZES = (1, 2, 4, 8)
BANDS = 8


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once: an expression inside a lambda would be worked out for each element."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column, n: int = 5) -> Column:
    """The distinct n-word shingles in order; one of all words where there are fewer, none where there is none."""

    def of(words: Column) -> Column:
        # single elements, not slices: a slice copies the whole array first
        last = F.greatest(F.lit(0), F.size(words) - n)
        many = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))

    return let(words_of(text), of)


def permuted(grams: Column) -> Column:
    """The shingles' hashes under each band's permutation."""

    def seeded(g: Column, band: int) -> Column:
        return F.transform(g, lambda x: F.xxhash64(x, F.lit(band)))

    return let(grams, lambda g: F.array(*[seeded(g, b) for b in range(BANDS)]))


def bands(mixed: Column, size: int, stride: int) -> Column:
    """A 64-bit value for each window and band of one window size; a text with fewer shingles has one window, all of them.

    mixed: as permuted() gives. The last window ends with the text, whatever the stride.
    """

    def of(m: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(m) - size)
        starts = F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))
        # beyond the end there is null, which takes no part in the minimum
        least = lambda i: F.least(F.get(m, i), *[F.get(m, i + k) for k in range(1, size)]) if size > 1 else F.get(m, i)
        return F.transform(starts, lambda i: F.xxhash64(least(i), F.lit(size)))

    return F.flatten(F.transform(F.filter(mixed, lambda m: F.size(m) > 0), of))


def window_of(count: int) -> int:
    """Window size for a template of so many shingles."""
    return max(s for s in SIZES if s <= max(1, count // 2))


def pivots(grams: list[str], least: int) -> set[str]:
    """Words such that any `least` of the shingles hold one: the greedy choice, among words of seven letters where there are any.

    Long words are rare in other texts, so few texts have to be read closely.
    """
    chosen: set[str] = set()
    while True:
        bare = [g.split() for g in grams if chosen.isdisjoint(g.split())]
        if len(bare) < least:
            return chosen
        chosen.add(max({w for g in bare for w in g}, key=lambda w: (len(w) > 6, sum(w in g for g in bare), len(w), w)))


def prepared(spark: SparkSession, templates: dict[str, str], containment: float) -> list[dict]:
    """Each template's name, shingles, least number of them, window size, pivots and band values; templates without words are left out."""
    table = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    rows = table.select("name", shingles(F.col("text")).alias("grams")).where(F.size("grams") > 0)
    rows = rows.select("name", "grams", *(bands(permuted(F.col("grams")), s, 1).alias(f"b{s}") for s in SIZES)).orderBy("name").collect()
    out = []
    for r in rows:
        size, least = window_of(len(r["grams"])), ceil(containment * len(r["grams"]) - 1e-9)
        out.append({"name": r["name"], "grams": r["grams"], "least": least, "size": size, "pivots": pivots(r["grams"], least), "keys": sorted(set(r[f"b{size}"]))})
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return (id_col, license, matched, shingles, containment): a row for each row of docs and template it contains.

    A template is contained if at least that share of its distinct five-word shingles (words: runs of a-z and 0-9 in lower case) is
    among the text's. Null, empty and wordless texts contain none; repeated rows repeat their result; a text may contain several
    templates. Only texts with one of the pivot words are read closely: whoever lacks them cannot reach the share. The templates are
    a parameter and go into the plan, so they should number in the hundreds at most; their number does not grow with docs.
    """
    known = prepared(docs.sparkSession, TEMPLATES if templates is None else templates, containment)
    out = docs.select(docs[id_col].alias(id_col), docs[text].cast("string").alias("_text"))
    words = sorted({w for t in known for w in t["pivots"]})
    low = F.lower("_text")
    might = F.lit(False)
    for w in words:
        might = might | low.contains(w)
    out = out.where(might).select(id_col, shingles(F.col("_text")).alias("_grams"))
    sizes = sorted({t["size"] for t in known})

    def hits(mixed: Column, size: int) -> Column:
        of_size = sorted({k for t in known if t["size"] == size for k in t["keys"]})
        return F.filter(bands(mixed, size, max(1, size // 2)), lambda k: k.isin(*of_size))

    keys = let(permuted(F.col("_grams")), lambda mixed: F.concat(*[hits(mixed, s) for s in sizes])) if known else F.array().cast("array<bigint>")
    out = out.withColumn("_keys", F.array_distinct(keys)).where(F.size("_keys") > 0)
    fields = lambda t: F.struct(F.lit(t["name"]).alias("license"), F.lit(t["least"]).alias("least"), F.array(*map(F.lit, t["grams"])).alias("grams"), F.array(*map(F.lit, t["keys"])).alias("keys"))
    found = F.filter(F.array(*[fields(t) for t in known]), lambda t: F.arrays_overlap(t["keys"], F.col("_keys"))) if known else None
    if found is None:
        return out.select(id_col, F.lit("").alias("license"), F.lit(0).alias("matched"), F.lit(0).alias("shingles"), F.lit(0.0).alias("containment"))
    checked = F.transform(found, lambda t: F.struct(t["license"].alias("license"), F.size(F.array_intersect(t["grams"], F.col("_grams"))).alias("matched"), F.size(t["grams"]).alias("shingles"), t["least"].alias("least")))
    out = out.select(id_col, F.inline(F.filter(checked, lambda t: t["matched"] >= t["least"])))
    return out.select(id_col, "license", "matched", "shingles", (F.col("matched") / F.col("shingles")).alias("containment"))
