"""Op 6: license scan by MinHash bands over overlapping text windows, DataFrame expressions only.

A template of n five-word shingles is looked for in windows of 2c shingles that
start at multiples of c, c being the least power of two of 1.25 n at least; so
every stretch of c shingles lies within one window. BANDS bands of one min-hash
each retrieve a template for a window: a window that holds 80 % of a template has
a Jaccard similarity to it of 0.15 at least, and shares a band with a probability
above 1 - 0.85 ** 96 > 0.9999998. A band is shared if the window's least hash is
that of a template shingle, so only windows that hold such a shingle are hashed
in full. Retrieved templates are kept if the window holds at least 80 % of their
shingles, exactly.

Templates are a constant of this module, of bounded size. All work on a document
is inside its row; nothing is shuffled.

Defined results: null texts, empty texts and texts under five words match
nothing; repeated rows get equal results; a document with several templates
names each once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import read_table
from barloom.llm.decontaminate import _grams, normalise

SIZE = 5
BANDS = 96
CONTAINED = 0.8

#: Public license notices and permission texts, fixed values.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def _shingles(norm: Column) -> Column:
    return F.transform(_grams(norm, SIZE), lambda g: F.xxhash64(g))


def _least(hashes: Column, band: Column) -> Column:
    return F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, band)))


def _compile(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Per template: name, shingles, c, and for each band the least hash and the shingle that has it."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    hashed = rows.select("name", F.array_distinct(_shingles(normalise(F.col("text")))).alias("shingles"))
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.array_min(F.transform("shingles", lambda x: F.struct(F.xxhash64(x, b).alias("least"), x.alias("shingle")))),
    )
    out = []
    for r in hashed.where(F.size("shingles") > 0).select("name", "shingles", bands.alias("bands")).collect():
        c = 1
        while c < 1.25 * len(r["shingles"]) and len(r["shingles"]) > 1:
            c *= 2
        out.append({
            "name": r["name"], "c": c, "shingles": list(r["shingles"]),
            "least": [b["least"] for b in r["bands"]], "marks": sorted({b["shingle"] for b in r["bands"]}),
        })
    return out


def _longs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id and matches: array of (name, start and end in words, contained share) by name and start."""
    compiled = _compile(docs.sparkSession, templates)
    marks = sorted({m for t in compiled for m in t["marks"]})
    hashed = docs.select("doc_id", _shingles(normalise(F.col("text"))).alias("h"))
    marked = hashed.select(
        "doc_id",
        F.filter(F.transform("h", lambda x, i: F.when(x.isin(marks), i)), lambda i: i.isNotNull()).alias("at"),
        "h",
    )

    def matches(t: dict) -> Column:
        c, need = t["c"], -(-len(t["shingles"]) * 4 // 5)
        near = F.filter("at", lambda i: F.get("h", i).isin(t["marks"]))
        starts = F.transform(near, lambda i: F.floor(i / c).cast("int") * c)
        starts = F.array_sort(F.array_distinct(F.concat(starts, F.filter(F.transform(starts, lambda s: s - c), lambda s: s >= 0))))
        window = lambda s: F.slice("h", s + 1, 2 * c)
        band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: b)
        least = _longs(t["least"])
        retrieved = F.filter(starts, lambda s: F.exists(band, lambda b: _least(window(s), b) == F.get(least, b)))
        wanted = _longs(t["shingles"])
        held = F.transform(
            retrieved,
            lambda s: F.struct(
                F.lit(t["name"]).alias("name"), s.alias("start"), (F.least(s + 2 * c, F.size("h")) + SIZE - 1).alias("end"),
                (F.size(F.array_intersect(window(s), wanted)) / F.lit(len(t["shingles"]))).alias("contained"),
            ),
        )
        return F.filter(held, lambda m: m["contained"] >= need / len(t["shingles"]))

    empty = F.array().cast("array<struct<name:string,start:int,end:int,contained:double>>")
    found = F.concat(empty, *[matches(t) for t in compiled])
    return marked.select("doc_id", F.when(F.size("at") > 0, found).otherwise(empty).alias("matches"))


def license_digests(docs: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.col("matches.name")))
    return find_licenses(docs).select(
        "doc_id",
        F.size(names).cast("long").alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"),
        F.size("matches").cast("long").alias("n_windows"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["name"], m["start"], m["end"])), ",").alias("windows"),
    )


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_scans": op6_license_scans}


def _sql() -> str:
    """The exact containment of every template in every window, without bands."""
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    return rf"""
WITH t AS (SELECT name, {words} AS w FROM (VALUES {values}) v(name, text)),
ts AS (SELECT DISTINCT name, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT name, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
tc AS (
  SELECT name, n, CASE WHEN n = 1 THEN 1 ELSE CAST(pow(2, ceil(log2(1.25 * n))) AS BIGINT) END AS c
  FROM (SELECT name, count(*) AS n FROM ts GROUP BY name)
),
d AS (SELECT doc_id, row_number() OVER () AS rid, {words} AS w FROM documents),
ds AS (SELECT rid, len(w) AS m, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
hit AS (SELECT rid, m, p, g, name, n, c FROM ds JOIN ts USING (g) JOIN tc USING (name)),
win AS (
  SELECT rid, m, name, n, c, g, (p // c) * c AS s FROM hit
  UNION ALL SELECT rid, m, name, n, c, g, (p // c) * c - c AS s FROM hit WHERE p >= c
),
ok AS (
  SELECT rid, name, s, least(s + 2 * c, m - 4) + 4 AS e FROM win
  GROUP BY rid, m, name, n, c, s HAVING count(DISTINCT g) >= ceil(n * 4 / 5.0)
),
r AS (
  SELECT rid, count(DISTINCT name) AS n_licenses, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n_windows,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY name, s) AS windows
  FROM ok GROUP BY rid
)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses,
  coalesce(n_windows, 0) AS n_windows, coalesce(windows, '') AS windows
FROM d LEFT JOIN r USING (rid)
"""


ORACLE_SQL = {"op6_license_scans": _sql()}
