"""License scans: lines and whole short texts compared with licence templates by the Dice coefficient over word bigrams.

Text is normalised (A-Z lower-cased, everything but a-z and 0-9 is one space). A unit - each line, and the whole text where it
has several lines - is its set of distinct word bigrams A; it matches a template B when 2|A & B| / (|A| + |B|) >= threshold. That
bounds the sizes: t/(2-t) |B| <= |A| <= (2-t)/t |B|, so a unit outside all templates' bounds is dropped after a count of
its words, before any bigram is built, and only templates whose bounds hold count for the rest. The bigrams left are looked
up in the templates' index, which is broadcast (its size is that of the template list, counted before), and counted by
unit and template with map-side combining; nothing else is shuffled. Only DataFrame functions are used.

Passages are the units inside lines or over several lines: runs of words. The best run for a template begins and ends with one of the
template's bigrams, so all runs between two of them are compared, of up to (2-t)/t |B| bigrams, and nothing is strided over. A match shares
at least t/(2-t) |B| bigrams; so texts without any of a few words, chosen such that fewer bigrams of each template lack them, are passed
over, and then texts and starts with too few of a template's bigrams. Of runs that overlap the best is reported, unless a line that it
touches matches as well or better, or the line that holds it or the whole text is reported with the same licence.

Defined cases: null, empty or one-word texts match nothing; of several templates above the threshold the highest coefficient wins
and then the least name; rows that share a doc_id are reported each by their text, equal rows once; a null doc_id is reported as
null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import NO_ID, checked_broadcast, keyed, pinned

# Licence notices as they are published, by SPDX name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _bigrams(words: Column) -> Column:
    """Distinct word bigrams as text."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.array_distinct(F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>")))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, license, size, bigrams)."""
    listed = [F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)]
    rows = spark.range(1).select(F.inline(F.array(*listed)))
    words = pinned(rows, "w", F.filter(F.split(F.regexp_replace(_lower(F.col("text")), "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    return words.select("template", "license", _bigrams(F.col("w")).alias("bigrams")).withColumn("size", F.size("bigrams"))


def _signature(bigrams: list[str], need: int) -> set[str]:
    """Words such that fewer than ``need`` of the bigrams have none of them, the longest first."""
    chosen: set[str] = set()
    for word in sorted({w for b in bigrams for w in b.split(" ")}, key=lambda w: (-len(w), w)):
        if sum(not chosen & set(b.split(" ")) for b in bigrams) < need:
            break
        chosen.add(word)
    return chosen


def passages(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(_d, _t, license, dice, first, last, a, b) of the best run of words from each start, whatever it overlaps; first and last are
    bigrams, a and b lines."""
    low, high = (threshold / (2 - threshold), (2 - threshold) / threshold)
    table = [r for r in template_table(docs.sparkSession, templates).collect() if r["size"]]
    need = [max(1, math.ceil(low * r["size"] - 1e-6)) for r in table]
    signature = sorted(set().union(*(_signature(r["bigrams"], k) for r, k in zip(table, need, strict=True))))
    listed = F.array(*(F.struct(F.lit(r["license"]).alias("license"), F.lit(r["size"]).alias("size"), F.lit(k).alias("need"), F.lit(int(high * r["size"] + 1e-6)).alias("span"), F.array(*map(F.lit, r["bigrams"])).alias("bigrams")) for r, k in zip(table, need, strict=True)))
    every = sorted({b for r in table for b in r["bigrams"]})
    split = lambda c: F.filter(F.split(_lower(c), "[^a-z0-9]+"), lambda w: w != "")
    pair = lambda w, i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1))
    worded = pinned(keyed(docs.select("doc_id", "text"))[0].filter("text is not null"), "w", split(F.col("text"))).filter((F.size("w") > 1) & F.exists("w", lambda x: x.isin(signature)))
    at = F.filter(F.sequence(F.lit(1), F.size("w") - 1), lambda i: pair(F.col("w"), i).isin(every))
    hits = pinned(worded, "h", F.transform(at, lambda i: F.struct(i.alias("i"), pair(F.col("w"), i).alias("b")))).filter(F.size("h") >= min(need))
    found = pinned(hits, "t", F.filter(listed, lambda t: F.size(F.array_intersect(F.transform("h", lambda x: x["b"]), t["bigrams"])) >= t["need"])).filter(F.size("t") > 0)
    line = F.flatten(F.transform(F.split("text", "\n"), lambda x, k: F.array_repeat(k + 1, F.size(split(x)))))
    each = pinned(found, "line", line).select("_d", "_t", "w", "line", "h", F.explode("t").alias("t"))
    own = pinned(each, "own", F.filter("h", lambda x: F.array_contains("t.bigrams", x["b"]))).drop("h")
    starts = own.select("*", F.posexplode("own").alias("k", "x"))
    near = pinned(starts, "y", F.filter(F.slice("own", F.col("k") + 1, F.col("t.span")), lambda y: y["i"] < F.col("x.i") + F.col("t.span"))).drop("own")
    near = near.filter(F.size(F.array_distinct(F.transform("y", lambda y: y["b"]))) >= F.col("t.need"))
    run = pinned(near, "run", F.transform(F.sequence(F.col("x.i"), F.element_at("y", -1)["i"]), lambda i: pair(F.col("w"), i))).drop("w")

    def dice(y: Column) -> Column:
        common = F.size(F.array_distinct(F.transform(F.filter("y", lambda z: z["i"] <= y["i"]), lambda z: z["b"])))
        n = F.size(F.array_distinct(F.slice("run", F.lit(1), y["i"] - F.col("x.i") + 1)))
        return 2 * common / (n + F.col("t.size"))

    best = pinned(run, "best", F.array_max(F.transform("y", lambda y: F.struct(dice(y).alias("dice"), F.negative(y["i"]).alias("last"))))).filter(F.col("best.dice") >= threshold - 1e-9)
    last = F.negative("best.last")
    return best.select("_d", "_t", F.col("t.license").alias("license"), F.col("best.dice").alias("dice"), F.col("x.i").alias("first"), last.alias("last"), F.element_at("line", F.col("x.i")).alias("a"), F.element_at("line", last + 1).alias("b"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(_d, _t, unit, license, dice) of all matching units; unit 0 is the whole text, others are lines from 1, and passages have minus
    the line that they begin in."""
    units = whole_units(docs, templates, threshold)
    runs = passages(docs, templates, threshold).distinct().groupBy("_d", "_t").agg(F.sort_array(F.collect_list(F.struct(F.negative("dice").alias("d"), "first", "last", "license", "a", "b"))).alias("runs"))
    reported = units.groupBy("_d", "_t").agg(F.collect_list(F.struct("unit", "license", "dice")).alias("units"))
    same = lambda u, r: (u["unit"] == 0) & (u["license"] == r["license"])
    better = lambda u, r: u["unit"].between(r["a"], r["b"]) & ((u["dice"] >= -r["d"] - 1e-9) | ((r["a"] == r["b"]) & (u["license"] == r["license"])))
    left = pinned(runs.join(reported, ["_d", "_t"], "left"), "r", F.filter("runs", lambda r: ~F.exists(F.coalesce("units", F.array()), lambda u: same(u, r) | better(u, r)))).filter(F.size("r") > 0)
    apart = lambda kept, r: ~F.exists(kept, lambda q: (q["first"] <= r["last"]) & (r["first"] <= q["last"]))
    kept = F.aggregate("r", F.slice("r", 1, 0), lambda kept, r: F.when(apart(kept, r), F.concat(kept, F.array(r))).otherwise(kept))
    return units.unionByName(left.select("_d", "_t", F.explode(kept).alias("r")).select("_d", "_t", F.negative("r.a").alias("unit"), "r.license", F.negative("r.d").alias("dice")))


def whole_units(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """The matching lines and whole texts."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    low, high = (threshold / (2 - threshold), (2 - threshold) / threshold)
    sizes = [r["size"] for r in table.select("size").collect()]  # one number a template
    least, most = int(min(sizes) * low), int(max(sizes) * high) + 1
    index = checked_broadcast(table.select("template", "license", "size", F.explode("bigrams").alias("b")))
    text = F.regexp_replace(_lower(F.coalesce("text", F.lit(""))), "[^a-z0-9\n]+", " ")
    lines = pinned(keyed(docs.select("doc_id", "text"))[0].select("_d", "_t", text.alias("x")), "l", F.split("x", "\n")).drop("x")
    units = lines.select("_d", "_t", F.posexplode(F.concat(F.array(F.when(F.size("l") > 1, F.concat_ws(" ", "l"))), "l")).alias("unit", "u")).filter(F.col("u").isNotNull())
    worded = pinned(units, "w", F.filter(F.split("u", " "), lambda w: w != "")).drop("u").filter(F.size("w") > max(1, least))
    sets = pinned(worded, "s", _bigrams(F.col("w"))).drop("w").withColumn("n", F.size("s")).filter(F.col("n").between(least, most))
    hits = sets.select("_d", "_t", "unit", "n", F.explode("s").alias("b")).join(index, "b").filter((F.col("n") >= F.col("size") * low - 1e-6) & (F.col("n") <= F.col("size") * high + 1e-6))
    shared = hits.groupBy("_d", "_t", "unit", "n", "template", "license", "size").agg(F.count_distinct("b").alias("common"))
    dice = shared.select("_d", "_t", "unit", "license", (2 * F.col("common") / (F.col("n") + F.col("size"))).alias("dice")).filter(F.col("dice") >= threshold - 1e-9)
    best = dice.groupBy("_d", "_t", "unit").agg(F.min(F.struct(F.negative("dice").alias("d"), "license")).alias("x"))
    return best.select("_d", "_t", "unit", F.col("x.license").alias("license"), F.negative("x.d").alias("dice"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(docs).select(F.nullif("_d", F.lit(NO_ID)).alias("doc_id"), F.col("unit").cast("long").alias("unit"), "license", F.round("dice", 6).alias("dice"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NORM = "list_filter(string_split(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SETS = "unnest(CASE WHEN len(w) < 2 THEN [] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) END)"
ORACLE = f"""
WITH tpl AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}) v(template, license, text)),
tb AS (SELECT template, license, {_SETS} AS b FROM (SELECT template, license, {_NORM.format("text")} AS w FROM tpl)),
ts AS (SELECT template, count(*) AS size FROM tb GROUP BY template),
ls AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
units AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS unit, unnest(l) AS u FROM ls UNION ALL SELECT doc_id, 0, text FROM ls WHERE len(l) > 1),
ub AS (SELECT doc_id, unit, {_SETS} AS b FROM (SELECT doc_id, unit, {_NORM.format("u")} AS w FROM units)),
us AS (SELECT doc_id, unit, count(*) AS n FROM ub GROUP BY doc_id, unit),
x AS (SELECT doc_id, unit, template, license, count(*) AS common FROM ub JOIN tb USING (b) GROUP BY doc_id, unit, template, license),
y AS (SELECT doc_id, unit, license, 2.0::DOUBLE * common / (n + size) AS dice FROM x JOIN us USING (doc_id, unit) JOIN ts USING (template)),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) AS k FROM y WHERE dice >= 0.8 - 1e-9)
SELECT doc_id, CAST(unit AS BIGINT) AS unit, license, round(dice, 6) AS dice FROM z WHERE k = 1
"""
