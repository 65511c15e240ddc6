"""License scan by MinHash bands over overlapping text windows (operator 7), with DataFrame functions only.

Texts and templates are cut into shingles of `K` words, and these into windows of `WINDOW` shingles, one starting at every
shingle.  A window has `BANDS` MinHash values, each a band of its own; a window of the corpus retrieves every template window that
shares a band.  A template of one shingle stands in two windows with a Jaccard index of 1/2 or more, each of which retrieves it
with probability 1 - (1/2)^10 > 0.999; an exact copy of a whole window, as any longer template has in its copies, collides surely.
Each retrieved alignment is verified: the template matches if at least `LEAST` of its shingles stand, word by word, in the stretch
of the document that it is laid on, with a fifth of its length as play at either end.

The corpus is read and cut once.  Up to `MOST` template windows, their band values stand in the plan as constants, and no shuffle
happens before a window has been retrieved.  Beyond, band values and places are joined by a shuffle that moves no texts.  The template
windows are made by a job while the result is being described.

Defined cases: null and wordless texts have no license.  Rows are told apart by id and text, so repeated rows give repeated
results.  Templates without an id or of fewer than K words are ignored.  Only the id and text columns are read.  Texts of any
length are scanned whole; the same license at several places counts once.  A template is named wherever its wording stands: a
BSD-3-Clause text, which holds the two clauses of BSD-2-Clause, names both.  The default templates of the GNU licenses are short, so
that the name or version in which one differs from another is more than a fifth of its shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table
from tidelog.llm.decontamination import positions, shingle_hash, words_of

K, WINDOW, BANDS, LEAST, MOST = 5, 2, 10, 0.8, 20_000
WINDOWS = f"array<struct<at:int,{','.join(f'h{d}:bigint' for d in range(WINDOW))}>>"
#: Wording of public license notices.
TEMPLATES = (
    ("MIT-line", "Released under the MIT License."),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("GPL-2.0", "terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("GPL-3.0", "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License"),
    ("LGPL-3.0", "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)


def shingle_hashes(words: Column) -> Column:
    return F.transform(positions(F.size(words), K), lambda i: shingle_hash(words, i, K))


def shingles(words: Column) -> Column:
    """The distinct shingles themselves, word by word."""
    return F.array_distinct(F.transform(positions(F.size(words), K), lambda i: F.array_join(F.slice(words, i + 1, K), " ")))


def windows_of(hashes: Column) -> Column:
    """The windows of WINDOW shingle hashes in a row, as structs of at and h0, h1, ...; at the end of a text fields are null."""
    n = F.size(hashes)
    shifted = [F.slice(hashes, d + 1, F.greatest(F.lit(0), n - d)).alias(f"h{d}") for d in range(WINDOW)]
    return F.when(n > 0, F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("at"), *shifted)).otherwise(F.array().cast(WINDOWS))


def band(number: int) -> Column:
    """The number-th MinHash of a window in columns h0, h1, ...: its least hash under the number-th permutation."""
    seed = F.lit((number * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 64) - (1 << 63))  # the sign bit too must vary
    return F.least(*[F.col(f"h{d}").bitwiseXOR(seed) for d in range(WINDOW)])


def scan_licenses(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, text_key, licenses) for every row of docs; templates: (template, text)."""
    given = templates.filter("template IS NOT NULL").select("template", words_of(F.col("text")).alias("tw")).filter(F.size("tw") >= K)
    windows = given.select("template", "tw", shingle_hashes(F.col("tw")).alias("th")).select("template", "tw", F.inline(windows_of(F.col("th"))))
    every_band = F.array(*[band(j) for j in range(BANDS)])
    bands = windows.select("template", F.col("at").alias("offset"), F.size("tw").alias("length"), shingles(F.col("tw")).alias("tokens"), F.posexplode(every_band).alias("j", "value"))
    known: dict[int, set[int]] = {j: set() for j in range(BANDS)}
    values = bands.select("j", "value").distinct().limit(BANDS * MOST + 1).collect()
    few = len(values) <= BANDS * MOST
    for row in values:
        known[row["j"]].add(row["value"])

    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"), words_of(F.col(text_col)).alias("w"))
    hashed = base.withColumn("h", shingle_hashes(F.col("w")))
    itself = F.array(F.struct(F.lit(-1).alias("at"), *[F.lit(None).cast("bigint").alias(f"h{d}") for d in range(WINDOW)]))
    if few:
        placed = hashed.select("id", "text_key", "w", F.inline(F.concat(itself, windows_of(F.col("h")))))  # at = -1: the row itself
        hit = F.col("at") < 0
        for j in range(BANDS):
            hit = hit | band(j).isin(sorted(known[j]))
        retrieved = placed.filter(hit).select("id", "text_key", "w", "at", F.posexplode_outer(F.when(F.col("at") >= 0, every_band)).alias("j", "value"))
        joined = retrieved.join(F.broadcast(bands), ["j", "value"], "left").filter("at < 0 OR template IS NOT NULL")
    else:  # band values and places meet in a shuffle without texts; the aligned ones, which are few, meet their documents in another
        placed = hashed.select("id", "text_key", F.inline(windows_of(F.col("h")))).select("id", "text_key", "at", F.posexplode(every_band).alias("j", "value"))
        found = placed.join(bands.select("j", "value", "template", "offset"), ["j", "value"]).select(F.col("id").alias("own"), F.col("text_key").alias("own_key"), "template", (F.col("at") - F.col("offset")).alias("align")).distinct()
        found = found.join(given.select("template", F.size("tw").alias("length"), shingles(F.col("tw")).alias("tokens")), "template")
        once = base.dropDuplicates(["id", "text_key"])
        aligned = once.join(found, once["id"].eqNullSafe(found["own"]) & (once["text_key"] == found["own_key"])).select("id", "text_key", "w", "align", F.lit(0).alias("offset"), F.greatest(F.lit(0), F.col("align")).alias("at"), "template", "length", "tokens")
        aligned = aligned.withColumn("offset", F.col("at") - F.col("align"))
        rows = base.select("id", "text_key", F.lit(None).cast(dict(base.dtypes)["w"]).alias("w"), F.lit(None).cast("int").alias("align"), F.lit(None).cast("int").alias("offset"), F.lit(-1).alias("at"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("array<string>").alias("tokens"))
        joined = aligned.select(rows.columns).unionByName(rows)
    play = F.ceil(F.col("length") / 5).cast("int")
    start = F.greatest(F.lit(0), F.col("at") - F.col("offset") - play)
    stretch = F.when(F.col("at") >= 0, F.slice("w", start + 1, F.col("at") - F.col("offset") - start + F.col("length") + play))
    aligned = joined.select("id", "text_key", "template", (F.col("at") - F.col("offset")).alias("align"), "tokens", stretch.alias("stretch"), F.when(F.col("at") < 0, 1).alias("row"))
    verified = aligned.select(
        "id", "text_key", "row", "align",
        F.when(F.size(F.array_intersect("tokens", shingles(F.col("stretch")))) >= F.lit(least) * F.size("tokens"), F.col("template")).alias("template"),
    ).filter("row = 1 OR template IS NOT NULL")
    per_doc = verified.groupBy("id", "text_key").agg(F.sum("row").alias("rows"), F.sort_array(F.collect_set("template")).alias("licenses"))
    return per_doc.select(F.col("id").alias(id_col), "text_key", "licenses", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy")).drop("copy")


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "template string, text string")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), default_templates(spark))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


_TEXT = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
#: Plain containment without bands: every template at every place where one of its shingles stands.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents
), t AS (SELECT template, {_WORDS} AS w FROM (VALUES {_TEXT}) v(template, text)
), ts AS (SELECT template, len(w) AS n, p, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS p FROM t)
), total AS (SELECT template, count(DISTINCT s) AS m FROM ts GROUP BY template
), ds AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
), near AS (SELECT doc_id, ds.p, ts.p AS q, template, n, s FROM ds JOIN ts USING (s)
), align AS (SELECT DISTINCT doc_id, template, p - q AS a, n FROM near
), held AS (
  SELECT a.doc_id, a.template, a.a, count(DISTINCT b.s) AS c FROM align a JOIN near b
  ON a.doc_id = b.doc_id AND a.template = b.template AND b.p - 1 >= a.a - ceil(a.n / 5.0) AND b.p + 4 <= a.a + a.n + ceil(a.n / 5.0) GROUP BY ALL
), hit AS (SELECT DISTINCT doc_id, template FROM held JOIN total USING (template) WHERE c >= {LEAST} * m
), per AS (SELECT doc_id, count(*) AS k, string_agg(template, ',' ORDER BY template) AS l FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_licenses, coalesce(l, '') AS licenses FROM d LEFT JOIN per USING (doc_id)
"""
