"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

Lines, paragraphs and whole texts are compared.  A template of b bigrams can reach coefficient t only against a set of
t * b / (2 - t) to (2 - t) * b / t bigrams, so a unit meets only the templates that its size admits, by an equi-join on
the size.  DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table

#: Notices and headers by which works name their licence.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
MIN_DICE = 0.8
#: Templates that may be broadcast.
MAX_BROADCAST = 10_000


def normalised(text: Column) -> Column:
    """Lower case; everything but letters, digits and line ends becomes one space."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " "))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", min_dice: float = MIN_DICE) -> DataFrame:
    """doc_id, unit (line, paragraph or text), unit_no (from 0), license and dice for every unit that matches a licence.

    dice is the best over that licence's templates, at least min_dice.  A paragraph ends at a blank line and is compared
    where there is more than one; the whole text where it has more than one line.  Units without two words match
    nothing, as do null and empty texts.  Rows with one id are one document: equal finds are given once.
    """
    if not 0 < min_dice <= 1:
        raise ValueError("min_dice must be over 0 and at most 1")
    spark = docs.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(templates or TEMPLATES, "license string, template string")
    sizes = templates.select("license", bigrams(F.split(F.trim(F.regexp_replace(normalised(F.col("template")), r"[ \n]+", " ")), " ")).alias("t_set")).where(F.size("t_set") > 0)
    low, high = F.ceil(F.size("t_set") * (min_dice / (2 - min_dice)) - 1e-9), F.floor(F.size("t_set") * ((2 - min_dice) / min_dice) + 1e-9)
    most, number = sizes.agg(F.max(high), F.count("*")).first()
    if not number:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, unit string, unit_no int, license string, dice double")
    admitted = sizes.withColumn("n", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    if number <= MAX_BROADCAST and most <= MAX_BROADCAST:
        admitted = F.broadcast(admitted)

    def numbered(parts: Column, unit: str) -> Column:
        return F.transform(parts, lambda s, i: F.struct(F.lit(unit).alias("unit"), i.cast("int").alias("unit_no"), F.trim(F.regexp_replace(s, r"[ \n]+", " ")).alias("s")))

    text = F.col("norm")
    lines, paragraphs = F.split(text, "\n", -1), F.split(text, r"\n *\n[ \n]*", -1)
    none = F.array().cast("array<struct<unit:string,unit_no:int,s:string>>")
    units = F.concat(
        numbered(lines, "line"),
        F.when(text.rlike(r"\n *\n"), numbered(paragraphs, "paragraph")).otherwise(none),
        F.when(text.contains("\n"), numbered(F.array(text), "text")).otherwise(none),
    )
    spaces = lambda s: F.length(s) - F.length(F.translate(s, " ", ""))
    # distinct bigrams are at most the spaces, so units with too few spaces end here
    least = math.ceil(min_dice / (2 - min_dice) - 1e-9)
    wanted = F.filter(units, lambda u: spaces(u["s"]) >= least)
    one = id_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm")).select("doc_id", F.explode(wanted).alias("u"))
    one = one.select("doc_id", "u.unit", "u.unit_no", bigrams(F.split("u.s", " ")).alias("u_set")).withColumn("n", F.size("u_set"))
    both = one.where(F.col("n") <= most).join(admitted, "n")
    dice = 2.0 * F.size(F.array_intersect("u_set", "t_set")) / (F.size("u_set") + F.size("t_set"))
    hits = both.select("doc_id", "unit", "unit_no", "license", dice.alias("dice")).where(F.col("dice") >= min_dice)
    return hits.groupBy("doc_id", "unit", "unit_no", "license").agg(F.max("dice").alias("dice"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL = rf"""
WITH t0(license, template) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEMPLATES)}),
t1 AS (SELECT license, string_split(trim(lower(regexp_replace(template, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), ' ') AS w FROM t0),
t AS (SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS b FROM t1),
d AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')) AS norm FROM documents),
u AS (
  SELECT doc_id, 'line' AS unit, unnest(string_split(norm, chr(10))) AS s, generate_subscripts(string_split(norm, chr(10)), 1) - 1 AS unit_no FROM d
  UNION ALL
  SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(norm, '\n *\n[ \n]*')), generate_subscripts(regexp_split_to_array(norm, '\n *\n[ \n]*'), 1) - 1 FROM d WHERE regexp_matches(norm, '\n *\n')
  UNION ALL
  SELECT doc_id, 'text', norm, 0 FROM d WHERE contains(norm, chr(10))),
w AS (SELECT doc_id, unit, unit_no, string_split(trim(regexp_replace(s, '[ \n]+', ' ', 'g')), ' ') AS w FROM u),
b AS (SELECT doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS b FROM w WHERE len(w) > 1),
hit AS (SELECT doc_id, unit, unit_no, license, 2.0::DOUBLE * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS dice FROM b, t
  WHERE len(b.b) <= 2 * len(t.b) AND len(t.b) <= 2 * len(b.b))
SELECT doc_id, unit, unit_no::INTEGER AS unit_no, license, max(dice) AS dice FROM hit WHERE dice >= {MIN_DICE} GROUP BY doc_id, unit, unit_no, license
"""
