"""License scan by Dice coefficient over word bigrams, in DataFrame functions only.

Units of a text are the whole text and each of its lines. A unit and a template are
normalised alike (lower case, everything but letters and digits to a space) and compared as
sets of word bigrams: 2 * common / (a + b). A coefficient of t needs sizes within a factor
of t / (2 - t), and it needs more than (1 - t / (2 - t)) of a template's bigrams to be
missing for none of any chosen rest to be present: one of a template's most telling
bigrams, chosen so, must occur in the unit. Both bounds are exact and follow from the
templates alone; what passes them is joined with the templates by bigram.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.common import no_clash, table

MIN_DICE = 0.8
#: Short public notices of common licences; callers may pass others.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-only": "Licensed under the GNU General Public License, version 2 only.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).split()


def bigrams_of(text: str) -> set[str]:
    w = words_of(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def telling_words(templates: dict[str, str], min_dice: float) -> list[str]:
    """A few words of which every unit that matches a template holds one.

    A match leaves at most n - ceil(n * t / (2 - t)) of a template's n bigrams unmet, so it
    has one of any n - ceil(...) + 1 of them. Of each template the bigrams with its longest
    words are taken, and a word covers a bigram that holds it."""
    share = min_dice / (2 - min_dice)
    chosen: set[str] = set()
    for text in templates.values():
        grams = sorted((tuple(g.split()) for g in bigrams_of(text)), key=lambda g: (-max(map(len, g)), g))
        for g in grams[: len(grams) - math.ceil(len(grams) * share - 1e-9) + 1]:
            if not chosen.intersection(g):
                chosen.add(max(g, key=lambda w: (len(w), w)))
    return sorted(chosen)


def _normal_words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))
    return F.split(plain, " ")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, unit, license, common, n_unit, n_template, dice):
    every template that a unit matches with min_dice or more. unit is 0 for the whole text
    and else the line's number from 1; a text of one line has unit 0 alone.

    Null and empty texts and units of fewer than two words match nothing; rows that repeat
    an id are told apart by nothing, and repeat their matches. Templates of fewer than two
    words match nothing. Other columns are not read. No rows: no rows."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    sizes = {name: len(bigrams_of(text)) for name, text in templates.items()}
    templates = {name: text for name, text in templates.items() if sizes[name]}
    schema = "doc_id long, row long, unit int, license string, common long, n_unit int, n_template int, dice double"
    if not templates:
        return spark.createDataFrame([], schema).drop("row")
    share = min_dice / (2 - min_dice)
    low = math.ceil(min(sizes[t] for t in templates) * share - 1e-9)
    high = math.floor(max(sizes[t] for t in templates) / share + 1e-9)
    telling = f"(?<![0-9a-z])(?:{'|'.join(telling_words(templates, min_dice))})"
    docs = no_clash(docs, "row", "unit", "unit_text").select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    lines = F.split(F.col("text"), "\n", -1)
    # a unit without a telling word is left out before it is taken to words
    units = docs.filter(F.lower("text").rlike(telling)).select(
        "doc_id", "row", F.posexplode(F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(F.array("text"))).alias("unit", "unit_text")
    )
    units = units.filter(F.lower("unit_text").rlike(telling)).select("doc_id", "row", "unit", _normal_words(F.col("unit_text")).alias("w"))
    units = units.filter(F.size("w") > 1).select(
        "doc_id", "row", "unit", F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("grams")
    )
    units = units.select("*", F.size("grams").alias("n_unit")).filter(F.col("n_unit").between(low, high))
    rows = [(name, sizes[name], g) for name, text in templates.items() for g in sorted(bigrams_of(text))]
    grams = spark.createDataFrame(rows, "license string, n_template int, gram string")
    fits = (F.col("n_unit") >= F.col("n_template") * share - 1e-9) & (F.col("n_unit") * share <= F.col("n_template") + 1e-9)
    met = units.select("doc_id", "row", "unit", "n_unit", F.explode("grams").alias("gram")).join(grams, "gram").filter(fits)
    found = met.groupBy("doc_id", "row", "unit", "license", "n_unit", "n_template").agg(F.count(F.lit(1)).alias("common"))
    dice = 2.0 * F.col("common") / (F.col("n_unit") + F.col("n_template"))
    return found.withColumn("dice", dice).filter(F.col("dice") >= min_dice - 1e-12).select("doc_id", "unit", "license", "common", "n_unit", "n_template", "dice")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_licenses": op2_licenses}
_VALUES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
_GRAMS = "list_distinct(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2]))"
_WORDS = "string_split(trim(regexp_replace(lower({}), '[^0-9a-z]+', ' ', 'g')), ' ')"
ORACLE_SQL = {
    "op2_licenses": f"""
WITH t AS (SELECT license, {_GRAMS} AS g FROM (SELECT license, {_WORDS.format('body')} AS w FROM (VALUES {_VALUES}) v(license, body))),
u AS (
  SELECT doc_id, 0 AS unit, text AS x FROM documents
  UNION ALL
  SELECT doc_id, unnest(range(1, len(l) + 1))::INTEGER, unnest(l) FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) > 1
), g AS (
  SELECT doc_id, unit, {_GRAMS} AS g FROM (SELECT doc_id, unit, {_WORDS.format('x')} AS w FROM u) WHERE len(w) > 1
), m AS (
  SELECT doc_id, unit, license, len(list_intersect(g.g, t.g)) AS common, len(g.g)::INTEGER AS n_unit, len(t.g)::INTEGER AS n_template
  FROM g, t WHERE len(g.g) <= len(t.g) * 1.5 + 1e-9 AND len(t.g) <= len(g.g) * 1.5 + 1e-9
)
SELECT doc_id, unit, license, common, n_unit, n_template, 2.0::DOUBLE * common / (n_unit + n_template) AS dice
FROM m WHERE 2.0::DOUBLE * common / (n_unit + n_template) >= {MIN_DICE} - 1e-12
"""
}
