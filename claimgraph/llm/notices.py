"""License scan by more notices, full texts and runs of consecutive lines.

op2_licenses has the notices and units of its SQL. Here units are the whole text, each line
and each run of two or more consecutive lines of at most RUN_WORDS words in all that begins
and ends with a line that has words; templates are those of op2_licenses, further notices
and the full texts in license_texts/. Of a unit's matches the best stay, and of the runs
and lines of one license that lie within one another the best. Templates of more than
RUN_WORDS words meet whole texts alone.
"""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgraph.llm.common import cut, no_clash, table
from claimgraph.llm.licenses import _GRAMS, _WORDS, MIN_DICE, TEMPLATES, _normal_words, bigrams_of

RUN_WORDS = 400
_SA = "This work is licensed under {}."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
NOTICES = {
    "GPL-3.0-line": _SA.format("the GNU General Public License, version 3"),
    "GPL-2.0-line": _SA.format("the GNU General Public License, version 2"),
    "LGPL-3.0-line": _SA.format("the GNU Lesser General Public License, version 3"),
    "LGPL-2.1-line": _SA.format("the GNU Lesser General Public License, version 2.1"),
    "AGPL-3.0-line": _SA.format("the GNU Affero General Public License, version 3"),
    "GPL-2.0-or-later": _GNU.format("General Public License", "2"),
    "LGPL-3.0-or-later": _GNU.format("Lesser General Public License", "3"),
    "LGPL-2.1-or-later": _GNU.format("Lesser General Public License", "2.1"),
    "AGPL-3.0-or-later": _GNU.format("Affero General Public License", "3"),
    **{f"CC-{k}-4.0-line": f"Licensed under CC {k} 4.0." for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{
        f"CC-{k}-4.0-long": _SA.format(f"a Creative Commons Attribution-{name} 4.0 International License")
        for k, name in (("BY-NC", "NonCommercial"), ("BY-ND", "NoDerivatives"), ("BY-NC-SA", "NonCommercial-ShareAlike"), ("BY-NC-ND", "NonCommercial-NoDerivatives"))
    },
    "MIT-line": "Licensed under the MIT License.",
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause-line": "Licensed under the BSD 2-Clause License.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, version 2.0.",
    "EPL-2.0-line": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}
FULL = {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
ALL = TEMPLATES | NOTICES | FULL


def telling_words(templates: dict[str, str], min_dice: float) -> list[str]:
    """Words of which every unit that matches a template holds one: of each template they
    cover one bigram more than a match can leave unmet. Three words are there from the start;
    words chosen before and long words that cover many bigrams come first."""
    share = min_dice / (2 - min_dice)
    chosen = {"cc", "license", "licensed"}
    for text in templates.values():
        grams = {tuple(g.split()) for g in bigrams_of(text)}
        open_ = len(grams) - math.ceil(len(grams) * share - 1e-9) + 1
        left = [g for g in grams if not chosen.intersection(g)]
        open_ -= len(grams) - len(left)
        while open_ > 0 and left:
            count = Counter(w for g in left for w in set(g))
            word = max(count, key=lambda w: (min(len(w), 7), count[w], w))
            chosen.add(word)
            open_ -= count[word]
            left = [g for g in left if word not in g]
    return sorted(chosen)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_dice: float = MIN_DICE, run_words: int = RUN_WORDS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, first, last, license, common, n_unit, n_template,
    dice): first and last are a unit's lines from 1, and 0 for the whole text.

    Null and empty texts match nothing; rows that repeat an id repeat their matches. No rows:
    no rows."""
    templates = {n: t for n, t in (ALL if templates is None else templates).items() if bigrams_of(t)}
    spark = docs.sparkSession
    if not templates:
        return spark.createDataFrame([], "doc_id long, first int, last int, license string, common long, n_unit int, n_template int, dice double")
    share = min_dice / (2 - min_dice)
    sizes = {n: len(bigrams_of(t)) for n, t in templates.items()}
    low, high = math.ceil(min(sizes.values()) * share - 1e-9), math.floor(max(sizes.values()) / share + 1e-9)
    word = "(?<![0-9a-z])(?:{})(?![0-9a-z])"
    telling = word.format("|".join(telling_words(templates, min_dice)))
    # a run has fewer bigrams than run_words
    in_runs = word.format("|".join(telling_words({n: t for n, t in templates.items() if sizes[n] * share <= run_words}, min_dice)))
    docs = no_clash(docs, "row").select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    # written once, as three kinds of units are read from it
    docs = cut(docs.filter(F.lower("text").rlike(telling)), "license-texts")
    lines = docs.withColumn("lines", F.split("text", "\n", -1)).filter("size(lines) > 1").select("doc_id", "row", F.posexplode("lines").alias("k", "x"))
    # a run's lines have words; those from a start on lie within run_words of its first word
    worded = lines.withColumn("n", F.size(F.filter(_normal_words(F.col("x")), lambda w: w != ""))).filter("n > 0")
    upto = worded.withColumn("hit", F.lower("x").rlike(in_runs)).withColumn("upto", F.sum("n").over(W.partitionBy("row").orderBy("k")))
    ahead = F.collect_list(F.struct("k", "upto", "hit", "x")).over(W.partitionBy("row").orderBy("upto").rangeBetween(0, run_words))
    starts = upto.select("doc_id", "row", F.col("k").alias("i"), (F.col("upto") - F.col("n") + run_words).alias("most"), ahead.alias("ahead"))
    starts = starts.withColumn("ahead", F.expr("filter(ahead, y -> y.upto <= most)")).withColumn("told", F.expr("array_position(transform(ahead, y -> y.hit), true)"))
    starts = starts.filter("told > 0 and size(ahead) > 1").withColumn("len", F.explode(F.expr("sequence(greatest(2, cast(told as int)), greatest(size(ahead), cast(told as int), 2))"))).filter("len <= size(ahead)")
    run = starts.select("doc_id", "row", (F.col("i") + 1).alias("first"), F.expr("ahead[len - 1].k + 1").alias("last"), F.expr("array_join(transform(slice(ahead, 1, len), y -> y.x), ' ')").alias("x"))
    single = lines.filter(F.lower("x").rlike(telling))
    single = single.select("doc_id", "row", (F.col("k") + 1).alias("first"), (F.col("k") + 1).alias("last"), "x")
    whole = docs.select("doc_id", "row", F.lit(0).alias("first"), F.lit(0).alias("last"), F.col("text").alias("x"))
    units = whole.unionByName(single).unionByName(run).select("doc_id", "row", "first", "last", _normal_words(F.col("x")).alias("w")).filter("size(w) > 1")
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    units = units.select("doc_id", "row", "first", "last", F.array_distinct(pairs).alias("grams")).withColumn("n_unit", F.size("grams")).filter(F.col("n_unit").between(low, high))
    rows = [(n, sizes[n], g) for n, t in templates.items() for g in sorted(bigrams_of(t))]
    grams = F.broadcast(spark.createDataFrame(rows, "license string, n_template int, gram string"))
    fits = (F.col("n_unit") >= F.col("n_template") * share - 1e-9) & (F.col("n_unit") * share <= F.col("n_template") + 1e-9)
    met = units.select("doc_id", "row", "first", "last", "n_unit", F.explode("grams").alias("gram")).join(grams, "gram").filter(fits)
    unit = ["doc_id", "row", "first", "last", "n_unit"]
    found = met.groupBy(*unit, "license", "n_template").agg(F.count(F.lit(1)).alias("common"))
    found = found.withColumn("dice", 2.0 * F.col("common") / (F.col("n_unit") + F.col("n_template"))).filter(F.col("dice") >= min_dice - 1e-12)
    of_unit = found.groupBy(*unit).agg(F.max("dice").alias("top"), F.collect_list(F.struct("license", "n_template", "common", "dice")).alias("m"))
    best = of_unit.select(*unit, "top", F.explode("m").alias("m")).filter("m.dice = top").select(*unit, "m.*")
    of_row = best.groupBy("doc_id", "row", "license").agg(F.collect_list(F.struct("first", "last", "common", "n_unit", "n_template", "dice")).alias("m"))
    kept = F.expr(
        """filter(m, x -> x.last = x.first or not exists(m, y -> y.first > 0 and (y.dice > x.dice or (y.dice = x.dice and y.last - y.first < x.last - x.first))
        and ((y.first <= x.first and y.last >= x.last) or (y.first >= x.first and y.last <= x.last))))"""
    )
    out = of_row.select("doc_id", "license", F.explode(kept).alias("x"))
    return out.select("doc_id", "x.first", "x.last", "license", "x.common", "x.n_unit", "x.n_template", "x.dice")


def op2_license_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_runs": op2_license_runs}
_VALUES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in ALL.items())
ORACLE_SQL = {
    "op2_license_runs": f"""
WITH t AS (SELECT license, {_GRAMS} AS g FROM (SELECT license, {_WORDS.format('body')} AS w FROM (VALUES {_VALUES}) v(license, body))),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
k AS (
  SELECT doc_id, k, x, len(list_filter({_WORDS.format('x')}, lambda w: w <> '')) AS n
  FROM (SELECT doc_id, unnest(range(1, len(l) + 1))::INTEGER AS k, unnest(l) AS x FROM d WHERE len(l) > 1)
), c AS (SELECT doc_id, k, n, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM k),
u AS (
  SELECT doc_id, 0 AS first, 0 AS last, text AS x FROM d
  UNION ALL SELECT doc_id, k, k, x FROM k
  UNION ALL
  SELECT a.doc_id, a.k, b.k, array_to_string(d.l[a.k:b.k], ' ')
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.k < b.k AND b.upto - a.upto + a.n <= {RUN_WORDS} AND a.n > 0 AND b.n > 0 JOIN d ON d.doc_id = a.doc_id
), g AS (SELECT doc_id, first, last, {_GRAMS} AS g FROM (SELECT doc_id, first, last, {_WORDS.format('x')} AS w FROM u) WHERE len(w) > 1),
m AS (
  SELECT doc_id, first, last, license, len(list_intersect(g.g, t.g)) AS common, len(g.g)::INTEGER AS n_unit, len(t.g)::INTEGER AS n_template
  FROM g, t WHERE len(g.g) <= len(t.g) * 1.5 + 1e-9 AND len(t.g) <= len(g.g) * 1.5 + 1e-9
), s AS (
  SELECT *, 2.0::DOUBLE * common / (n_unit + n_template) AS dice FROM m WHERE 2.0::DOUBLE * common / (n_unit + n_template) >= {MIN_DICE} - 1e-12
), b AS (SELECT * FROM s QUALIFY dice = max(dice) OVER (PARTITION BY doc_id, first, last))
SELECT * FROM b x WHERE first = last OR NOT EXISTS (
  SELECT 1 FROM b y WHERE y.doc_id = x.doc_id AND y.license = x.license AND y.first > 0
  AND (y.dice > x.dice OR (y.dice = x.dice AND y.last - y.first < x.last - x.first))
  AND ((y.first <= x.first AND y.last >= x.last) OR (y.first >= x.first AND y.last <= x.last)))
"""
}
