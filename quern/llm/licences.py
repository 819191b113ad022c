"""Licence scan: Dice coefficient over word bigrams, in DataFrame operations only, without a shuffle.

A text is cut into units: its lines, its paragraphs (parts between blank lines), the whole, and windows.
A unit and a template are normalised alike: A-Z to lower case, each run of other characters than a-z and
0-9 to a space, trimmed. Their bigrams are counted with repeats, so a unit of w words has w - 1 (one for
a single word: the word itself). With a least score t the sizes of a match lie between t / (2 - t) and
(2 - t) / t of the template's, so most units meet no template at all, and no bigram of theirs is made.

Windows find a notice beside other words, in a comment block or over several lines. In the words of the
whole text, each bigram of a template of n bigrams, at its first place in the template, says where a copy
would start; a start named by ``support`` of them gives the window of n bigrams there, cut at the ends of
the text. An undisturbed copy always gets its window. A window with b breaks in its copy has at most b + 1
stretches of one start; a break costs two bigrams, so the longest stretch of a match has ``support`` (or all different bigrams, if a template has fewer).
Every text with a template's window holds one of its ``anchors``, so other texts are not searched. A
template of one word has no windows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST = Fraction(8, 10)
#: Public wordings of licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def bigrams(text: str) -> list[str]:
    words = normal(text).split(" ") if normal(text) else []
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] if len(words) > 1 else words


def bounds(size: int, least: Fraction = LEAST) -> tuple[int, int]:
    """Sizes that can reach ``least`` against a template of ``size`` bigrams."""
    return math.ceil(size * least / (2 - least)), math.floor(size * (2 - least) / least)


def support(size: int, least: Fraction = LEAST) -> int:
    """Bigrams of one start that the longest stretch of a matching window of ``size`` bigrams has."""
    hits = math.ceil(size * least)
    return math.ceil(Fraction(hits, (size - hits) // 2 + 1))


def anchors(grams: list[str], least: Fraction = LEAST) -> list[str]:
    """Words, long ones first, in more bigrams than a match can lack: a text without them has no match."""
    lacking, chosen = len(grams) - bounds(len(grams), least)[0], []
    for word in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (-len(w), w)):
        if sum(not set(chosen).isdisjoint(g.split(" ")) for g in grams) > lacking:
            break
        chosen.append(word)
    return chosen


def places(text: str) -> dict[str, int]:
    """First place of each bigram of a template; none for a template of one word."""
    found: dict[str, int] = {}
    for j, gram in enumerate(bigrams(text)):
        if " " in gram:
            found.setdefault(gram, j)
    return found


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: Fraction = LEAST, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) and licences: array of (licence, score, unit), in order of name and unit.

    A unit that a text repeats counts once; a line and a window that differ are two units. Null and empty texts have no licence. Rows are independent,
    so ties, repeated rows and null ids don't matter; an input column named licences is replaced. An empty
    table gives no rows. Templates without a word are refused.
    """
    templates = templates or TEMPLATES
    grams = {name: Counter(bigrams(text)) for name, text in templates.items()}
    if not all(grams.values()):
        raise ValueError("a template has no words")
    sizes = {name: sum(c.values()) for name, c in grams.items()}
    spans = {name: bounds(n, least) for name, n in sizes.items()}
    # Words that a unit of some template's sizes can have; a single word counts as its own bigram.
    words = "(length({0}) - length(replace({0}, ' ', '')) + 1)"
    ranges: list[list[int]] = []
    for lo, hi in sorted((1 if lo <= 1 else lo + 1, hi + 1) for lo, hi in spans.values()):
        if ranges and lo <= ranges[-1][1] + 1:
            ranges[-1][1] = max(hi, ranges[-1][1])
        else:
            ranges.append([lo, hi])
    fits = lambda n: "(" + " OR ".join(f"{n} BETWEEN {lo} AND {hi}" for lo, hi in ranges) + ")"
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in (keep or docs.columns) if c != "licences"]
    made = "licences"
    rows = docs.select(*keep, text.alias(made))
    normalised = f"trim(' ', regexp_replace(translate(u, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' '))"
    counted = f"transform({{}}, u -> struct(u AS u, {words.format('u')} AS n))"
    lines = counted.format(f"filter(transform(split({made}, '\n'), u -> {normalised}), u -> u <> '')")
    parts = counted.format(f"filter(transform(split({made}, '\n[ \t\r]*\n'), u -> {normalised}), u -> u <> '')")
    parts = f"IF({made} RLIKE '\n[ \t\r]*\n', {parts}, array())"
    # The words of the whole are those of its lines, so the whole is put together only where its size fits.
    rows = rows.select(*keep, F.expr(lines).alias("_lines"), F.expr(parts).alias("_parts"))
    rows = rows.withColumn("_words", F.expr("aggregate(_lines, 0, (n, u) -> n + u.n)"))
    chosen = f"transform(filter({{}}, u -> {fits('u.n')}), u -> u.u)"
    whole = f"IF({fits('_words')}, array(array_join(transform(_lines, u -> u.u), ' ')), array())"
    rows = _windows(rows, templates, sizes, least)
    units = f"array_distinct(concat({chosen.format('_lines')}, {chosen.format('_parts')}, {whole}, _windows))"
    rows = rows.select(*keep, F.expr(f"transform({units}, u -> split(u, ' '))").alias(made))
    pairs = "IF(size(w) = 1, w, transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])))"
    rows = rows.withColumn(made, F.when(F.size(made) > 0, F.expr(f"transform({made}, w -> struct(array_join(w, ' ') AS unit, {pairs} AS grams))")))
    # A unit that shares no bigram with any template ends here.
    known = "array(" + ", ".join(map(_sql_text, sorted({g for c in grams.values() for g in c}))) + ")"
    rows = rows.withColumn(made, F.expr(f"filter({made}, u -> arrays_overlap(u.grams, {known}))"))
    rows = rows.withColumn(made, F.when(F.size(made) > 0, F.col(made)))
    found = []
    for name in sorted(templates):
        lo, hi = spans[name]
        both = " + ".join(f"least({n}, size(filter(u.grams, g -> g = {_sql_text(gram)})))" for gram, n in sorted(grams[name].items()))
        score = f"2 * ({both}) / (size(u.grams) + {sizes[name]})"
        found.append(
            f"filter(transform(filter({made}, u -> size(u.grams) BETWEEN {lo} AND {hi}), u -> struct({_sql_text(name)} AS licence, {score} AS score, u.unit AS unit)),"
            f" x -> x.score >= {float(least)!r}D)"
        )
    return rows.withColumn(made, F.expr(f"IF({made} IS NULL, array(), array_sort(concat({', '.join(found)}), (a, b) -> CASE WHEN a.licence < b.licence THEN -1 WHEN a.licence > b.licence THEN 1 WHEN a.unit < b.unit THEN -1 WHEN a.unit > b.unit THEN 1 ELSE 0 END))"))


def _windows(rows: DataFrame, templates: dict[str, str], sizes: dict[str, int], least: Fraction) -> DataFrame:
    """Column _windows: texts of the windows of all templates, from the words of _lines."""
    longer = {name: places(text) for name, text in sorted(templates.items()) if places(text)}
    if not longer:
        return rows.withColumn("_windows", F.expr("CAST(array() AS array<string>)"))
    listed = lambda words: ", ".join(map(_sql_text, words))
    marks = sorted({a for name in longer for a in anchors(bigrams(templates[name]), least)})
    known = sorted({g for spots in longer.values() for g in spots})
    rows = rows.withColumn("_all", F.expr("split(array_join(transform(_lines, u -> u.u), ' '), ' ')"))
    rows = rows.withColumn("_all", F.expr(f"IF(_words > 1 AND arrays_overlap(_all, array({listed(marks)})), _all, NULL)"))
    gram = "concat(_all[i], ' ', _all[i + 1])"
    rows = rows.withColumn("_hits", F.expr(f"IF(_all IS NULL, NULL, filter(sequence(0, size(_all) - 2), i -> {gram} IN ({listed(known)})))"))
    rows = rows.withColumn("_hits", F.expr(f"transform(_hits, i -> struct(i AS i, {gram} AS g))"))
    starts = []
    for name, spots in longer.items():
        # A place that repeats an earlier bigram's is held by a null, which no bigram equals.
        order = bigrams(templates[name])
        spot = "array(" + ", ".join(_sql_text(g) if spots[g] == j else "CAST(NULL AS string)" for j, g in enumerate(order)) + ")"
        found = f"transform(filter(_hits, x -> x.g IN ({listed(spots)})), x -> x.i + 1 - CAST(array_position({spot}, x.g) AS int))"
        starts.append(f"struct({sizes[name]} AS n, {min(len(spots), support(sizes[name], least))} AS m, array_sort({found}) AS a)")
    rows = rows.withColumn("_starts", F.expr(f"IF(_hits IS NULL, NULL, filter(array({', '.join(starts)}), t -> size(t.a) >= t.m))"))
    # In sorted starts, the first of a run that is long enough.
    run = "filter(sequence(0, size(t.a) - t.m), k -> t.a[k + t.m - 1] = t.a[k] AND (k = 0 OR t.a[k - 1] <> t.a[k]))"
    rows = rows.withColumn("_starts", F.expr(f"flatten(transform(_starts, t -> transform({run}, k -> struct(t.a[k] AS s, t.n AS n))))"))
    cut = "slice(_all, greatest(x.s, 0) + 1, least(x.s + x.n + 1, size(_all)) - greatest(x.s, 0))"
    return rows.withColumn("_windows", F.expr(f"coalesce(transform(_starts, x -> array_join({cut}, ' ')), array())"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: the best licence (by score, then name), its score, and how many units matched."""
    made = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    best = F.expr("array_sort(licences, (a, b) -> CASE WHEN a.score > b.score THEN -1 WHEN a.score < b.score THEN 1 WHEN a.licence < b.licence THEN -1 WHEN a.licence > b.licence THEN 1 ELSE 0 END)[0]")
    made = made.withColumn("best", F.when(F.size("licences") > 0, best))
    return made.select("doc_id", F.col("best.licence").alias("licence"), F.round("best.score", 6).alias("score"), F.size("licences").cast("long").alias("n_matches"))


def _op5_sql() -> str:
    spots = ", ".join(f"('{n}', '{g}', {j}, {len(bigrams(t))}, {min(len(places(t)), support(len(bigrams(t))))})" for n, t in sorted(TEMPLATES.items()) for g, j in places(t).items())
    grams = ", ".join(f"('{n}', '{g}', {c})" for n, t in sorted(TEMPLATES.items()) for g, c in sorted(Counter(bigrams(t)).items()))
    return f"""
WITH template_grams(licence, gram, n) AS (VALUES {grams}),
template_spots(licence, gram, j, n, m) AS (VALUES {spots}),
templates AS (SELECT licence, sum(n) AS size FROM template_grams GROUP BY licence),
texts AS (SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
starts AS (
  SELECT g.doc_id, g.i - s.j AS s, s.n
  FROM (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS i FROM texts)) g JOIN template_spots s USING (gram)
  GROUP BY g.doc_id, s.licence, g.i - s.j, s.n, s.m HAVING count(*) >= s.m
),
units AS (
  SELECT doc_id, array_to_string(w[greatest(s, 0) + 1 : least(s + n + 1, len(w))], ' ') AS unit FROM starts JOIN texts USING (doc_id)
  UNION
  SELECT doc_id, trim(regexp_replace(translate(u, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' ') AS unit
  FROM (SELECT doc_id, unnest(list_concat(string_split(t, chr(10)), string_split_regex(t, '\\n[ \\t\\r]*\\n'), [t])) AS u
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
),
sized AS (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM units WHERE unit <> ''),
near AS (SELECT * FROM sized WHERE len(w) <= (SELECT max(size) * 2 FROM templates)),
unit_grams AS (
  SELECT doc_id, unit, gram, count(*) AS n FROM (
    SELECT doc_id, unit, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS gram
    FROM (SELECT doc_id, unit, w, unnest(range(1, greatest(len(w), 2))) AS i FROM near))
  GROUP BY ALL
),
scored AS (
  SELECT u.doc_id, u.unit, t.licence, 2.0 * sum(least(u.n, t.n)) / (any_value(greatest(1, len(string_split(u.unit, ' ')) - 1)) + any_value(s.size)) AS score
  FROM unit_grams u JOIN template_grams t USING (gram) JOIN templates s ON s.licence = t.licence
  GROUP BY u.doc_id, u.unit, t.licence
),
hits AS (SELECT * FROM scored WHERE score >= 0.8),
best AS (SELECT doc_id, licence, score, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS k FROM hits)
SELECT d.doc_id, b.licence, round(b.score, 6) AS score, coalesce(b.n, 0) AS n_matches
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.k = 1
"""


OP5_SQL = _op5_sql()
