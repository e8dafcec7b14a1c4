"""License scans by Dice coefficient over word bigrams (operator 10), in DataFrame functions only.

Text is normalised (A-Z lowered, all but a-z and 0-9 a space) and cut into
units: its lines, and the whole text. A unit matches a template when the Dice
coefficient of their sets of word bigrams is at least THRESHOLD. Dice bounds
the sizes, |A| >= t / (2 - t) * |B| and the reverse, so only templates within
the bounds are compared. Each document is judged in its own row: no shuffle.

Defined results: a null or empty text has no units, so no licence and a best
score of 0; ties between templates go to the smallest name; a unit of one
word has that word as its only bigram; repeated rows give repeated results;
columns besides the id and the text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .urls import LOWER, UPPER

THRESHOLD = 0.8

#: License name and notice.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def normalised(text):
    return F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9\n]+", " ")


def bigrams(words):
    """Distinct bigrams of an array of words; a single word stands for itself."""
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(F.when(F.size(words) == 1, words).otherwise(pairs))


def _words(line):
    return F.filter(F.split(line, " "), lambda w: w != "")


def license_scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, licenses, best_license, best_dice, n_units): distinct licences found, the best one, and how many units matched."""
    notices = F.array(*[F.struct(F.lit(name).alias("name"), bigrams(_words(F.regexp_replace(normalised(F.lit(notice)), "\n", " "))).alias("grams")) for name, notice in templates])
    known = df.sparkSession.range(1).select(notices.alias("n")).first()["n"]
    sizes = [len(n["grams"]) for n in known]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    fixed = F.array(*[F.struct(F.lit(n["name"]).alias("name"), F.lit(list(n["grams"])).alias("grams")) for n in known])
    lines = F.split(normalised(F.coalesce(F.col(text), F.lit(""))), "\n")
    # distinct bigrams number at most the words, and at least the distinct words less one,
    # so units of other sizes fall out before their bigrams are made
    # (few words have few distinct ones, and where the first words are too many kinds all are)
    most = F.lit(max(sizes) * high)
    few = lambda w: F.size(F.array_distinct(w)) - 1 <= most
    fits = lambda w: (F.size(w) >= F.lit(min(sizes) * low)) & ((F.size(w) - 1 <= most) | (few(F.slice(w, 1, 2 * math.ceil(max(sizes) * high))) & few(w)))
    rows = df.select(F.col(key).alias("key"), F.transform(lines, _words).alias("lines"))
    whole = F.when(F.size("lines") > 1, F.array(F.flatten("lines"))).otherwise(F.array().cast("array<array<string>>"))
    rows = rows.select("key", F.transform(F.filter(F.concat("lines", whole), fits), bigrams).alias("units"))
    near = lambda a, b: (F.size(a) >= F.size(b) * low) & (F.size(a) <= F.size(b) * high)
    dice = lambda a, b: F.size(F.array_intersect(a, b)) * 2.0 / (F.size(a) + F.size(b))
    best = lambda u: F.array_min(F.transform(F.filter(F.col("known"), lambda t: near(u, t["grams"])), lambda t: F.struct((-dice(u, t["grams"])).alias("less"), t["name"].alias("name"))))
    rows = rows.withColumn("known", fixed).select("key", F.filter(F.transform("units", best), lambda m: m.isNotNull()).alias("best"))
    hits = rows.select("key", F.array_min("best").alias("top"), F.filter("best", lambda m: m["less"] <= -threshold).alias("hits"))
    found = F.array_sort(F.array_distinct(F.transform("hits", lambda m: m["name"])))
    return hits.select(
        F.col("key").alias(key),
        found.alias("licenses"),
        F.when(F.size("hits") > 0, F.col("top.name")).alias("best_license"),
        F.coalesce(F.abs("top.less"), F.lit(0.0)).alias("best_dice"),
        F.size("hits").cast("long").alias("n_units"),
    )


def license_passages(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, licenses, best_license, best_dice): licences of notices anywhere in the text, over line ends and among other words.

    Windows of each template's number of words are compared with it. A window
    that matches shares one of the template's anchors, which are so many of its
    bigrams that a window without them falls short; only windows around these
    are looked at. Of matching windows that overlap the best counts, on ties the
    smallest name. best_dice is 0 where no window matches.
    """
    given = F.array(*[F.struct(F.lit(name).alias("name"), _words(F.regexp_replace(normalised(F.lit(notice)), "\n", " ")).alias("words")) for name, notice in templates])
    known = []
    for n, w in df.sparkSession.range(1).select(given.alias("n")).first()["n"]:
        grams = list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))
        # a window's distinct bigrams number at most len(w) - 1, so this many are in common at least
        least = math.ceil(threshold * len(grams) / (2 - threshold) - 1e-9)
        known.append((n, len(w) - 1, grams, sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - least + 1]))
    fixed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(size).alias("size"), F.lit(g).alias("grams"), F.lit(x).alias("anchors")) for n, size, g, x in known])
    words = _words(F.regexp_replace(normalised(F.coalesce(F.col(text), F.lit(""))), "\n", " "))
    rows = df.select(F.col(key).alias("key"), words.alias("w"))
    rows = rows.select("key", F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1))).alias("grams"))
    anchors = sorted({x for *_, own in known for x in own})
    places = F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("i"), g.alias("g"))), lambda h: h["g"].isin(anchors))
    rows = rows.withColumn("places", places).withColumn("known", fixed)

    def starts(t):
        ends = lambda h: (F.greatest(F.lit(0), h["i"] - t["size"] + 1), F.least(h["i"], F.size("grams") - t["size"]))
        near = F.transform(F.filter("places", lambda h: F.array_contains(t["anchors"], h["g"])), lambda h: F.when(ends(h)[0] <= ends(h)[1], F.sequence(*ends(h))).otherwise(F.array().cast("array<int>")))
        return F.array_distinct(F.flatten(near))

    def window(t, at):
        own = F.array_distinct(F.slice("grams", at + 1, t["size"]))
        less = F.size(F.array_intersect(own, t["grams"])) * -2.0 / (F.size(own) + F.size(t["grams"]))
        return F.struct(less.alias("less"), t["name"].alias("name"), at.alias("at"), t["size"].alias("size"))

    found = F.flatten(F.transform("known", lambda t: F.filter(F.transform(starts(t), lambda at: window(t, at)), lambda m: m["less"] <= -threshold)))
    rows = rows.select("key", found.alias("found"))
    # a window of so many bigrams has one word more
    better = lambda v, m: (v["at"] <= m["at"] + m["size"]) & (m["at"] <= v["at"] + v["size"]) & ((v["less"] < m["less"]) | ((v["less"] == m["less"]) & (v["name"] < m["name"])))
    rows = rows.select("key", F.filter("found", lambda m: ~F.exists("found", lambda v: better(v, m))).alias("hits"), F.array_min("found").alias("top"))
    return rows.select(F.col("key").alias(key), F.array_sort(F.array_distinct(F.transform("hits", lambda m: m["name"]))).alias("licenses"), F.col("top.name").alias("best_license"), F.coalesce(F.abs("top.less"), F.lit(0.0)).alias("best_dice"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = rf"""
WITH given(name, notice) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in TEMPLATES)}),
twords AS (SELECT name, notice, list_filter(string_split(regexp_replace(translate(notice, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM given),
known AS (SELECT name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM twords),
plain AS (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS l FROM documents),
cut AS (SELECT doc_id, unnest(CASE WHEN len(l) > 1 THEN list_append(l, array_to_string(l, ' ')) ELSE l END) AS u FROM plain),
words AS (SELECT doc_id, list_filter(string_split(u, ' '), lambda w: w <> '') AS w FROM cut),
units AS (SELECT row_number() OVER () AS unit, doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS u FROM words WHERE len(w) >= 2),
near AS (
  SELECT unit, doc_id, name, len(list_intersect(u, g)) * 2.0::DOUBLE / (len(u) + len(g)) AS dice
  FROM units JOIN known ON len(u) >= len(g) * {THRESHOLD / (2 - THRESHOLD)!r}::DOUBLE AND len(u) <= len(g) * {(2 - THRESHOLD) / THRESHOLD!r}::DOUBLE),
best AS (SELECT unit, doc_id, min(struct_pack(less := -dice, name := name)) AS b FROM near GROUP BY unit, doc_id),
per AS (
  SELECT doc_id, min(b) AS top, count(*) FILTER (WHERE b.less <= -{THRESHOLD}) AS n,
    list_sort(list_distinct(list(b.name) FILTER (WHERE b.less <= -{THRESHOLD}))) AS found
  FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(found, ','), '') AS licenses, CASE WHEN n > 0 THEN top.name END AS best_license,
  round(coalesce(abs(top.less), 0.0::DOUBLE), 9) AS best_dice, coalesce(n, 0)::BIGINT AS n_units
FROM documents LEFT JOIN per USING (doc_id)
"""
