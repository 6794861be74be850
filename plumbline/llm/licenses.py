"""Licence scans: Dice coefficient over word bigrams, with size bounds pruning the templates."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored, table

THRESHOLD = 0.8
#: Words that most English texts have.
COMMON = {"a", "an", "and", "as", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with"}
#: Licence names and the ways in which a text states them.
NAMES = {
    "MIT": ("MIT License",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "ISC": ("ISC License",),
    "GPL-2.0": ("GNU General Public License, version 2",), "GPL-3.0": ("GNU General Public License, version 3",), "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",), "LGPL-3.0": ("GNU Lesser General Public License, version 3",), "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",), "EPL-2.0": ("Eclipse Public License, version 2.0",), "CC0-1.0": ("CC0 1.0 Universal",), "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), "CC-BY-ND-4.0": ("CC BY-ND 4.0",), "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",), "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",), "Unlicense": ("The Unlicense",),
}
STATEMENTS = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This software is distributed under the terms of the {}.")
#: Notices that licences ask to be kept, as published with them.
NOTICES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}


def default_templates() -> list[tuple[str, str]]:
    """(licence, text): each statement with each of a licence's names, and the notices."""
    made = [(i, s.format(n)) for i, names in NAMES.items() for n in names for s in STATEMENTS]
    return made + list(NOTICES.items())


def _normal(text: Column) -> Column:
    """Lower case; all but a-z, 0-9 and line feeds is one space."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\n]+", " ")


def _pairs(words: Column) -> Column:
    """Each word with its follower (null for the last), to be exploded."""
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def _word_count(text: Column) -> Column:
    """Words of a trimmed text with single spaces."""
    return F.length(text) - F.length(F.translate(text, " ", "")) + F.lit(1)


def _template_bigrams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template, license, n_template, a, b, h, in_template: how often a template has a bigram's hash."""
    given = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, license string, body string")
    words = given.select("template", "license", F.split(F.trim(F.translate(_normal(F.col("body")), "\n", " ")), " +").alias("words"))
    words = words.withColumn("n_template", F.size("words") - 1).where("n_template > 0")
    grams = words.select("template", "license", "n_template", F.explode(_pairs(F.col("words"))).alias("p")).where("p.b is not null")
    return grams.groupBy("template", "license", "n_template", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.xxhash64("p.a", "p.b").alias("h")).agg(F.count("*").alias("in_template"))


def _anchors(grams: DataFrame, threshold: float) -> list[str]:
    """Words of which every passage that reaches the threshold has one.

    Dice at the threshold needs t / (2 - t) of a template's bigrams; so many of them contain an
    anchor that the rest are too few. Long words are taken first and COMMON ones
    last, as texts have the former less often; the order changes the cost only.
    """
    of: dict[int, list[tuple[str, str, int]]] = {}
    size: dict[int, int] = {}
    for r in grams.select("template", "n_template", "a", "b", "in_template").collect():
        of.setdefault(r.template, []).append((r.a, r.b, r.in_template))
        size[r.template] = r.n_template
    free = {k: max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9)) - 1 for k, n in size.items()}
    found: list[str] = []
    while True:
        gain: Counter[str] = Counter()
        for k, rest in of.items():
            if sum(n for _, _, n in rest) > free[k]:
                for a, b, n in rest:
                    for w in {a, b}:
                        gain[w] += n
        if not gain:
            return found
        best = max(gain, key=lambda w: (len(w) > 4, w not in COMMON, gain[w], w))
        found.append(best)
        of = {k: [g for g in rest if best not in g[:2]] for k, rest in of.items()}


def _blank() -> Column:
    return F.contains("norm", F.lit("\n\n")) | F.contains("norm", F.lit("\n \n"))


def _texts(docs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """doc_id, row, norm of the texts that have an anchor of the templates; no other text can match."""
    found = F.lit(False)
    anchors = _anchors(grams, threshold)
    for w in anchors:
        if not any(x != w and x in w for x in anchors):
            found = found | F.contains("lower", F.lit(w))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), F.lower("text").alias("lower")).where(found)
    return rows.select("doc_id", "row", _normal(F.col("text")).alias("norm"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Passages of the documents that state a licence.

    doc_id, unit ('line', or 'block': lines up to a blank one, if several), unit_no (from 0),
    license, template (its place in the list), n_bigrams, overlap, dice. Bigrams count as often as
    they occur (and are compared by 64-bit hashes). A passage is told by its template of largest
    Dice coefficient 2 * overlap / (bigrams of both), if that reaches the threshold; ties: the first
    template.

    Dice at the threshold bounds the sizes' ratio by (2 - t) / t, so a passage out of all
    templates' bounds is dropped by its number of words, before any bigram is made, and each pair
    out of bounds before it is counted. The templates' bigrams (a list of the caller, not of the
    input's size) are broadcast, and only bigrams that some template has are shuffled. Null and
    empty texts, and passages under two words, give no rows; rows repeated with the same doc_id and
    passage give one; ids may be null; an empty table gives no rows.
    """
    grams = _template_bigrams(docs.sparkSession, default_templates() if templates is None else templates)
    return _lines_and_blocks(_texts(docs, grams, threshold), grams.drop("a", "b"), threshold)


def _lines_and_blocks(text: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    ratio = (2 - threshold) / threshold
    sizes = [r[0] for r in grams.select("n_template").distinct().collect()]
    fits = F.lit(False)
    for a, b in _merged([(int(-(-n // ratio)), int(n * ratio)) for n in sizes]):
        fits = fits | F.col("n_bigrams").between(a, b)

    blocks = F.when(_blank(), F.split("norm", " ?\n[ \n]*\n ?")).otherwise(F.array("norm"))
    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), x.alias("passage"))
    units = F.concat(F.transform(F.split("norm", "\n"), unit("line")), F.filter(F.transform(blocks, unit("block")), lambda x: F.contains(x["passage"], F.lit("\n"))))
    units = text.select("doc_id", "row", F.explode(units).alias("u"))
    passage = F.trim(F.when(F.col("u.unit") == "block", F.regexp_replace(F.col("u.passage"), "[ \n]+", " ")).otherwise(F.col("u.passage")))
    units = units.select("doc_id", "row", "u.unit", "u.unit_no", passage.alias("passage")).withColumn("n_bigrams", _word_count(F.col("passage")) - 1).where(fits)
    keys = ["doc_id", "row", "unit", "unit_no", "n_bigrams"]
    found = units.select(*keys, F.explode(_pairs(F.split("passage", " "))).alias("p")).where("p.b is not null").select(*keys, F.xxhash64("p.a", "p.b").alias("h"))
    near = (F.col("n_bigrams") * F.lit(ratio) >= F.col("n_template")) & (F.col("n_template") * F.lit(ratio) >= F.col("n_bigrams"))
    found = found.join(F.broadcast(grams), "h").where(near)
    keys += ["template", "license", "n_template"]
    found = found.groupBy(*keys, "h", "in_template").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum(F.least("n", "in_template")).alias("overlap"))
    found = found.withColumn("dice", F.lit(2.0) * F.col("overlap") / (F.col("n_bigrams") + F.col("n_template"))).where(F.col("dice") >= F.lit(threshold))
    best = F.max(F.struct("dice", (-F.col("template")).alias("order"), "license", "overlap")).alias("best")
    found = found.groupBy(*keys[:5]).agg(best)
    return found.select("doc_id", "unit", "unit_no", F.col("best.license").alias("license"), (-F.col("best.order")).alias("template"), "n_bigrams", F.col("best.overlap").alias("overlap"), F.col("best.dice").alias("dice")).distinct()


_WINDOW = "array<struct<dice:double,overlap:long,order:int,place:int,n_bigrams:int,license:string>>"


def scan_anywhere(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of scan_licenses, and those of passages that are no line or block.

    unit 'text' is the whole text, where a blank line parts it. unit 'window' is as many words as
    the template has (fewer at the end of the text), wherever they begin in the text; unit_no is
    the place of its first word. A best window begins with a bigram of its template, so only those
    are scored. Of windows that share words the one of largest Dice is returned (ties: more
    overlap, the first template, the first place), then the next that shares no word with those
    returned, and so on. Lines and blocks don't hide windows.

    A bigram counts in the windows that begin after its in_template-th predecessor of the same
    hash, so the overlaps of all windows are one running sum, in proportion to the bigrams that
    the text and the template share. Texts without as many of them as the threshold needs are
    dropped before, and those without an anchor are not even stored for the two scans. A text's
    shared bigrams are held in memory. Nulls and repeats are as in
    scan_licenses.
    """
    grams = _template_bigrams(docs.sparkSession, default_templates() if templates is None else templates)
    text = stored(_texts(docs, grams, threshold))
    grams = grams.drop("a", "b")
    words = text.select("doc_id", "row", _blank().alias("parted"), F.split(F.trim(F.regexp_replace("norm", "[ \n]+", " ")), " ").alias("words"))
    keys = ["doc_id", "row", "parted", "n_text"]
    hits = words.withColumn("n_text", F.size("words") - 1).select(*keys, F.posexplode(_pairs(F.col("words"))).alias("pos", "p")).where("p.b is not null")
    hits = hits.select(*keys, "pos", F.xxhash64("p.a", "p.b").alias("h")).join(F.broadcast(grams.select("h").distinct()), "h")
    hits = hits.repartition("row").groupBy(*keys, "h").agg(F.sort_array(F.collect_list("pos")).alias("ps")).join(F.broadcast(grams), "h")
    keys += ["template", "license", "n_template"]
    shared = hits.groupBy(*keys).agg(F.sum(F.least(F.size("ps").cast("long"), "in_template")).alias("overlap"), F.collect_list(F.struct("ps", "in_template")).alias("hs"))
    shared = shared.where(F.col("overlap") >= F.col("n_template") * F.lit(threshold / (2 - threshold)) - F.lit(1e-9))
    reached = F.col("dice") >= F.lit(threshold)
    dice = lambda n: (F.lit(2.0) * F.col("overlap") / (n + F.col("n_template"))).alias("dice")
    found = lambda n, place: F.struct("dice", "overlap", (-F.col("template")).alias("order"), (-place).alias("place"), n.alias("n_bigrams"), "license")

    at = F.explode("hs").alias("g")
    at = shared.select(*keys, at).select(*keys, F.col("g.in_template").cast("int").alias("most"), "g.ps", F.posexplode("g.ps").alias("i", "pos"))
    before = F.when(F.col("i") >= F.col("most"), F.get("ps", F.col("i") - F.col("most"))).otherwise(F.lit(-1))
    step = lambda place, by: F.struct(place.alias("at"), F.lit(by).alias("by"))
    steps = F.explode(F.array(step(F.greatest(before, F.col("pos") - F.col("n_template")) + 1, 1), step(F.col("pos"), 0), step(F.col("pos") + 1, -1)))
    steps = at.select(*keys, steps.alias("s")).select(*keys, "s.at", "s.by")
    running = F.sum("by").over(Window.partitionBy("row", "template").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    size = F.least(F.col("n_template"), F.col("n_text") - F.col("at"))
    windows = steps.withColumn("overlap", running).where("by = 0").withColumn("dice", dice(size)).where(reached)
    windows = windows.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(found(size, F.col("at"))), asc=False).alias("ws"))
    meets = lambda x: lambda y: (-x["place"] <= -y["place"] + y["n_bigrams"]) & (-y["place"] <= -x["place"] + x["n_bigrams"])
    apart = F.aggregate("ws", F.array().cast(_WINDOW), lambda kept, x: F.when(F.exists(kept, meets(x)), kept).otherwise(F.concat(kept, F.array(x))))
    windows = windows.select("doc_id", F.lit("window").alias("unit"), F.explode(apart).alias("w"))

    whole = shared.where("parted").withColumn("dice", dice(F.col("n_text"))).where(reached)
    whole = whole.groupBy("doc_id", "row").agg(F.max(found(F.col("n_text"), F.lit(0))).alias("w")).select("doc_id", F.lit("text").alias("unit"), "w")
    more = windows.unionByName(whole).select("doc_id", "unit", (-F.col("w.place")).alias("unit_no"), "w.license", (-F.col("w.order")).alias("template"), "w.n_bigrams", "w.overlap", "w.dice")
    return _lines_and_blocks(text, grams, threshold).unionByName(more.distinct())


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union, as few spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def op5_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_anywhere() of all documents with the default templates; see there for awkward rows."""
    return scan_anywhere(table(spark, sf_dir, "documents"))
