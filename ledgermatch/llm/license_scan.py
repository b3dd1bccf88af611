"""Licence scans: TF-IDF cosine to templates, then inheritance by directory (native).

A file's pieces are its sentences and lines that have terms. Its units are the runs of
consecutive pieces of up to ``RUN`` times the longest notice's terms (so a notice wrapped over
lines is compared in one piece), every single piece, and its whole text. Runs are compared
with the notices, whole texts with the notices and the licence texts in ``licences/``. Terms
are lower-cased runs of letters, digits and ``. + -``; a term weighs its count in the unit
times its idf, counted over the pieces of all files. A unit matches the template of the
highest cosine, if at least ``threshold``. Files that match in a run declare a licence in a
header; files named like a licence file, or whose whole text matches, are licence files and
cover their directory. A file without a licence of its own gets that of the nearest directory
above it that has one: distinct directories are expanded into their ancestors and joined on
path.

Pruning is exact: by the Cauchy-Schwarz bound a unit can only reach the threshold when it
has one of the template's rarer terms, so only such units are scored in full. A run that
begins or ends with a piece without any term of a notice is not scored either: without that
piece its cosines are higher.

Defined cases: NULL and empty texts declare nothing; a NULL path is a file of no directory
and inherits nothing; of several matches that of the whole text, then the higher cosine, then
the smaller licence id wins; of several licence files in a directory the better match, then
the smaller path; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm.common import carry, cut, split_join, text_or_empty

#: Templates (licence id, wording). The usual wording of notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]

#: Terms of a run, in lengths of the longest notice: room for the notice and the rest of its first and last lines.
RUN = 2

TERM = r"[a-z0-9]+(?:[.+\-][a-z0-9]+)*"
SENTENCE = r"(?<=[.!?;])[\x20\x09]+|[\x0A-\x0D]+"
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def licence_texts() -> list[tuple[str, str]]:
    """(licence id, text) of the files in ``licences/``, read on the driver."""
    return [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licences").glob("*.txt"))]


def pieces(text: Column) -> Column:
    """The terms of every sentence and line that has any, in order."""
    return F.filter(F.transform(F.split(text, SENTENCE), terms), lambda p: F.size(p) > 0)


def template_frame(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, licence, terms); the list is the caller's, so its size is known."""
    rows = [(i, licence, wording) for i, (licence, wording) in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, licence string, wording string").withColumn("terms", terms(F.col("wording")))


def _weights(templates: DataFrame, rows: DataFrame, threshold: float) -> tuple[
        dict[str, float], float, dict[int, set[str]], list[tuple]]:
    """idf by template term, idf of an unseen term, the rarer terms by template, and (template, licence, term, unit weight)."""
    counts = [(r["template"], r["licence"], r["term"], r["n"]) for r in templates.select(
        "template", "licence", F.explode("terms").alias("term")).groupBy("template", "licence", "term").agg(
        F.count("*").alias("n")).collect()]
    vocabulary = sorted({c[2] for c in counts})
    known = F.broadcast(rows.sparkSession.createDataFrame([("",), *[(t,) for t in vocabulary]], "term string"))
    found = F.transform(pieces(text_or_empty("text")), lambda p: F.concat(F.array(F.lit("")), F.array_distinct(p)))
    df = {r["term"]: r["n"] for r in rows.select(F.explode(F.flatten(found)).alias("term")).join(known, "term").groupBy(
        "term").agg(F.count("*").alias("n")).collect()}  # at most one row per template term
    n = df.pop("", 0)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    rare: dict[int, set[str]] = {}
    weights = []
    for template in sorted({c[0] for c in counts}):
        own = sorted(((df.get(t, 0), idf[t] * k, t, lic) for i, lic, t, k in counts if i == template), reverse=True)
        norm = math.sqrt(sum(w * w for _, w, _, _ in own))
        common = 0.0
        rare[template] = set()
        for _, w, t, lic in own:  # the most frequent terms first, as long as they alone can't reach the threshold
            if math.sqrt(common + w * w) >= threshold * norm * (1 - 1e-9):
                rare[template].add(t)
            else:
                common += w * w
            weights.append((template, lic, t, w / norm))
    return idf, math.log(1 + n) + 1, rare, weights


def _has(found: Column, words: set[str]) -> Column:
    listed = sorted(words)
    return F.exists(found, lambda t: t.isin(listed))


def _grown(start: Column, more: Column, most: int, joined: Callable[[Column, Column], Column]) -> Column:
    """Runs that begin as ``start`` and take the pieces of ``more`` one by one, up to ``most`` terms."""
    begin = F.struct(F.lit(False).alias("full"), start.alias("run"), F.array(start).alias("runs"))

    def step(acc: Column, piece: Column) -> Column:
        fits = ~acc["full"] & (F.size(acc["run"]) + F.size(piece["terms"]) <= most)
        run = joined(acc["run"], piece["terms"])
        return F.struct((~fits).alias("full"), F.when(fits, run).otherwise(acc["run"]).alias("run"), F.when(
            fits & piece["known"], F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"]).alias("runs"))

    return F.aggregate(more, begin, step, lambda acc: acc["runs"])


def runs(texts: DataFrame, known: set[str], rare: set[str], most: int) -> DataFrame:
    """(row_id, terms): of (row_id, pieces), the runs with a rare term whose end pieces have known terms.

    A run is made at the first piece in it that has a rare term; it reaches back to the one before at most.
    """
    marked = texts.select("row_id", F.transform("pieces", lambda p: F.struct(
        p.alias("terms"), _has(p, known).alias("known"), _has(p, rare).alias("rare"))).alias("p"))
    marked = marked.withColumn("at", F.filter(F.transform("p", lambda p, i: F.when(p["rare"], i)), lambda i: i.isNotNull()))

    def around(i: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(F.col("at"), k - 1)).otherwise(F.lit(-1))
        low = F.greatest(before + 1, i - most)  # every piece has a term, so no run goes further
        return F.struct(F.get(F.col("p"), i)["terms"].alias("start"), F.reverse(F.slice("p", low + 1, i - low)).alias("left"),
                        F.slice("p", i + 2, F.lit(most)).alias("right"))

    spans = marked.select("row_id", F.explode(F.transform("at", around)).alias("s"))
    s = F.col("s")
    lefts = _grown(s["start"], s["left"], most, lambda run, piece: F.concat(piece, run))
    every = F.transform(lefts, lambda run: _grown(run, s["right"], most, lambda run, piece: F.concat(run, piece)))
    return spans.select("row_id", F.explode(F.flatten(every)).alias("terms"))


def scores(rows: DataFrame, templates: list[tuple[str, str]], threshold: float, texts: list[tuple[str, str]] = ()) -> DataFrame:
    """Best match of each row (row_id, text) that has one: licence, cosine, whole_matches.

    ``texts``: licence texts, which only whole texts are compared with.
    """
    spark = rows.sparkSession
    frame = cut(template_frame(spark, [*templates, *texts]), "licence-templates")
    idf, unseen, rare, weights = _weights(frame, rows, threshold)
    notices = range(len(templates))
    most = RUN * (frame.where(F.col("template") < len(templates)).agg(F.max(F.size("terms"))).first()[0] or 0)
    known = {t for i, _, t, _ in weights if i in notices}
    likely = rows.select("row_id", pieces(text_or_empty("text")).alias("pieces")).where(
        _has(F.flatten("pieces"), set().union(*rare.values())))
    likely = cut(likely, "licence-pieces")
    units = runs(likely, known, set().union(*[rare.get(i, set()) for i in notices]), most).withColumn("whole", F.lit(False))
    units = units.unionByName(likely.select("row_id", F.flatten("pieces").alias("terms"), F.lit(True).alias("whole")))
    units = cut(units.withColumn("unit", F.monotonically_increasing_id()), "licence-units")
    bag = units.select("unit", "row_id", "whole", F.explode("terms").alias("term")).groupBy(
        "unit", "row_id", "whole", "term").agg(F.count("*").alias("n"))
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    bag = bag.join(idfs, "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(unseen)))
    norms = bag.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = F.broadcast(spark.createDataFrame(weights, "template int, licence string, term string, tw double"))
    dots = bag.join(vectors, "term").where(F.col("whole") | (F.col("template") < len(templates))).groupBy(
        "unit", "row_id", "whole", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = dots.join(norms, "unit").withColumn("cosine", F.col("dot") / F.col("norm")).where(
        F.col("cosine") >= threshold)
    best = cosine.groupBy("row_id").agg(
        F.min(F.struct((~F.col("whole")).alias("part"), (-F.round("cosine", 9)).alias("c"), F.col("licence").alias("licence"))).alias("best"),
        F.max("whole").alias("whole_matches"))
    return best.select("row_id", F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine"), "whole_matches")


def parent(path: Column) -> Column:
    """The directory of a path; '' at the top, NULL for a NULL path."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(
        F.when(path.isNotNull(), F.lit("")))


def scan(files: DataFrame, *, path: str = "path", text: str = "text", templates: list[tuple[str, str]] | None = None,
         threshold: float = 0.75) -> DataFrame:
    """The input's columns plus licence, licence_cosine, licence_from and licence_path.

    ``licence_from``: header, file (a licence file itself), directory (inherited from the
    licence file ``licence_path``) or NULL.
    """
    frame, restore = carry(files, path=path, text=text)
    rows = frame.withColumn("row_id", F.md5(F.concat_ws("\n", F.col("path").isNull().cast("string"), "path", "text")))
    own = cut(scores(rows.select("row_id", "text").where(F.length("text") > 0), templates or TEMPLATES, threshold,
                     [] if templates else licence_texts()), "licences")
    found = split_join(rows, own, ["row_id"], "left")
    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.col("licence").isNotNull() & (F.col("whole_matches") | name.rlike(LICENCE_NAME))
    found = found.withColumns({"directory": parent(F.col("path")), "is_file": F.coalesce(is_file, F.lit(False))})
    covering = found.where(F.col("is_file") & F.col("directory").isNotNull()).groupBy("directory").agg(F.min(F.struct(
        (-F.col("cosine")).alias("c"), F.col("path").alias("licence_path"), F.col("licence").alias("licence"))).alias("cover"))
    covering = cut(covering, "licence-files")
    needy = found.where(F.col("licence").isNull() & F.col("directory").isNotNull()).select("directory").distinct()
    steps = F.split("directory", "/")
    above = needy.select("directory", F.explode(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")))).alias("ancestor"))
    nearest = split_join(above.distinct(), covering.withColumnRenamed("directory", "ancestor"), ["ancestor"]).groupBy(
        "directory").agg(F.max(F.struct(F.length("ancestor").alias("n"), "cover")).alias("near"))
    out = split_join(found, nearest, ["directory"], "left")
    inherited = F.col("licence").isNull()
    out = out.select("*", F.coalesce("licence", "near.cover.licence").alias("__licence"),
                     F.when(~inherited, F.col("cosine")).alias("licence_cosine"),
                     F.when(F.col("is_file"), "file").when(~inherited, "header").when(
                         F.col("near").isNotNull(), "directory").alias("licence_from"),
                     F.when(inherited, F.col("near.cover.licence_path")).when(F.col("is_file"), F.col("path")).alias("licence_path"))
    out = out.drop("licence").withColumnRenamed("__licence", "licence")
    return restore(out, ["licence", "licence_cosine", "licence_from", "licence_path"])
