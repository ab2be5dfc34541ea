"""Licences of files: sparse TF-IDF cosine of header lines to templates, then inheritance from the nearest directory.

SQL functions only. Lines that hold an anchor word are candidate headers; their words meet the words of the templates in
a join, so only shared words are multiplied. A file whose only line is a header is a licence file; it speaks for all
files below its directory that have no header of their own, unless a directory nearer to them has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.llm.decontaminate import GAP, lower_ascii
from growthlens.llm.shared import fresh, kept, small_or_any

# Notices as they are published with each licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]
#: A line without any of these is no header. Each template has one.
ANCHORS = r"(?i)\b(licen[cs]ed?|permission|redistribut\w+|cc0|spdx)\b"
BROADCAST_ROWS = 100_000


def _terms(line: Column) -> Column:
    return F.filter(F.split(lower_ascii(line), GAP, -1), lambda w: w != "")


def _directory(path: Column) -> Column:
    """The path up to its last slash; the root is the empty text."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _ancestors(path: Column) -> Column:
    """All directories above a path, the nearest first, the root last."""
    parts = F.split(_directory(path), "/")
    depths = F.sequence(F.size(parts), F.lit(0), F.lit(-1))
    return F.array_distinct(F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def headers(files: DataFrame, *, least: float = 0.7) -> DataFrame:
    """(path, license, similarity, alone): the best header of each file that has one with that cosine or more. `alone`
    says that the file has no other line."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    listed = files.where(F.col("text").rlike(ANCHORS)).select("path", F.size(lines).alias("n_lines"), F.posexplode(lines).alias("line", "said"))
    listed = listed.where(F.col("said").rlike(ANCHORS)).distinct()
    terms = kept(listed.select("path", "line", "n_lines", F.explode(_terms(F.col("said"))).alias("term")))
    units = terms.select("path", "line").distinct().count()
    # templates count as lines too, so every word of theirs has a weight
    spark = files.sparkSession
    given = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEMPLATES)], "template int, license string, said string")
    given = given.select("template", "license", F.explode(_terms(F.col("said"))).alias("term"))
    held = terms.select("path", F.col("line").cast("string").alias("line"), "term").union(given.select(F.lit(None).cast("string"), F.col("template").cast("string"), "term"))
    spread = held.distinct().groupBy("term").count()
    total = units + len(TEMPLATES)
    weight = F.log((F.lit(total) + 1) / (F.col("count") + 1)) + 1
    weights = small_or_any(kept(spread.select("term", weight.alias("weight"))), BROADCAST_ROWS)

    def weighted(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys, "term").count().join(weights, "term").select(*keys, "term", (F.col("count") * F.col("weight")).alias("w"))

    ours = kept(weighted(terms, ["path", "line", "n_lines"]))
    theirs = kept(weighted(given, ["template", "license"]))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    our_norm = ours.groupBy("path", "line", "n_lines").agg(norm.alias("a"))
    their_norm = theirs.groupBy("template", "license").agg(norm.alias("b"))
    both = ours.select("path", "line", "term", F.col("w").alias("x")).join(F.broadcast(theirs.select("template", "term", F.col("w").alias("y"))), "term")
    dots = both.groupBy("path", "line", "template").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cosine = dots.join(our_norm, ["path", "line"]).join(F.broadcast(their_norm), "template")
    cosine = cosine.select("path", "license", "n_lines", F.round(F.col("dot") / (F.col("a") * F.col("b")), 6).alias("similarity"))
    good = cosine.where(F.col("similarity") >= least).groupBy("path")
    best = good.agg(F.min(F.struct(-F.col("similarity"), "license", "n_lines")).alias("best"))
    return best.select("path", "best.license", (-F.col("best.col1")).alias("similarity"), (F.col("best.n_lines") == 1).alias("alone"))


def license_scan(files: DataFrame, *, least: float = 0.7) -> DataFrame:
    """files with license string, similarity double and origin string: `own`, `inherited` or `none`.

    files: path, text; other columns are kept, those named like results replaced. Null texts have no header and can only
    inherit; a null path has neither. Rows that repeat a path share the best header of all of them. Of several licence
    files in one directory the most similar counts, then the first licence in the alphabet.
    """
    base = files.drop("license", "similarity", "origin")
    found = kept(headers(base.where("path is not null").select("path", "text"), least=least))
    roots = found.where("alone").groupBy(_directory(F.col("path")).alias("above")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("of"))
    roots = small_or_any(kept(roots), BROADCAST_ROWS)
    # the nearest directory with a licence file: one row for each directory of files, not for each file
    folders = base.where("path is not null").select(_directory(F.col("path")).alias("folder")).distinct()
    above = folders.select("folder", F.posexplode(_ancestors(F.concat("folder", F.lit("/x")))).alias("steps", "above"))
    nearest = above.join(roots, "above").groupBy("folder").agg(F.min_by("of", "steps").alias("of"))
    folder, of, path, own_license, own_similarity = fresh(base, "folder", "of", "own_path", "own_license", "own_similarity")
    nearest = small_or_any(kept(nearest.select(F.col("folder").alias(folder), F.col("of").alias(of))), BROADCAST_ROWS)
    own = found.select(F.col("path").alias(path), F.col("license").alias(own_license), F.col("similarity").alias(own_similarity))
    own = small_or_any(kept(own), BROADCAST_ROWS)
    joined = base.join(own, F.col("path") == F.col(path), "left").join(nearest, _directory(F.col("path")) == F.col(folder), "left")
    origin = F.when(F.col(own_license).isNotNull(), "own").when(F.col(of).isNotNull(), "inherited").otherwise("none")
    license, similarity = F.coalesce(own_license, f"{of}.license"), F.coalesce(own_similarity, -F.col(f"{of}.s"))
    return joined.select(*base.columns, license.alias("license"), similarity.alias("similarity"), origin.alias("origin"))
