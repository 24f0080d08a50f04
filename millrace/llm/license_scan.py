"""Licence scan: TF-IDF cosine of notices to templates, then inheritance from the nearest directory.

Every line of a file that may be a licence notice, and the whole of a licence file, is a passage. Its
sparse TF-IDF vector is compared with those of the templates by joining terms. Directories take the
best licence of the licence files in them; a file without a notice of its own takes the licence of
its nearest ancestor directory, found by joining paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

# Short public notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Licensed under CC0 1.0, dedicated to the public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "Copyright, all rights reserved"),
)

#: A line is looked at as a notice if it has one of these words.
NOTICE = r"(?i)licen[sc]e|copyright|rights reserved|public domain|permission is|redistribution|\bcc[ -]?(?:by|0)"
#: Base names of licence files.
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice|unlicense)[^/]*$"
#: Least cosine of a match.
LEAST = 0.6


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def template_weights(spark) -> DataFrame:
    """(template, name, term, idf, weight); the weights of a template have unit length.

    The templates are a fixed list, so these tables have a fixed size.
    """
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, name string, notice string")
    tf = rows.select("template", "name", F.explode(terms(F.col("notice"))).alias("term")).groupBy("template", "name", "term").agg(
        F.count("*").alias("tf")
    )
    idf = tf.groupBy("term").agg(idf_of(F.count("*")).alias("idf"))
    weighed = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    return weighed.select("template", "name", "term", "idf", (F.col("w") / norm).alias("weight"))


def idf_of(documents: Column) -> Column:
    return F.log((F.lit(1.0) + len(TEMPLATES)) / (F.lit(1.0) + documents)) + 1.0


def own_licences(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(row, id, path, own, score) of every file (id, path, text): its best notice, or null."""
    spark = files.sparkSession
    weights = template_weights(spark)
    lines = F.filter(F.split("text", "\r?\n"), lambda line: line.rlike(NOTICE))
    whole = F.when(F.col("path").rlike(LICENCE_FILE) & (F.size(lines) > 0), F.array("text")).otherwise(
        F.array().cast("array<string>")
    )
    rows = files.select(
        F.monotonically_increasing_id().alias("row"), "id", "path", F.coalesce(F.concat(lines, whole), F.array()).alias("p")
    )
    passages = rows.select("row", "id", "path", F.posexplode_outer("p").alias("passage", "notice"))
    seen = passages.select(
        "row", "id", "path", "passage", F.explode_outer(terms(F.col("notice"))).alias("term")
    ).groupBy("row", "id", "path", "passage", "term").agg(F.count("*").alias("tf"))
    known = weights.select("term", "idf").distinct()
    absent = idf_of(F.lit(0))
    weighed = seen.join(F.broadcast(known), "term", "left").withColumn(
        "w", F.when(F.col("term").isNotNull(), F.col("tf") * F.coalesce("idf", absent))
    )
    vectors = F.broadcast(
        weights.groupBy("term").agg(F.collect_list(F.struct("template", "name", "weight")).alias("in_templates"))
    )
    # One row per passage: its length and its products with every template, as a small map by template.
    joined = weighed.join(vectors, "term", "left")
    by_passage = ["row", "id", "path", "passage"]
    length = joined.groupBy(*by_passage).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        *[_product(i).alias(f"dot{i}") for i in range(len(TEMPLATES))],
    )
    best = F.greatest(
        *[
            F.struct((F.coalesce(F.col(f"dot{i}"), F.lit(0.0)) / F.col("norm")).alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("name"))
            for i, (n, _) in enumerate(TEMPLATES)
        ]
    )
    judged = length.withColumn("best", F.when(F.col("norm") > 0, best))
    hit = F.when(F.col("best.score") >= least, F.struct("best.score", "best.order", "best.name"))
    top = judged.groupBy("row", "id", "path").agg(F.max(hit).alias("top"))
    return top.select("row", "id", "path", F.col("top.name").alias("own"), F.round("top.score", 6).alias("score"))


def _product(template: int) -> Column:
    mine = F.filter("in_templates", lambda s: s["template"] == template)
    return F.sum(F.col("w") * F.coalesce(F.try_element_at(mine, F.lit(1))["weight"], F.lit(0.0)))


def directory(path: Column) -> Column:
    """The directory of a path: what stands before its last slash, empty at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(folder: Column) -> Column:
    """A directory and all above it, the top (empty) included, as (depth, folder)."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")),
    )


def licences(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, path, own, score, licence, origin, licence_dir) of every row of ``files`` (id, path, text).

    ``origin`` is own, inherited or none. A directory with several licence files has the licence with
    the best score, ties by name. Null texts have no notice; a null path has no directory and inherits
    nothing; a null id is kept; rows that repeat give equal rows; other columns are ignored; an empty
    table gives an empty result. Directories are resolved among themselves first, so files join one
    row each; adaptive execution splits a directory with very many files.
    """
    own = stored(own_licences(files, least), "licences").withColumn("folder", directory(F.col("path")))
    declared = (
        own.where(F.col("own").isNotNull() & F.col("path").rlike(LICENCE_FILE))
        .groupBy("folder")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("licence"))).alias("best"))
        .select(F.col("folder").alias("licence_dir"), "best.licence")
    )
    folders = own.where("folder is not null").select("folder").distinct()
    above = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("up"))
    resolved = (
        above.join(declared, F.col("up.folder") == F.col("licence_dir"))
        .groupBy("folder")
        .agg(F.max(F.struct(F.col("up.depth").alias("depth"), "licence_dir", "licence")).alias("near"))
        .select("folder", "near.licence_dir", "near.licence")
    )
    out = own.join(resolved, "folder", "left")
    inherited = F.col("own").isNull() & F.col("licence").isNotNull()
    return out.select(
        "id",
        "path",
        "own",
        "score",
        F.coalesce("own", "licence").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(inherited, F.col("licence_dir")).alias("licence_dir"),
    )
