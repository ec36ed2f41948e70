"""License scan: sparse TF-IDF cosine to templates, inherited along directories.

Sentences that name a licence are the headers; the words of a licence file
(LICENSE, COPYING, NOTICE) are compared as a whole, too. A vector has term
frequency times idf on the words of the templates, idf from all header sentences
of the table; words outside every template weigh as the commonest word, 1. The
best template wins if its cosine reaches ``threshold``.

A document without an own licence takes that of the nearest directory above it
that holds a licence file: distinct directories are exploded to their ancestors
and joined with the directories of licence files, then joined back to documents.

Everything is DataFrame functions. Only the templates' words (a bounded table)
are folded into rows; directories are reduced to one row before each join, and
the join back is one that the adaptive execution can split.

Null and empty texts have no header; null paths have no directory and inherit
nothing. Among equal cosines the first template by name wins, among several
licence files of a directory the best. Repeated rows are scanned row by row. An
empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.6
# Templates (licence, header sentence): fixed values
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution license."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, v. 2.0."),
]
TRIGGER = "licen[cs]|copyright|spdx"
FILE_NAME = "^(license|licence|copying|notice)"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, text in templates for w in template_words(text)})


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def count(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def squared_norm(idf: Column, words: Column) -> Column:
    """Of a word list; words outside the templates weigh 1."""
    return total(F.transform(F.array_distinct(words), lambda w: F.pow(
        count(words, w) * F.coalesce(F.try_element_at(idf, w), F.lit(1.0)), F.lit(2.0))))


def best_template(weights: Column, words: Column) -> Column:
    """Cosine in millionths times 1000, plus 999 minus the template's number: the
    largest is the best template, the first by name among equals."""
    dot = lambda t: total(F.transform(t["terms"], lambda x: count(words, x["w"]) * x["x"]))
    cosine = lambda t: F.coalesce(F.try_divide(dot(t), F.sqrt(
        squared_norm(weights["idf"], words) * t["squared"])), F.lit(0.0))
    return F.array_max(F.transform(weights["templates"], lambda t: (
        F.round(cosine(t) * 1e6).cast("long") * 1000 + (F.lit(999) - t["number"]))))


def headers(text: Column) -> Column:
    """Word lists of the sentences that name a licence."""
    sentences = F.filter(F.split(text, r"[\n;!?]+|\. "), lambda s: F.lower(s).rlike(TRIGGER))
    return F.transform(sentences, words_of)


def template_weights(found: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """One row: idf, ln((1 + N) / (1 + df)) + 1, of each template word over all
    header sentences, and the sparse vectors of the templates."""
    words = vocabulary(templates)
    known = F.array(*map(F.lit, words))
    sentence = found.select(F.explode("headers").alias("words"))
    frequency = sentence.select(F.explode(F.array_intersect("words", known)).alias("w")).groupBy("w").agg(
        F.count("*").alias("df"))
    number = sentence.agg(F.count("*").alias("df")).select(F.lit("").alias("w"), "df")  # under no word
    counted = frequency.unionByName(number).agg(
        F.map_from_entries(F.collect_list(F.struct("w", "df"))).alias("df"))
    df = lambda w: F.coalesce(F.try_element_at(F.col("df"), w), F.lit(0).cast("long"))
    idf = F.map_from_arrays(known, F.transform(known, lambda w: F.log(
        (df(F.lit("")) + 1.0) / (df(w) + 1.0)) + 1.0))
    vectors = F.array(*[F.struct(F.lit(k).alias("number"), F.array(*[
        F.struct(F.lit(w).alias("w"), F.lit(float(template_words(text).count(w))).alias("tf"))
        for w in sorted(set(template_words(text)))]).alias("terms"))
        for k, (_, text) in enumerate(templates)])
    weight = lambda x: F.element_at(F.col("idf"), x["w"])
    weighed = F.transform(vectors, lambda t: F.struct(
        t["number"].alias("number"),
        total(F.transform(t["terms"], lambda x: F.pow(x["tf"] * weight(x), F.lit(2.0)))).alias("squared"),
        F.transform(t["terms"], lambda x: F.struct(
            x["w"].alias("w"), (x["tf"] * weight(x) * weight(x)).alias("x"))).alias("terms")))
    return counted.select(idf.alias("idf")).select(F.struct(
        "idf", weighed.alias("templates")).alias("weights"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_license, similarity, license, origin) of every row of
    ``files`` (doc_id, path, text); origin is header, file, inherited or none."""
    templates = sorted(templates)
    named = files.select(files["doc_id"].alias("doc_id"), files["path"].cast("string").alias("path"),
                         files["text"].cast("string").alias("text"))
    named = named.withColumn("text", F.coalesce("text", F.lit("")))
    base = F.regexp_extract("path", "([^/]*)$", 1)
    is_file = F.coalesce(F.lower(base).rlike(FILE_NAME), F.lit(False))
    hits = F.lower("text").rlike(TRIGGER)
    empty = F.array().cast("array<array<string>>")
    found = named.select(
        "doc_id", "path", is_file.alias("is_file"),
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory"),
        F.when(hits, headers(F.col("text"))).otherwise(empty).alias("headers"),
        F.when(is_file, F.array(words_of(F.col("text")))).otherwise(empty).alias("whole"))
    weights = template_weights(found.select("headers"), templates).scalar()

    vectors = F.concat("headers", "whole")
    scored = found.withColumn("weights", weights).withColumn(
        "code", F.when(F.size(vectors) > 0, F.array_max(F.transform(
            vectors, lambda w: best_template(F.col("weights"), w)))))
    reached = F.col("code") >= int(threshold * 1_000_000) * 1000
    scored = scored.select("doc_id", "path", "is_file", "directory",
                           F.when(reached, F.col("code")).alias("code"))

    names = F.array(*[F.lit(n) for n, _ in templates])
    name = lambda code: F.when(code.isNotNull(), F.try_element_at(names, (F.lit(1000) - code % 1000).cast("int")))
    holders = scored.filter("is_file AND code IS NOT NULL AND directory IS NOT NULL").groupBy(
        F.col("directory").alias("holder")).agg(F.max("code").alias("held"))
    # every directory with its ancestors; the deepest that holds a licence file wins
    parts = F.split("directory", "/")
    above = scored.filter("directory IS NOT NULL").select("directory").distinct().select(
        "directory", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).withColumn(
        "ancestor", F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.col("depth")), "/"))
    # depth and code in one number, so that the maximum is a hash aggregate
    nearest = above.join(holders, F.col("ancestor") == F.col("holder")).groupBy("directory").agg(
        F.max(F.col("depth") * F.lit(10_000_000_000).cast("long") + F.col("held")).alias("found"))
    inherited = nearest.select(F.col("directory").alias("of"), (F.col("found") % 10_000_000_000).alias("inherited"))
    joined = scored.join(inherited, F.col("directory") == F.col("of"), "left")
    own, up = F.col("code"), F.col("inherited")
    return joined.select(
        "doc_id", "path", name(own).alias("own_license"),
        (F.floor(own / 1000) / 1e6).alias("similarity"), name(F.coalesce(own, up)).alias("license"),
        F.when(own.isNotNull() & F.col("is_file"), "file").when(own.isNotNull(), "header")
        .when(up.isNotNull(), "inherited").otherwise("none").alias("origin"))
