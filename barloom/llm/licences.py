"""Licences of files by TF-IDF cosine to templates, then by the nearest ancestor directory.

One pass over all files counts in how many lines each (hashed) term occurs. A second pass compares,
for every file, each line, each window of 2, 4, 8 and 16 lines (headers) and the whole text with all
templates. The product with a template is exact for every window; the norm is bounded from below, so
only windows that may reach the threshold are weighed exactly. A file takes the template with the
highest cosine of HEADER or more. It is a licence file if its whole text reaches WHOLE, or if it is
named like one and has a header. A directory takes its best licence file; a file without a licence of
its own takes that of its nearest ancestor directory: directories are exploded into their ancestors
and joined by path, once for each directory, not for each file.

Null and empty texts have no licence of their own; a null path is the root. Ties go to the first
licence by name. Files may share a path or an id; each row is returned. Texts of any length are read
whole. An empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import CACHED_CHARS, CACHED_WORDS, slices, texts_of, written

TERMS = 1 << 16
HEADER, WHOLE = 0.6, 0.6
WINDOWS = (1, 2, 4, 8, 16)
TOKEN = regex.compile(r"[^\p{L}\p{N}.\-]+")
NAMED = r"(?i)^(licen[cs]e|copying|copyright)([.\-_].*)?$"

# Notices that licences ask for, by licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


class Terms:
    """Term numbers of words, with a bounded memory."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0

    def of(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Terms of all lines and each line's bounds in them."""
        split = [x.lower().split() for x in lines]
        if len(self.known) > CACHED_WORDS or self.chars > CACHED_CHARS:
            self.known.clear()
            self.chars = 0
        new = {w for s in split for w in s} - self.known.keys()
        self.chars += sum(map(len, new))
        self.known.update({w: term_of(w) for w in new})
        ends = np.cumsum([0, *map(len, split)])
        get = self.known.__getitem__
        return np.fromiter((get(w) for s in split for w in s), np.int64, int(ends[-1])), ends


def term_of(word: str) -> int:
    bare = TOKEN.sub("", word).strip(".-") or word
    return xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) % TERMS


def line_frequencies(files: DataFrame) -> tuple[np.ndarray, int]:
    """Lines in which each term occurs, and the number of lines."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df, total = Terms(), np.zeros(TERMS), 0
        for batch in slices(batches):
            lines = [x for t in texts_of(batch) for x in t.split("\n")]
            found, ends = terms.of(lines)
            line = np.repeat(np.arange(len(lines)), np.diff(ends))
            df += np.bincount(np.unique(line * TERMS + found) % TERMS, minlength=TERMS)
            total += len(lines)
        at = np.append(np.flatnonzero(df), TERMS)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at.astype(np.int32)), "n": pa.array(np.append(df[at[:-1]], total).astype(np.int64))})

    rows = files.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1)
    for r in rows:  # TERMS + 1 at most
        out[r["term"]] = r["n"]
    return out[:TERMS], int(out[TERMS])


def scanned(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Adds own_licence, own_cosine and whole_cosine to files (doc_id, path, text without nulls)."""
    df, lines = line_frequencies(files)
    idf = np.log((1 + lines) / (1 + df)) + 1
    terms = Terms()
    vectors = np.zeros((TERMS, len(templates)), np.float32)
    for j, (_, text) in enumerate(templates):
        n = np.bincount(terms.of([text])[0], minlength=TERMS) * idf
        vectors[:, j] = n / np.linalg.norm(n)
    used = np.flatnonzero(vectors.any(axis=1))
    place = np.full(TERMS, -1, np.int32)
    place[used] = np.arange(len(used))
    names = [n for n, _ in templates]
    shared = files.sparkSession.sparkContext.broadcast((idf, place, vectors[used] * idf[used, None], names))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, (idf, place, weights, names) = Terms(), shared.value
        for batch in slices(batches):
            own, cosine, whole = [], [], []
            split = [t.split("\n") for t in texts_of(batch)]
            found, ends = terms.of([x for s in split for x in s])
            line = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            at = place[found]
            use = at >= 0
            products = np.stack([np.bincount(line[use], weights[at[use], j], len(ends) - 1) for j in range(len(names))], axis=1)
            norms = np.bincount(line, idf[found] ** 2, len(ends) - 1)
            begin = 0
            for s in split:
                n = len(s)
                p = np.vstack([np.zeros(len(names)), np.cumsum(products[begin:begin + n], axis=0)])
                q = np.append(0, np.cumsum(norms[begin:begin + n]))
                best = (0.0, "")
                if p[-1].max() > 0:
                    for w in WINDOWS:
                        if w > 1 and w // 2 >= n:
                            break
                        stop = np.minimum(np.arange(n) + w, n)
                        top = (p[stop] - p[:-1]).max(axis=1)
                        for i in np.flatnonzero(top >= HEADER * np.sqrt(np.maximum(q[stop] - q[:-1], 1e-9))):
                            words = found[ends[begin + i]:ends[begin + stop[i]]]
                            best = max(best, weighed(words, p[stop[i]] - p[i], idf, names), key=lambda b: (b[0], ))
                    all_words = found[ends[begin]:ends[begin + n]]
                    of_all = weighed(all_words, p[-1], idf, names) if p[-1].max() >= WHOLE * np.sqrt(q[-1]) else (0.0, "")
                    best = max(best, of_all, key=lambda b: (b[0],))
                else:
                    of_all = (0.0, "")
                own.append(best[1] if best[0] >= HEADER else None)
                cosine.append(best[0])
                whole.append(of_all[0])
                begin += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("path"), pa.array(own, pa.string()), pa.array(cosine, pa.float64()), pa.array(whole, pa.float64())],
                ["doc_id", "path", "own_licence", "own_cosine", "whole_cosine"])

    return files.mapInArrow(scan, "doc_id long, path string, own_licence string, own_cosine double, whole_cosine double")


def weighed(words: np.ndarray, products: np.ndarray, idf: np.ndarray, names: list[str]) -> tuple[float, str]:
    """The exact cosine with the best template, and its licence."""
    _, first, n = np.unique(words, return_index=True, return_counts=True)
    norm = float(np.sqrt(((n * idf[words[first]]) ** 2).sum())) or 1.0
    k = int(products.argmax())
    return float(products[k]) / norm, names[k]


def parent(path: str):
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(directory: str):
    """The directory and all above it, to the root (empty)."""
    parts = F.split(directory, "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.array_distinct(F.concat(upto, F.array(F.lit(""))))


def licences(docs: DataFrame, path, templates=TEMPLATES) -> DataFrame:
    """doc_id, path, own_licence, own_cosine, licence and licence_dir (of whom it is inherited)."""
    files = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = written(scanned(files, templates), "licences").withColumn("dir", parent("path"))
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(NAMED)
    texts = own.where(F.col("own_licence").isNotNull() & (named | (F.col("whole_cosine") >= WHOLE)))
    best = F.min(F.struct((-F.greatest("whole_cosine", "own_cosine")).alias("against"), F.col("own_licence").alias("found")))  # ties: first by name
    of_dir = texts.groupBy(F.col("dir").alias("ancestor")).agg(best["found"].alias("found"))
    dirs = own.select("dir").distinct().withColumn("ancestor", F.explode(ancestors("dir")))
    nearest = F.max(F.struct(F.length("ancestor").alias("depth"), F.col("ancestor"), F.col("found")))
    inherited = dirs.join(of_dir, "ancestor").groupBy("dir").agg(nearest.alias("near"))
    lacking = F.col("own_licence").isNull()
    return own.join(inherited, "dir", "left").select(
        "doc_id", "path", "own_licence", "own_cosine",
        F.coalesce("own_licence", F.col("near.found")).alias("licence"),
        F.when(lacking, F.col("near.ancestor")).alias("licence_dir"))
