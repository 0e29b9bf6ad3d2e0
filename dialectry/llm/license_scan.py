"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

1. The document frequency of every template term is counted over all texts (a fixed vocabulary, so
   what tasks send has a fixed bound), which gives the idf. Terms are words, and pairs of a word and
   the version number behind it (``version 2``), which tell the editions of a licence apart; a pair's
   idf is that of its rarer word.
2. Candidates for a header are lines, windows of up to ``WINDOW`` adjacent lines that begin and end in
   lines of mostly template words, paragraphs, and whole texts: comment marks don't count, so a notice may be wrapped in any way. A candidate's
   sparse TF-IDF vector is compared with the templates; the file's licence is the best candidate at or above
   ``threshold``, of equals the one with most words, then the first. A candidate can only reach the threshold if it holds a term of its
   template's anchor set (the terms without which the rest of the template's norm is too small), so
   windows without one are skipped without loss.
3. A file that is named as a licence file, or opens with its licence, speaks for its directory.
   Each file without its own licence looks up all its ancestor directories by an equi-join and
   takes the deepest that has one; among several files of one directory the best score wins, then
   the smallest path, then the smallest id.

The vector space is that of the template terms plus one dimension for each foreign word, so foreign
words lower the cosine. Defined results: a null or empty text or path has no licence of its own; a null path
inherits none; repeated rows give repeated results. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectry.llm.common import stored

#: Licence statements, notices and titles as published, one template each.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."),
]
#: Lines of a window at most: the longest notice above fills so many lines of 30 characters.
WINDOW = 30
#: Cosines that differ by less are equal.
EQUAL = 1e-6
WORD = re.compile(r"[a-z0-9]+")
LICENSE_NAME = r"(?i)(^|/)(licen[cs]es?|copying|notice|unlicense)([.-][^/]*)?$"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pairs(found: list[str]) -> list[str]:
    """Words with the number behind them."""
    return [f"{a} {b}" for a, b in zip(found, found[1:]) if b.isdigit() and len(b) < 3 and not a.isdigit()]


VOCABULARY = sorted({w for _, t in TEMPLATES for w in words(t)})


class Space:
    """Template vectors for given document frequencies."""

    def __init__(self, n: int, df: dict[str, int], threshold: float):
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in VOCABULARY}
        for _, text in TEMPLATES:
            for p in pairs(words(text)):
                self.idf[p] = max(self.idf[x] for x in p.split(" "))
        self.foreign = math.log(1 + n) / 2 + 1  #: weight of a word outside the vocabulary
        self.threshold = threshold
        self.templates, anchors = [], set()
        for label, text in TEMPLATES:
            found = words(text)
            v = {w: (1 + math.log(c)) * self.idf[w] for w, c in Counter(found + pairs(found)).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {w: x / norm for w, x in v.items()}
            self.templates.append((label, v))
            # keep the heaviest terms as anchors until the rest alone can't reach the threshold
            rest = 1.0
            for w, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
                if rest <= 0.999 * threshold**2:
                    break
                anchors.add(w.split(" ")[0])
                rest -= x * x
        self.anchors = anchors
        self.pattern = r"\b(?:" + "|".join(sorted(anchors)) + r")\b"

    def best(self, found: list[str]) -> tuple[float, str | None]:
        """Largest cosine of some words with a template, and its label; 0 and None below the threshold."""
        v = {w: (1 + math.log(c)) * self.idf[w] for w, c in Counter(found + [p for p in pairs(found) if p in self.idf]).items() if w in self.idf}
        strange = Counter(w for w in found if w not in self.idf)
        norm = math.sqrt(sum(x * x for x in v.values()) + sum(((1 + math.log(c)) * self.foreign) ** 2 for c in strange.values()))
        top, name = 0.0, None
        for label, t in self.templates:
            score = sum(x * t[w] for w, x in v.items() if w in t)
            if score > top * norm + 1e-12:
                top, name = score / norm, label
        return (round(top, 9), name) if top >= self.threshold else (0.0, None)

    def header(self, text: str) -> tuple[float, str | None, int, int]:
        """Score, licence, start and end of the best candidate of a text."""
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append((at, at + len(line), words(line)))
            at += len(line) + 1
        top, size = (0.0, None, 0, 0), 0
        known = self.idf

        def tried(i: int, j: int) -> None:
            nonlocal top, size
            found = [w for _, _, own in lines[i:j] for w in own]
            if not any(w in self.anchors for w in found):
                return
            score, label = self.best(found)
            if label and (score > top[0] + EQUAL or score > top[0] - EQUAL and len(found) > size):
                top, size = (score, label, lines[i][0], lines[j - 1][1]), len(found)

        part = [bool(own) and 2 * sum(w in known for w in own) >= len(own) for _, _, own in lines]
        for i in range(len(lines)):
            if not lines[i][2]:
                continue
            tried(i, i + 1)
            if part[i]:
                for j in range(i + 2, min(i + WINDOW, len(lines)) + 1):
                    if part[j - 1]:
                        tried(i, j)
        i = 0
        while i < len(lines):
            j = i
            while j < len(lines) and lines[j][2]:
                j += 1
            if j > i + 1:
                tried(i, j)
            i = j + 1
        if len(lines) > 1:
            tried(0, len(lines))
        return top


def term_counts(texts: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts, and in how many of them each template term occurs."""
    known = {w: i for i, w in enumerate(VOCABULARY)}

    def count(batches):
        from dialectry.llm.common import Shingler, alnum_words, text_buffer

        s = Shingler(1, alnum_words())
        ids, _, _, _ = s.words(*text_buffer(pa.array(list(known), pa.string())))
        order = np.argsort(ids)
        flag = np.zeros(1 << 16, dtype=bool)
        flag[(ids & np.uint64(0xFFFF)).astype(np.int64)] = True
        total, rows = np.zeros(len(known), dtype=np.int64), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                few = batch.slice(lo, 2000)
                rows += few.num_rows
                found, _, _, at = s.words(*text_buffer(few.column(0)))
                hit = np.flatnonzero(flag[(found & np.uint64(0xFFFF)).astype(np.int64)])
                place = np.minimum(np.searchsorted(ids[order], found[hit]), len(order) - 1)
                real = ids[order][place] == found[hit]
                row = np.searchsorted(at, hit[real], "right") - 1
                pairs = np.unique(row * len(known) + order[place[real]])
                total += np.bincount(pairs % len(known), minlength=len(known))
        terms = [(k, int(n)) for k, n in enumerate(total) if n] + [(-1, rows)]
        yield pa.record_batch([pa.array([k for k, _ in terms], pa.int32()), pa.array([n for _, n in terms], pa.int64())], ["term", "n"])

    got = {r[0]: r[1] for r in texts.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect()}
    return got.pop(-1, 0), {VOCABULARY[k]: n for k, n in got.items()}


def own_licenses(files: DataFrame, threshold: float = 0.6, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, path, own licence, score, start and end of its line, and whether the file speaks for its directory."""
    named = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    n, df = term_counts(named.select("text"))
    sent = files.sparkSession.sparkContext.broadcast(Space(n, df, threshold))
    file_name = re.compile(LICENSE_NAME)

    def scan(batches):
        space = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                few = batch.slice(lo, 2000)
                hit = pc.match_substring_regex(few.column(2), space.pattern, ignore_case=True).fill_null(False).to_pylist()
                out = []
                for maybe, path, text in zip(hit, few.column(1).to_pylist(), few.column(2)):
                    top, name, a, b, heads = 0.0, None, None, None, False
                    if maybe:
                        text = text.as_py()
                        top, name, a, b = space.header(text)
                        heads = bool(name) and not words(text[:a])
                    speaks = bool(name) and (heads or bool(path and file_name.search(path)))
                    out.append((name, top, a, b, speaks) if name else (None, None, None, None, False))
                kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.record_batch([few.column(0), few.column(1), *(pa.array([r[j] for r in out], t) for j, t in enumerate(kinds))], ["doc_id", "path", "license", "score", "start", "end", "speaks"])

    return named.mapInArrow(scan, "doc_id long, path string, license string, score double, start int, end int, speaks boolean")


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(folder: Column) -> Column:
    """The folder and all above it, the root as the empty string."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def scan(files: DataFrame, threshold: float = 0.6, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per file: its licence, own (``header``), from a directory (``inherited``) or none."""
    own = stored(own_licenses(files, threshold, path_col, text_col, id_col), "licenses")
    order = F.struct((-F.col("score")).alias("s"), "path", "doc_id", "license")
    spoken = own.where("speaks and path is not null").groupBy(directory(F.col("path")).alias("folder")).agg(F.min(order).alias("by"))
    # stored, so that the joins meet plain exchanges: all folders look up the root, and a folder may hold most files
    spoken = stored(spoken, "spoken")
    folders = own.where("license is null and path is not null").select(directory(F.col("path")).alias("own_folder")).distinct()
    up = folders.select("own_folder", F.explode(ancestors(F.col("own_folder"))).alias("folder"))
    nearest = up.join(spoken, "folder").groupBy("own_folder").agg(F.max_by("by", F.length("folder")).alias("by"), F.max_by("folder", F.length("folder")).alias("from_folder"))
    nearest = stored(nearest, "nearest")
    has, lacks = own.where("license is not null"), own.where("license is null")
    given = has.select("doc_id", "path", "license", "score", F.lit("header").alias("found"), "start", "end", F.lit(None).cast("long").alias("from_doc_id"), F.lit(None).cast("string").alias("from_folder"))
    taken = lacks.join(nearest, directory(F.col("path")) == F.col("own_folder"), "left")
    taken = taken.select("doc_id", "path", F.col("by.license").alias("license"), (-F.col("by.s")).alias("score"), F.when(F.col("by").isNotNull(), "inherited").otherwise("none").alias("found"), "start", "end", F.col("by.doc_id").alias("from_doc_id"), "from_folder")
    return given.unionByName(taken)


def document_paths(docs: DataFrame) -> DataFrame:
    """A path for documents that have none: source, then two levels of id ranges, then the id."""
    doc = F.col("doc_id")
    return docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(doc / 6400).cast("string"), F.floor(doc / 640).cast("string"), F.concat(doc.cast("string"), F.lit(".txt"))))
