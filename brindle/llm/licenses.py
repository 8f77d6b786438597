"""Operator 4: license scans by sparse TF-IDF cosine, and inheritance from the nearest ancestor directory.

Every line, paragraph and whole text is compared with license templates by the cosine of TF-IDF vectors. Document frequencies of the templates' words are
counted over all files; a word that no template has weighs as one that no file has. A file whose whole text is like a template, or like one of the full license
texts in license_texts/, is a licence file, and so is one that is named LICENSE, COPYING or alike and holds a line or paragraph like a template; another file
that holds one has a header. A bare "All rights reserved." counts only where a text is like nothing else. For full texts, lines of up to 120 characters that tell a copyright's holder are left out, and one is added to each word's inverse
frequency, so that texts are told in a table of nothing but licence files. A licence file told by a full text has that text's license and cosine, not its
likest line's. Files without a header of their own, licence files included, inherit: the nearest directory from their own upwards that holds a licence file
gives its license; where it holds several, the most alike, and then that with the first path.

By the inequality of Cauchy and Schwarz, a text that holds none but a template's most common words can't reach the threshold. The largest such set of words is
worked out, and only lines, paragraphs and texts with another template word (found by Aho-Corasick) are compared. This changes no result.

Only directories are joined with directories: each distinct directory is listed with its ancestors, and the nearest licensed one is taken by a maximum. Files
meet their directory's one row in an equi-join, whose hot keys Spark can split as nothing above needs a directory's files together.

Defined results: null and empty texts have no license of their own; a null path counts as an empty one, in the root directory; rows with equal paths are files of
their own; ties go to the first template; texts of any length are read whole; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from zlib import crc32

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, each_slice, join_unique, pick, slices, small_batches, table, worker_state

THRESHOLD = 0.6
TEXTS = Path(__file__).with_name("license_texts")
COPYRIGHT = re.compile(r"^[^\w\n(©]{0,20}(?:copyright|\(c\)|©|all rights reserved)(?!\w).{0,120}$", re.MULTILINE | re.IGNORECASE)
LICENCE_NAME = re.compile(r"(?:^|/)(?:(?:un)?licen[cs]e|copying)(?:[-_][a-z0-9+]+(?:[-.][0-9]\w*)*)?(?:\.(?:txt|md|rst|lesser|lib|mit|apache2?|bsd|isc|gpl|mpl))?$", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9]+")
WORD_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
PARAGRAPH = re.compile(r"\n[ \t]*\n")

#: SPDX names and the sentences by which their licenses are announced.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]

#: What counts only where a text is like no other template, as texts of free licenses have such lines too.
RESERVED = ("Proprietary", "All rights reserved.")

#: Licenses whose full text is nearly that of another, and how their titles begin: a text like the other's with such a title is theirs.
TITLES = {
    "GPL-3.0": [("AGPL-3.0", "gnu affero general public license")],
    "CC-BY-SA-4.0": [
        ("CC-BY-4.0", "attribution 4 0 international"),
        ("CC-BY-NC-4.0", "attribution noncommercial 4 0 international"),
        ("CC-BY-NC-SA-4.0", "attribution noncommercial sharealike 4 0 international"),
        ("CC-BY-ND-4.0", "attribution noderivatives 4 0 international"),
        ("CC-BY-NC-ND-4.0", "attribution noncommercial noderivatives 4 0 international"),
    ],
}
TITLE_WORDS = 20


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def unsigned(text: str) -> list[str]:
    """Words of a text without the lines that tell a copyright's holder; all words of a text that has only such lines."""
    return words(COPYRIGHT.sub("", text)) or words(text)


@cache
def full_texts() -> list[tuple[str, Counter]]:
    """Licenses and the word counts of their full texts."""
    return [(p.stem, Counter(unsigned(p.read_text(encoding="utf-8")))) for p in sorted(TEXTS.glob("*.txt"))]


class FullTexts:
    """TF-IDF vectors of full license texts."""

    def __init__(self, texts: list[tuple[str, Counter]], frequency: dict[str, int], files: int, threshold: float):
        self.names, self.threshold = [n for n, _ in texts], threshold
        self.top = math.log(1 + files) + 1
        self.idf = {w: math.log((1 + files) / (1 + frequency.get(w, 0))) + 1 for _, t in texts for w in t}
        self.vectors = []
        for _, counts in texts:
            raw = {w: n * self.idf[w] for w, n in counts.items()}
            norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
            self.vectors.append({w: x / norm for w, x in raw.items()})

    def best(self, text: str) -> tuple[str | None, float]:
        """License whose full text a text is most like, and the cosine; none below the threshold."""
        found = unsigned(text)
        weight = {w: n * self.idf.get(w, self.top) for w, n in Counter(found).items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        known = {w: x / norm for w, x in weight.items() if w in self.idf}
        # By the inequality of Cauchy and Schwarz, the words that the full texts have must reach the threshold by themselves.
        if math.sqrt(sum(x * x for x in known.values())) < self.threshold - 1e-9:
            return None, 0.0
        cosines = [sum(x * v[w] for w, x in known.items() if w in v) for v in self.vectors]
        at = max(range(len(cosines)), key=lambda i: (round(cosines[i], 9), -i), default=-1)
        if at < 0 or round(cosines[at], 6) < self.threshold:
            return None, 0.0
        title = f" {' '.join(found[:TITLE_WORDS])} "
        return next((n for n, t in TITLES.get(self.names[at], ()) if f" {t} " in title), self.names[at]), round(cosines[at], 6)


class Index:
    """TF-IDF vectors of templates; one per worker."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], files: int, threshold: float, texts: list[tuple[str, Counter]] | None = None, reserved: tuple[str, str] | None = RESERVED):
        self.names, self.threshold = [n for n, _ in templates], threshold
        self.full = FullTexts(full_texts() if texts is None else texts, frequency, files, threshold)
        vocabulary = sorted({w for _, t in templates for w in words(t)})
        self.top = math.log(1 + files)
        self.idf = {w: math.log((1 + files) / (1 + frequency.get(w, 0))) for w in vocabulary}
        self.vectors = []
        for _, text in templates:
            raw = {w: n * self.idf[w] for w, n in Counter(words(text)).items()}
            norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
            self.vectors.append({w: x / norm for w, x in raw.items()})
        # Common words go in as long as they can't reach the threshold on their own in any template.
        reach, common = [0.0] * len(self.vectors), set()
        for w in sorted(vocabulary, key=lambda w: (self.idf[w], w)):
            more = [r + v.get(w, 0) ** 2 for r, v in zip(reach, self.vectors)]
            if math.sqrt(max(more)) >= threshold - 1e-9:
                break
            reach = more
            common.add(w)
        self.telling = set(vocabulary) - common
        # The last resort has an index of its own, so that it changes no other vector.
        self.reserved = Index([reserved], frequency, files, threshold, [], None) if reserved else None
        # One of its words could reach the threshold where the others are common.
        self.phrase = re.compile(r"(?<![a-z0-9])" + r"[^a-z0-9]+".join(words(reserved[1])) + r"(?![a-z0-9])", re.IGNORECASE) if reserved else None
        self.finder = ahocorasick.Automaton()
        for w in self.telling:
            self.finder.add_word(w, w)
        if self.telling:
            self.finder.make_automaton()

    def best(self, text: str) -> tuple[float, int]:
        """Cosine and number of the template that a text is most like."""
        counts = Counter(words(text))
        if not counts:
            return 0.0, -1
        weight = {w: n * self.idf.get(w, self.top) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        if not norm:
            return 0.0, -1
        found = [sum(x * weight[w] for w, x in v.items() if w in weight) / norm for v in self.vectors]
        at = max(range(len(found)), key=lambda i: (round(found[i], 9), -i))
        return round(found[at], 6), at

    @staticmethod
    def _apart(text: str, end: int, size: int) -> bool:
        """Whether no letter or digit stands on either side of a match."""
        return (end + 1 == len(text) or text[end + 1] not in WORD_CHARACTERS) and (end < size or text[end - size] not in WORD_CHARACTERS)

    def finder_hits(self, text: str) -> list[int]:
        """Ends of the telling words in a text."""
        return [end for end, w in self.finder.iter(text) if self._apart(text, end, len(w))]

    def scan(self, text: str | None) -> tuple[str | None, float, bool]:
        """License and cosine of the text's likest part, and whether the text as a whole is a licence file."""
        found = self._scan(text)
        if found[0] is None and text and self.reserved and self.phrase.search(text) and (last := self.reserved.scan(text))[0]:
            return last
        return found

    def _scan(self, text: str | None) -> tuple[str | None, float, bool]:
        lowered = text.lower() if text else ""
        if not lowered:
            return None, 0.0, False
        full, likeness = self.full.best(lowered) if self.full.names else (None, 0.0)
        hits = self.finder_hits(lowered) if self.telling else []
        if not hits:
            return full, likeness, full is not None
        whole, at = self.best(lowered)
        if full and likeness > whole:
            return full, likeness, True
        is_file, best = whole >= self.threshold, (whole, at)
        seen = set()
        for end in hits:
            line = (lowered.rfind("\n", 0, end) + 1, lowered.find("\n", end))
            if line not in seen:
                seen.add(line)
                best = max(best, self.best(lowered[line[0] : line[1] if line[1] >= 0 else None]), key=lambda x: (x[0], -x[1]))
        for part in PARAGRAPH.split(lowered):
            if "\n" in part.strip("\n") and len(part) < len(lowered) and self.finder_hits(part):
                best = max(best, self.best(part), key=lambda x: (x[0], -x[1]))
        return (self.names[best[1]], best[0], is_file) if best[0] >= self.threshold else (None, best[0], False)


def frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """Files that hold each of the words, and files. Tasks count on their own; at most a count for each word comes to the driver."""
    known = frozenset(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = Counter(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    rows += 1
                    counts.update(known.intersection(words(text)) if text else ())
        yield pa.RecordBatch.from_arrays([pa.array(["", *counts], pa.string()), pa.array([rows, *counts.values()], pa.int64())], ["word", "n"])

    found = small_batches(pick(files, "text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in found}
    return counts, counts.pop("", 0)


def detect(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id", "path")) -> DataFrame:
    """keep, license, score and licence_file of each whole text. Full texts and RESERVED are compared with the module's own templates only; names count if keep has path."""
    texts, reserved = (full_texts(), RESERVED) if templates is None else ([], None)
    templates = TEMPLATES if templates is None else templates
    files = pick(files, *keep, "text")
    frequency, n = frequencies(files, sorted({w for _, t in templates for w in words(t)}.union(*(t for _, t in texts))))
    held = files.sparkSession.sparkContext.broadcast((templates, frequency, n, threshold, texts, reserved))
    tag = crc32(repr((templates, sorted(frequency.items()), n, threshold, len(texts))).encode())
    schema = f"{', '.join(f'`{k}` {files.schema[k].dataType.simpleString()}' for k in keep)}, license string, score double, licence_file boolean"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        index = worker_state(("licenses", tag), lambda: Index(*held.value))
        found = [index.scan(t) for t in part.column("text").to_pylist()]
        if "path" in keep:
            found = [(name, score, is_file or name is not None and bool(LICENCE_NAME.search(path or ""))) for (name, score, is_file), path in zip(found, part.column("path").to_pylist())]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds))], [*keep, "license", "score", "licence_file"])

    return small_batches(files).mapInArrow(each_slice(work, "text"), schema)


def inherit(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, path, license, how (file, header, inherited or none), score, and origin, the path of the file that tells the license."""
    folder = F.regexp_replace(F.coalesce("path", F.lit("")), "/?[^/]*$", "")
    found = pick(found, key, "path", "license", "score", "licence_file").withColumn("folder", folder)
    told = found.filter("licence_file").groupBy("folder").agg(F.min_by(F.struct("license", "path"), F.struct(-F.col("score"), "path")).alias("told"))
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    upwards = found.select("folder").distinct().select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    upwards = upwards.select(F.col("folder").alias("below"), "depth", F.array_join(F.expr("slice(parts, 1, depth)"), "/").alias("folder"))
    nearest = upwards.join(told, "folder").groupBy("below").agg(F.max_by("told", "depth").alias("told")).withColumnRenamed("below", "folder")
    out = join_unique(found, nearest, "folder", "left")
    own, given = F.col("license").isNotNull(), F.col("told").isNotNull()
    how = F.when(F.col("licence_file"), "file").when(own, "header").when(given, "inherited").otherwise("none")
    return out.select(key, "path", F.when(own, F.col("license")).otherwise(F.col("told.license")).alias("license"), how.alias("how"), "score", F.when(own, F.col("path")).otherwise(F.col("told.path")).alias("origin"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are taken as files in one, two or three directories: source, language, and a number."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    lang, number = F.coalesce("lang", F.lit("und")), F.concat(F.lit("d"), (F.col("doc_id") % 8).cast("string"))
    path = F.when(F.col("doc_id") % 5 == 0, F.concat_ws("/", "source", name)).when(F.col("doc_id") % 5 == 1, F.concat_ws("/", "source", lang, name)).otherwise(F.concat_ws("/", "source", lang, number, name))
    # What is found is read three times: as files, as licence files and as directories.
    found = Scratch(spark).keep(detect(docs.select("doc_id", path.alias("path"), "text")), "found")
    return inherit(found)
