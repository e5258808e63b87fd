"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance.

A header is a sentence that has a trigger word: one of a single line, or one of a block, where a
block is a run of lines without a blank one, all with or all without a comment mark, and a wrapped
sentence also counts from each of its lines on. Whole blocks count too. The sparse TF-IDF vector of
each (inverse document frequency over the templates) is compared with every template; the nearest
at LEAST_COSINE or more is the file's own licence. A text with a trigger word is also compared as a
whole with the texts in `licences`, where counts of terms are damped; the nearest at WHOLE_COSINE or
more goes before all headers. A licence file is one whose name says so, one that matches as a whole,
or one most of whose words stand in headers that match; it also licenses its directory. A file with no
licence of its own inherits from its nearest ancestor directory that has one, by joins of paths.

A null or empty text has no header; a null path has no directory. Ties of cosine go to the name
that sorts first, in a directory to the higher cosine and then that name. Repeated rows are judged
alike, other columns are not read. Very long texts are compared whole. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staging, map_arrow, small_batches

LEAST_COSINE, WHOLE_COSINE = 0.6, 0.8
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, "
    "either version {} of the License, or (at your option) any later version."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
)
# Names and wording of common licence notices, titles and standard headers.
TEMPLATES = {
    "agpl-3.0": ["licensed under the GNU Affero General Public License, version 3", "GNU Affero General Public License Version 3, 19 November 2007", _GNU.format("Affero General", "3")],
    "all-rights-reserved": ["All rights reserved."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "Apache License Version 2.0, January 2004"],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl-2.0": ["licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991", _GNU.format("General", "2")],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007", _GNU.format("General", "3")],
    "lgpl-2.1": ["licensed under the GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License Version 2.1, February 1999", _GNU.format("Lesser General", "2.1")],
    "lgpl-3.0": ["licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License Version 3, 29 June 2007", _GNU.format("Lesser General", "3")],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", _MIT],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
}
TRIGGER = re.compile(r"licen[cs]e|rights reserved|redistribution|hereby granted|public domain|copyright", re.IGNORECASE)
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
_MARK = re.compile(r"^\s*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--|%+|dnl\b|rem\b)", re.IGNORECASE)
_CLOSE = re.compile(r"\s*(?:\*+/|-->)\s*$")
_TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


@cache
def whole_licences() -> dict[str, list[str]]:
    """Texts of whole licences. That of the AGPL is the GPL's, which it follows, with its own name and section 13."""
    out = {p.stem: [p.read_text()] for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
    affero = re.sub(r"(?i)GNU General", "GNU Affero General", out["gpl-3.0"][0])
    more = "Remote Network Interaction; if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source from a network server"
    return out | {"agpl-3.0": [f"{affero}\n{more}"]}


def blocks(text: str) -> list[list[str]]:
    """Runs of lines that are not blank and all have or all lack a comment mark, without the marks.

    A line that only closes a comment, or only has a mark, is blank.
    """
    lines = [(bool(_MARK.match(x)), _CLOSE.sub("", _MARK.sub("", x)).strip()) for x in text.split("\n")]
    return [[x for _, x in run] for (_, full), run in groupby(lines, lambda x: (x[0], bool(x[1]))) if full]


def wrapped(lines: list[str]) -> list[list[str]]:
    """Sentences of a block that stand on more than one line, as their pieces by line."""
    out, now = [], []
    for line in lines:
        for k, piece in enumerate(_SENTENCE.split(line)):
            if k or (now and now[-1].endswith((".", "!", "?", ";"))):
                out.append(now)
                now = []
            now.append(piece)
    return [x for x in [*out, now] if len(x) > 1]


class Matcher:
    """Sparse TF-IDF vectors of templates; damped: a term counts 1 + ln n."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, damped: bool = False):
        self.damped = damped
        self.names = [n for n in sorted(templates) for _ in templates[n]]
        bags = [terms(t) for n in sorted(templates) for t in templates[n]]
        df = Counter(w for b in bags for w in b)
        self.idf = {w: float(np.log((1 + len(bags)) / (1 + k)) + 1) for w, k in df.items()}
        self.unseen = float(np.log(1 + len(bags)) + 1)
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, b in enumerate(bags):
            v = self.vector(b)
            for w, x in v.items():
                self.postings.setdefault(w, []).append((i, x))

    def vector(self, bag: Counter) -> dict[str, float]:
        v = {w: (1 + float(np.log(k)) if self.damped else k) * self.idf.get(w, self.unseen) for w, k in bag.items()}
        norm = sum(x * x for x in v.values()) ** 0.5 or 1.0
        return {w: x / norm for w, x in v.items()}

    def nearest(self, text: str) -> tuple[str | None, float]:
        sums: dict[int, float] = {}
        for w, x in self.vector(terms(text)).items():
            for i, y in self.postings.get(w, ()):
                sums[i] = sums.get(i, 0.0) + x * y
        best = min(sums, key=lambda i: (-round(sums[i], 9), self.names[i]), default=None)
        return (None, 0.0) if best is None else (self.names[best], min(sums[best], 1.0))

    def tails(self, pieces: list[str]) -> list[tuple[str | None, float]]:
        """As nearest, for the pieces from each one on, each term taken up once."""
        bag: Counter = Counter()
        sums: dict[int, float] = {}
        square, out = 0.0, []
        for piece in reversed(pieces):
            for w, k in terms(piece).items():
                x = self.idf.get(w, self.unseen)
                square += x * x * ((bag[w] + k) ** 2 - bag[w] ** 2)
                bag[w] += k
                for i, y in self.postings.get(w, ()):
                    sums[i] = sums.get(i, 0.0) + k * x * y
            best = min(sums, key=lambda i: (-round(sums[i] / square**0.5, 9), self.names[i]), default=None)
            out.append((None, 0.0) if best is None else (self.names[best], min(sums[best] / square**0.5, 1.0)))
        return out[::-1]

    def scan(self, text: str, whole: Matcher | None = None) -> tuple[str | None, float, float]:
        """Licence, cosine, and the share of the text's words that stand in matching headers."""
        if not TRIGGER.search(text):
            return None, 0.0, 0.0
        if whole:
            name, cosine = whole.nearest(text)
            if cosine >= WHOLE_COSINE:
                return name, cosine, 1.0
        best, held = (None, 0.0), 0
        for line in text.split("\n"):
            if not TRIGGER.search(line):
                continue
            for sentence in _SENTENCE.split(line):
                if TRIGGER.search(sentence):
                    name, cosine = self.nearest(sentence)
                    if name and cosine >= LEAST_COSINE:
                        held += len(sentence.split())
                        if best[0] is None or (-cosine, name) < (-best[1], best[0]):
                            best = (name, cosine)
        joined = 0
        for lines in blocks(text):
            if len(lines) < 2 or not TRIGGER.search(" ".join(lines)):
                continue
            words = []
            for pieces in [*wrapped(lines), lines]:
                words.append(0)
                if not TRIGGER.search(" ".join(pieces)):
                    continue
                at, (name, cosine) = max(enumerate(self.tails(pieces)), key=lambda x: (round(x[1][1], 9), x[0]))
                if name and cosine >= LEAST_COSINE and TRIGGER.search(" ".join(pieces[at:])):
                    words[-1] = sum(len(x.split()) for x in pieces[at:])
                    if best[0] is None or (-cosine, name) < (-best[1], best[0]):
                        best = (name, cosine)
            joined += max(sum(words[:-1]), words[-1])
        held = max(held, joined)
        return (*best, held / max(len(text.split()), 1))


def own_licences(files: DataFrame, path: Column, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, path, dir, own, cosine, is_file)."""
    small_batches(files.sparkSession)
    lean = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    kind = lean.schema["doc_id"].dataType.simpleString()
    matcher, whole = Matcher(), Matcher(whole_licences(), damped=True)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [matcher.scan(t or "", whole) for t in batch.column(2).to_pylist()]
        cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "path", "own", "cosine", "share"])

    found = map_arrow(lean, run, f"doc_id {kind}, path string, own string, cosine double, share double")
    name = F.substring_index("path", "/", -1)
    is_file = F.col("own").isNotNull() & (F.coalesce(name.rlike(LICENCE_NAME), F.lit(False)) | (F.col("share") >= 0.5))
    folder = F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1)
    return found.select("doc_id", "path", folder.alias("dir"), "own", "cosine", is_file.alias("is_file"))


def inherit(found: DataFrame) -> DataFrame:
    """Adds `inherited` and `from_dir`: the licence of the nearest directory on the way to the root.

    Directories, not files, are joined with their ancestors; a directory that holds a third of all
    files is one large key of the last join, which the adaptive skew join splits.
    """
    best = F.struct((-F.col("cosine")).alias("c"), F.col("own"))
    licensed = found.where("is_file and dir is not null").groupBy("dir").agg(F.min(best).alias("best"))
    licensed = licensed.select(F.col("dir").alias("up"), F.col("best.own").alias("inherited"))
    dirs = found.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ways = dirs.select("dir", F.posexplode(F.array_distinct(ups)).alias("depth", "up"))
    near = ways.join(licensed, "up").groupBy("dir").agg(F.max_by(F.struct("inherited", F.col("up").alias("from_dir")), "depth").alias("near"))
    return found.join(near, "dir", "left").withColumns({"inherited": F.col("near.inherited"), "from_dir": F.col("near.from_dir")}).drop("near")


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, path, licence, cosine, basis, from_dir); basis is own, inherited or none."""
    # the texts are read once: what is found is small and used three times
    out = inherit(Staging(files.sparkSession).put(own_licences(files, path, id_col, text_col)))
    basis = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    from_dir = F.when(basis == "inherited", F.col("from_dir"))
    return out.select("doc_id", "path", F.coalesce("own", "inherited").alias("licence"), F.round("cosine", 9).alias("cosine"), basis.alias("basis"), from_dir.alias("from_dir"))
