"""Licence families of paragraphs: sparse n-gram logistic regression in Spark SQL."""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "Creative Commons Attribution 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "This document is confidential and proprietary; no part may be reproduced without written permission.",
    ),
}
#: How short notices name each family; the first is its identifier.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT", "MIT license"),
    "Apache-2.0": ("Apache-2.0", "Apache License 2.0"),
    "GPL-3.0": ("GPL-3.0-or-later", "GPLv3", "GNU GPL version 3"),
    "GPL-2.0": ("GPL-2.0-only", "GPLv2", "GNU GPL version 2"),
    "LGPL": ("LGPL-2.1-or-later", "LGPLv3", "GNU LGPL"),
    "AGPL-3.0": ("AGPL-3.0-only", "AGPLv3", "GNU AGPL"),
    "BSD": ("BSD-3-Clause", "BSD license", "3-clause BSD license"),
    "MPL-2.0": ("MPL-2.0", "Mozilla Public License 2.0"),
    "CC-BY-NC": ("CC-BY-NC-4.0", "CC BY-NC"),
    "CC-BY-SA": ("CC-BY-SA-4.0", "CC BY-SA"),
    "CC-BY": ("CC-BY-4.0", "CC BY"),
    "CC0": ("CC0-1.0", "CC0"),
}
#: Frames of short notices to learn from, and others that only calibrate.
FRAMES = ("SPDX-License-Identifier: {id}", "{id}", "Licensed under {name}", "Released under the {name}", "distributed under the terms of the {name}", "{name} licence")
HELD_FRAMES = ("available under the {name} licence", "License: {id}", "covered by the {name}", "see the {name} for licence details")
#: Sentences that name no licence though they use its words.
OTHER = (
    "He lost his driving license last year.",
    "The fishing license costs twenty dollars.",
    "A copyright dispute went to court in spring.",
    "The warranty covers parts and labour for one year.",
    "The new version of the work was released to the public.",
    "Software under test is free of known errors.",
    "Under the terms of the contract the work is done in June.",
    "The general told the public that the foundation was free to act.",
    "The license plate was found near the apache helicopter.",
    "Students may obtain a copy of the file at the office.",
    "The creative commons room is open to all members.",
    "No part of the building may be used without permission.",
    "The notice above the door must be retained by the tenant.",
    "She was granted a licence to sell drinks, free of charge.",
    "The bakery distributes bread under a contract with the city.",
    "All conditions of the sale are listed on the following page.",
    "The library is free and open to any person in the town.",
    "Version 2 of the plan was published by the foundation in May.",
)
#: More of these, which only calibrate.
HELD_OTHER = (
    "Without a valid licence nobody may drive on public roads.",
    "The pub applied for a new licence in March.",
    "Copyright law differs between countries.",
    "A gnu is a large antelope of the African plains.",
    "The warranty is void if the seal is broken.",
    "The minister said the licence fee would be abolished.",
    "Proprietary medicines are sold at the counter.",
    "Everything in the public domain was read aloud by the children.",
    "The museum holds the rights to the painting.",
    "They were permitted to redistribute the food to the poor.",
    "The file on the case was provided to the court as is.",
    "A general licence was issued to the merchants of the port.",
)
UNKNOWN = "unknown"
ANCHOR = r"(?i)licen[cs]|copyright|public domain|cc0|all rights reserved|warrant|\bgnu\b|\b[la]?gpl|free of charge|redistribut|proprietary|creative commons|\bcc[ -]by|\bmpl\b"
#: The same terms where a line may end between two words.
WRAPPED = ANCHOR.replace("public domain", r"public\s+domain").replace("all rights reserved", r"all\s+rights\s+reserved").replace("free of charge", r"free\s+of\s+charge").replace("creative commons", r"creative\s+commons").replace("cc[ -]by", r"cc(?:\s+|-)by")
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Words of a window over wrapped lines: half as many again as the longest template has.
REACH = 3 * max(len(t.split()) for texts in TEMPLATES.values() for t in texts) // 2
#: Up to eight words of one line; windows start and end at the borders of these.
PIECE = r"\S++(?:[^\S\n]++\S++){0,7}"
#: A line's end, or a piece with the window that starts there as group 1; a window ends at a blank line.
WINDOW = rf"\n|(?=(\S++(?:[^\S\n]*+\n?[^\S\n]*+\S++){{0,{REACH - 1}}})){PIECE}"
#: Weights are looked up by n-gram in so many maps, so that a look-up scans few of them.
MAPS = 64


def grams(text: str) -> list[str]:
    w = re.findall(TOKEN, text.lower())
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))})


def mentions(family: str, frames: tuple[str, ...]) -> list[str]:
    """Short notices of a family, one for each frame and name."""
    if family not in NAMES:
        return []
    first, *names = NAMES[family]
    return [frame.format(id=first, name=name) for frame in frames for name in (names or [first])]


def confirming(family: str) -> list[list[str]]:
    """N-grams of what can confirm a family: those of its templates, and the word pairs of its names in a short notice."""
    first, *names = NAMES.get(family, ("",))
    short = [f"SPDX-License-Identifier: {first}", f"license {first}"] if first else []
    short += [n for n in names if len(n.split()) > 1]
    short += [f"{a} {n}" for n in (names or [first]) if n for a in ("under", "the")]
    short += [f"{n} {w}" for n in (first, *names) if n for w in ("licence", "license")]
    pairs = [[g for g in grams(t) if " " in g] for t in short]
    return [*map(grams, TEMPLATES[family]), *pairs]


def _examples(rng: np.random.Generator, families: dict[str, list[str]], filler: list[str], copies: int) -> list[tuple[str, str]]:
    """Texts by family, each also with words dropped and filler around it."""
    out = []
    for family, texts in families.items():
        for text in texts:
            out.append((family, text))
            w = text.split()
            for _ in range(copies):
                kept = [x for x in w if rng.random() > 0.08] or w
                around = [list(rng.choice(filler, rng.integers(0, 6))) for _ in range(2)]
                out.append((family, " ".join([*around[0], *kept, *around[1]])))
    return out


class Rows:
    """Sparse rows of n-grams, each row scaled to length one; the last column is the bias."""

    def __init__(self, texts: list[str], vocab: dict[str, int]):
        found = [[vocab[g] for g in grams(t) if g in vocab] for t in texts]
        size = np.array([len(x) for x in found])
        self.n, self.width = len(texts), len(vocab)
        self.column = np.array([c for x in found for c in x], np.int64)
        self.row = np.repeat(np.arange(self.n), size)
        self.value = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
        self.by_column = np.argsort(self.column, kind="stable")
        self.edge = np.searchsorted(self.column[self.by_column], np.arange(self.width + 1))

    def times(self, w: np.ndarray) -> np.ndarray:
        sums = np.vstack((np.zeros(w.shape[1]), np.cumsum(w[self.column] * self.value[:, None], axis=0)))
        edge = np.searchsorted(self.row, np.arange(self.n + 1))
        return sums[edge[1:]] - sums[edge[:-1]] + w[-1]

    def transposed_times(self, y: np.ndarray) -> np.ndarray:
        sums = np.vstack((np.zeros(y.shape[1]), np.cumsum((y[self.row] * self.value[:, None])[self.by_column], axis=0)))
        return np.vstack((sums[self.edge[1:]] - sums[self.edge[:-1]], y.sum(axis=0)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=4)
def train(seed: int = 11, copies: int = 4, steps: int = 160, l2: float = 2e-4) -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """Families, weights by n-gram, bias, and the probability under which a paragraph is unknown.

    Everything it learns from is fixed text of this module, so its size doesn't
    depend on the corpus.  Calibration uses frames and sentences that training
    has not seen: a temperature, by which weights and bias are divided, makes
    their likelihood greatest, and the cut is where of the held unknown examples
    one in a hundred would pass.
    """
    rng = np.random.default_rng(seed)
    filler = [w for t in OTHER for w in t.lower().strip(".").split()]
    names = [*TEMPLATES, UNKNOWN]
    learned = {f: [*texts, *mentions(f, FRAMES)] for f, texts in TEMPLATES.items()} | {UNKNOWN: list(OTHER)}
    data = _examples(rng, learned, filler, copies)
    held = _examples(rng, {f: mentions(f, HELD_FRAMES) for f in NAMES} | {UNKNOWN: list(HELD_OTHER)}, filler, copies)
    vocab = {g: i for i, g in enumerate(sorted({g for texts in learned.values() for t in texts for g in grams(t)}))}
    x, y = Rows([t for _, t in data], vocab), np.eye(len(names))[[names.index(f) for f, _ in data]]
    w, speed = np.zeros((len(vocab) + 1, len(names))), np.zeros((len(vocab) + 1, len(names)))
    for _ in range(steps):
        speed = 0.9 * speed - (x.transposed_times(softmax(x.times(w)) - y) / len(data) + l2 * w)
        w += 4.0 * speed
    z, truth = Rows([t for _, t in held], vocab).times(w), np.array([names.index(f) for f, _ in held])
    loss = {t: -np.log(softmax(z / t)[np.arange(len(held)), truth]).mean() for t in np.geomspace(0.25, 8, 61)}
    w /= min(loss, key=loss.get)
    sure = softmax(Rows([t for _, t in held], vocab).times(w))[truth == names.index(UNKNOWN), :-1].max(axis=1)
    cut = float(min(0.95, np.quantile(sure, 0.99)))
    return names, {g: [round(v, 6) for v in w[i]] for g, i in vocab.items()}, [round(v, 6) for v in w[-1]], round(cut, 6)


def _grams(text: Column) -> tuple[Column, Column]:
    """Words of a text, and from a column of them its distinct words and word pairs."""
    pair = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})")), F.array_distinct(F.concat("w", F.filter(pair, lambda x: x.isNotNull())))


def _confirming(short: bool) -> Column:
    """What confirms a family as a constant array of struct(f: family, g: n-grams); short: names in short notices too."""
    rows = [{"f": f, "g": g} for f in TEMPLATES for g in confirming(f)[: None if short else len(TEMPLATES[f])]]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<f:string,g:array<string>>>")


def _share(rows: Column) -> Column:
    """The greatest share of n-grams of one of the rows that are in the column grams."""
    return F.array_max(F.transform(rows, lambda t: F.size(F.array_intersect(F.col("grams"), t.g)) / F.size(t.g).cast("double")))


def _candidates(docs: DataFrame, doc_id: str, text: str, confirm: float) -> DataFrame:
    """One row for each line with an anchor term and each stretch of wrapped lines that may hold a template; nulls where a document has none.

    Columns doc_id, h, first and last (lines), a and b (pieces of a stretch; a
    is null for a line) and paragraph.
    """
    body = docs[text].cast("string")
    row = "array<struct<first:int,a:int,text:string>>"
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x, i: F.struct(i.cast("int").alias("first"), F.lit(None).cast("int").alias("a"), x.alias("text"))), lambda x: x.text.rlike(ANCHOR))

    def wrapped(all_: Column) -> Column:
        found = F.filter(F.transform(all_, lambda v, i: F.struct(v.alias("text"), i.cast("int").alias("a"))), lambda x: x.text.contains("\n") & x.text.rlike(WRAPPED))
        line = lambda x: F.size(F.filter(F.slice(all_, F.lit(1), x.a), lambda v: v == ""))
        return F.transform(found, lambda x: F.struct(line(x).alias("first"), x.a.alias("a"), x.text.alias("text")))

    windows = F.transform(F.array(F.regexp_extract_all(body, F.lit(WINDOW), F.lit(1))), wrapped)[0]
    both = F.when(body.rlike(WRAPPED), F.concat(lines.cast(row), windows.cast(row)))
    df = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(body).alias("h"), F.explode_outer(both).alias("p")).select("doc_id", "h", "p.*")
    w, g = _grams(F.col("text"))
    df = df.withColumn("w", w).withColumn("grams", F.when(F.col("a").isNotNull(), g))
    df = df.withColumn("near", F.when(F.col("a").isNotNull(), _share(_confirming(False))))
    items = F.regexp_extract_all("text", F.lit(rf"\n|{PIECE}"), F.lit(0))
    heads = lambda x: F.filter(F.transform(x, lambda _, i: F.slice(x, F.lit(1), i + 1)), lambda y: (F.element_at(y, -1) != "\n") & F.array_contains(y, "\n"))
    heads = F.transform(F.transform(F.array(items), heads)[0], lambda y: F.struct(F.size(y).alias("m"), F.size(F.filter(y, lambda v: v == "\n")).alias("more"), F.array_join(y, " ").alias("text")))
    alone = F.array(F.struct(F.lit(0).alias("m"), F.lit(0).alias("more"), F.col("text")))
    df = df.withColumn("p", F.explode_outer(F.when(F.col("a").isNull(), alone).when(F.col("near") >= confirm, heads)))
    paragraph = F.when(F.col("a").isNull(), F.col("p.text")).otherwise(F.replace(F.col("p.text"), F.lit(" \n "), F.lit("\n")))
    return df.select("doc_id", "h", "first", (F.col("first") + F.col("p.more")).alias("last"), "a", (F.col("a") + F.col("p.m")).alias("b"), paragraph.alias("paragraph"))


def _chosen(lines: Column, spans: Column) -> Column:
    """The best stretches without overlap, apart from lines that are sure by themselves, and the lines outside them."""
    sure = F.filter(lines, lambda x: x.confirmed)
    free = F.filter(spans, lambda x: ~F.exists(sure, lambda y: y.first.between(x.first, x.last)))
    order = F.array_sort(F.transform(free, lambda x: F.struct((-x.similarity).alias("far"), (x.b - x.a).alias("size"), x.a.alias("a"), x.alias("x"))))
    none = F.slice(spans, F.lit(1), F.lit(0))
    best = F.aggregate(order, none, lambda acc, o: F.when(F.exists(acc, lambda y: (y.a < o.x.b) & (o.x.a < y.b)), acc).otherwise(F.concat(acc, F.array(o.x))))
    return F.transform(F.array(best), lambda taken: F.concat(F.filter(lines, lambda x: x.confirmed | ~F.exists(taken, lambda y: x.first.between(y.first, y.last))), taken))[0]


def license_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", confirm: float = 0.6) -> DataFrame:
    """One row for each document and paragraph with an anchor term, or with nulls where it has none.

    A paragraph is a line, or a confirmed notice wrapped over lines without a
    blank one between; this takes the place of its lines, but for lines that are
    confirmed by themselves.  Columns doc_id, h (hash of the text), paragraph_no
    (its first line), paragraph, family, probability, similarity and confirmed.
    """
    names, weights, bias, cut = train()
    maps: list[dict] = [{} for _ in range(MAPS)]
    for g, v in weights.items():
        maps[zlib.crc32(g.encode()) % MAPS][g] = v
    model = F.from_json(F.lit(json.dumps(maps)), "array<map<string,array<double>>>")
    df = _candidates(docs, doc_id, text, confirm)
    w, g = _grams(F.col("paragraph"))
    df = df.withColumn("w", w).withColumn("grams", g)
    weight = lambda g: F.element_at(F.element_at(model, (F.crc32(g) % MAPS + 1).cast("int")), g)
    hits = F.filter(F.transform("grams", weight), lambda v: v.isNotNull())
    df = df.withColumn("hits", hits)
    zero = F.array(*[F.lit(0.0)] * len(names))
    sums = F.aggregate("hits", zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    scale = 1 / F.sqrt(F.greatest(F.lit(1.0), F.size("hits").cast("double")))
    df = df.withColumn("z", F.zip_with(F.transform(sums, lambda s: s * scale), F.array(*map(F.lit, bias)), lambda a, b: a + b))
    df = df.withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    df = df.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    best = F.array_position("e", F.array_max("e")).cast("int")
    df = df.withColumn("best", F.element_at(F.array(*map(F.lit, names)), best)).withColumn("probability", F.array_max("e") / F.col("total"))

    similarity = F.coalesce(_share(F.filter(_confirming(True), lambda t: t.f == F.col("best"))), F.lit(0.0))
    df = df.withColumn("similarity", F.when(F.col("paragraph").isNotNull(), similarity))
    sure = (F.col("best") != UNKNOWN) & (F.col("probability") >= cut) & (F.col("similarity") >= confirm)
    df = df.withColumn("confirmed", F.coalesce(sure & F.col("paragraph").isNotNull(), F.lit(False)))
    df = df.withColumn("family", F.when(F.col("confirmed"), F.col("best")).otherwise(F.lit(UNKNOWN)))
    row = F.struct("first", "last", "a", "b", "paragraph", "family", "probability", "similarity", "confirmed")
    line, span = F.col("a").isNull() & F.col("paragraph").isNotNull(), F.col("a").isNotNull() & F.col("confirmed")
    df = df.groupBy("doc_id", "h").agg(F.collect_set(F.when(line, row)).alias("lines"), F.collect_set(F.when(span, row)).alias("spans"))
    df = df.select("doc_id", "h", F.explode_outer(_chosen(F.col("lines"), F.col("spans"))).alias("p"))
    return df.select("doc_id", "h", F.col("p.first").alias("paragraph_no"), "p.paragraph", "p.family", "p.probability", "p.similarity", F.coalesce("p.confirmed", F.lit(False)).alias("confirmed"))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its confirmed licence families.

    Returns doc_id, families (sorted), license (the family, 'mixed' for several,
    'none' without), n_candidates (paragraphs with an anchor term: lines, a
    wrapped notice being one), n_licensed (confirmed ones) and score (highest
    probability of a confirmed one).

    Corner cases: null and empty texts have none; rows that repeat id and text
    give one row; rows without an id are grouped by text; other columns are
    ignored; an empty table gives an empty result.
    """
    p = license_paragraphs(docs, doc_id, text)
    out = p.groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        F.count("paragraph").alias("n_candidates"),
        F.sum(F.col("confirmed").cast("long")).alias("n_licensed"),
        F.coalesce(F.max(F.when(F.col("confirmed"), F.col("probability"))), F.lit(0.0)).alias("score"),
    )
    license_ = F.when(F.size("families") == 0, F.lit("none")).when(F.size("families") == 1, F.col("families")[0]).otherwise(F.lit("mixed"))
    return out.select("doc_id", license_.alias("license"), F.array_join("families", ",").alias("families"), "n_candidates", "n_licensed", "score")
