"""License scans with DataFrame functions only: a trained paragraph classifier, confirmed by comparison with templates.

A multinomial logistic regression over sparse word 1- and 2-grams tells licence families apart. It is trained on the
driver from the templates below and from paragraphs without a licence; its n-grams are those of the templates, so its
size is fixed. Probabilities, the unknown class's included, are calibrated by a temperature fitted on whole templates held
out. A prediction is confirmed by comparison with that family's templates.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Notices and licence paragraphs by family, as their stewards publish them (fixed values).
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "This product is licensed to you under the Apache License, Version 2.0. You may not use this product except in compliance with the Apache 2.0 License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL v3, the GNU General Public License version 3.0 (GPLv3).",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GPL v2, the GNU General Public License version 2.0 (GPLv2). Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution 4.0 International License, which permits unrestricted use, distribution, and reproduction in any medium, provided you give appropriate credit to the original author.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Licensed under the zlib License.", "SPDX-License-Identifier: Zlib",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
UNKNOWN = [
    "All rights reserved.", "Copyright notice.", "Licensed under a custom license.", "This text is licensed; ask the owner for terms.", "See the license file for details.",
    "A driving license is needed for this.", "He asked for permission to leave the school.", "The warranty is void.", "A public domain name was registered.",
    "the copyright of the book is held by the author", "You may not use this without permission.", "Proprietary license: do not distribute.", "the software is distributed with the general license of the company",
    "Free software foundation news", "The foundation published its free software report for the general public.", "The software is provided to all members of the school.",
    "Copyright 2019 by the authors. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    "The council granted the restaurant a license to serve drinks after ten.", "Our products come with a limited warranty of two years from the date of purchase.",
    "This document is confidential and may not be redistributed in any form.", "Terms of use: by using this site you agree to the following conditions.",
    "The eclipse will be public and free of charge.", "The creative use of common words is the attribution of a good author.", "An international license is required to drive abroad.",
]
#: What tells of a licence in a paragraph's words (joined by single spaces): it is then reported even if no family is confirmed.
STEMS = ("licen", "copyright", "permission", "redistribut", "spdx", "public domain", "creative commons", "cc by", "cc0", "free software", "warrant",
         "apache 2", "apache v2", "gpl", " mpl ", " bsd ", " isc ")  # not "mit": a common German word
EVERYDAY = "the of and to in is that for on with a as be by this are was from it at or an not have which one had we you".split()
FAMILIES = (*sorted(TEMPLATES), "unknown")


def words_of(text: str) -> list[str]:
    cleaned = "".join(c if c.isascii() and (c.isalnum() or c == ".") else " " for c in text.lower())
    return [w for w in (x.strip(".") for x in cleaned.split()) if w]


def grams_of(text: str) -> set[str]:
    w = words_of(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


def words_column(text: Column) -> Column:
    """``words_of`` as a column."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9.]", " "), " +")
    return F.filter(F.transform(parts, lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: w != "")


def specific() -> dict[str, int]:
    """2-grams that only one family's templates hold, with the family's number: without everyday words, or with one next
    to a number ("by 4.0"). A paragraph is never confirmed without one."""
    held: dict[str, set[int]] = {}
    for y, family in enumerate(FAMILIES[:-1]):
        for g in set().union(*(grams_of(t) for t in TEMPLATES[family])):
            held.setdefault(g, set()).add(y)

    def tells(g: str) -> bool:
        parts = g.split()
        return len(parts) == 2 and (not set(parts) & set(EVERYDAY) or any(c.isdigit() for c in g))

    return {g: min(ys) for g, ys in sorted(held.items()) if len(ys) == 1 and tells(g)}


def signs() -> str:
    """Pattern of all specific 2-grams and of the stems over lowered text, gaps of any kind."""
    seconds: dict[str, list[str]] = {}
    for g in specific():
        seconds.setdefault(g.split()[0], []).append(g.split()[1].replace(".", r"\."))
    gap, letters = "[^a-z0-9]+", {}
    for w, after in seconds.items():
        letters.setdefault(w[0], []).append(w[1:].replace(".", r"\.") + gap + "(?:" + "|".join(after) + ")")
    pairs = "|".join(f"{c}(?:{'|'.join(x)})" for c, x in letters.items())
    stems = "|".join(("(?<![a-z0-9])" if x[0] == " " else "") + gap.join(x.split()) + ("(?![a-z0-9])" if x[-1] == " " else "") for x in STEMS)
    return f"(?<![a-z0-9])(?:{pairs})(?![a-z0-9])|{stems}"


def _examples(rng, per_template: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Templates whole, with words lost, cut to a part and among other words; their classes and the template's number."""
    texts, kinds, of = [], [], []
    for y, family in enumerate(FAMILIES):
        for n, t in enumerate(TEMPLATES.get(family, UNKNOWN)):
            for k in range(per_template):
                w = t.split()
                if k and len(w) > 6:
                    w = [x for x in w if rng.random() > 0.1]
                if k % 4 == 2 and len(w) > 24:
                    at = int(rng.integers(0, len(w) - 16))
                    w = w[at : at + 16]
                if k % 3 == 1:
                    w = [*rng.choice(EVERYDAY, rng.integers(1, 12)), *w, *rng.choice(EVERYDAY, rng.integers(1, 12))]
                texts.append(" ".join(w))
                kinds.append(y)
                of.append(n)
    for n in range(60):
        texts.append(" ".join(rng.choice(EVERYDAY, rng.integers(2, 40))))
        kinds.append(len(FAMILIES) - 1)
        of.append(n)
    return texts, np.array(kinds), np.array(of)


def _fit(x: np.ndarray, y: np.ndarray, steps: int) -> np.ndarray:
    w, goal = np.zeros((x.shape[1], len(FAMILIES)), dtype=np.float32), np.eye(len(FAMILIES), dtype=np.float32)[y]
    speed = np.zeros_like(w)
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed + x.T @ (goal - p) / len(x) * 20 - 2e-4 * w
        w += speed
    return w


@functools.cache
def train(seed: int = 7, per_template: int = 6, steps: int = 120, folds: int = 4) -> dict:
    """Weights, temperature and template n-grams; the same for every run.

    Whole templates are held out in turn, and the temperature comes from paragraphs of templates that the fold's model
    hasn't seen in any form; so do ``new_accuracy`` and ``new_wrong``, the share of them put surely (0.5) into a wrong
    family. ``held_out_accuracy`` is that for other variants of known templates. The model itself is fitted on all.
    """
    texts, y, of = _examples(np.random.default_rng(seed), per_template)
    vocabulary = sorted(set().union(*(grams_of(t) for ts in TEMPLATES.values() for t in ts), *(grams_of(t) for t in UNKNOWN)))
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary) + 1), dtype=np.float32)
    for r, t in enumerate(texts):
        hits = [at[g] for g in grams_of(t) if g in at]
        x[r, hits] = 1 / np.sqrt(max(1, len(hits)))
    x[:, -1] = 1
    z, fold = np.zeros((len(y), len(FAMILIES)), dtype=np.float32), of % folds
    for k in range(folds):
        z[fold == k] = x[fold == k] @ _fit(x[fold != k], y[fold != k], steps)

    def loss(t):
        s = z / t - (z / t).max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y]))

    heat = min(np.geomspace(0.25, 8, 41), key=loss)
    w, test = _fit(x, y, steps), np.arange(len(y)) % 5 == 0
    right = float(np.mean((x[test] @ _fit(x[~test], y[~test], steps)).argmax(1) == y[test]))
    p = np.exp(z / heat - (z / heat).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    wrong = (z.argmax(1) != y) & (z.argmax(1) < len(FAMILIES) - 1) & (p.max(1) >= 0.5)
    return {"grams": vocabulary, "weights": w[:-1] / heat, "base": w[-1] / heat, "temperature": float(heat), "held_out_accuracy": right, "new_accuracy": float(np.mean(z.argmax(1) == y)), "new_wrong": float(np.mean(wrong))}


def scan(docs: DataFrame, model: dict | None = None, sure: float = 0.5, like: float = 0.6) -> DataFrame:
    """One row per distinct (doc_id, paragraph text) of ``docs(doc_id, text, ...)`` that tells of a licence.

    Paragraphs are lines, and also blocks of lines between blank ones, so that wrapped notices are whole. Scored is what
    holds a stem or a 2-gram that only one family's templates have (``signs``). As none is confirmed without such a 2-gram,
    this loses nothing confirmed; without a stem only confirmed rows are returned.
    Returns doc_id, paragraph, family, probability, unknown_probability, similarity, confirmed.
    family is ``unknown`` where no family reaches ``sure``; confirmed where it holds a 2-gram of that family alone and the
    similarity (shared n-grams by those of the shorter of the two) to a template of it is at least ``like``. Null and empty texts have no paragraphs; a repeated row or line gives no further row; an empty
    table gives none. Equal paragraphs are classified once, however many documents share them.
    """
    model = model or train()
    spark, k = docs.sparkSession, len(FAMILIES)
    hit = lambda c: F.lower(c).rlike(signs())
    stem = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).rlike("|".join(STEMS))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    blocks = F.filter(F.split("text", r"(?:\r\n?|\n)[\t ]*(?:\r\n?|\n)\s*"), lambda b: b.rlike(r"[^\r\n][\r\n]+[^\r\n]"))
    lines = common.stored(
        docs.where(hit("text")).select("doc_id", F.explode(F.array_distinct(F.concat(F.split("text", r"[\r\n]+"), blocks))).alias("paragraph"))
        .where(hit("paragraph")).distinct(), "license-lines")
    unlike = lines.select("paragraph").distinct().withColumn("w", words_column(F.col("paragraph")))
    unlike = common.stored(unlike, "license-words").withColumn("stem", stem)  # else every use of the words makes them again
    grams = F.array_distinct(F.array_compact(F.concat("w", pairs)))
    known_grams = F.array_intersect(grams, F.array(*[F.lit(g) for g in model["grams"]]))
    rows = unlike.select("paragraph", "stem", F.size(grams).alias("n"), F.explode_outer(known_grams).alias("gram"))
    templates, sole = [(f, grams_of(t)) for f in FAMILIES[:-1] for t in TEMPLATES[f]], specific()
    table = spark.createDataFrame(
        [(g, [float(v) for v in model["weights"][i]], [int(g in s) for _, s in templates], sole.get(g)) for i, g in enumerate(model["grams"])], "gram string, weight array<double>, within array<int>, sole int")
    joined = rows.join(F.broadcast(table), "gram", "left")  # the n-grams of the templates: a fixed number
    summed = joined.groupBy("paragraph", "stem").agg(
        F.max("n").alias("n"), F.count("weight").alias("hits"),
        F.array(*[F.coalesce(F.sum(F.element_at("weight", j + 1)), F.lit(0.0)) for j in range(k)]).alias("z"),
        F.collect_set("sole").alias("soles"),
        F.array(*[F.coalesce(F.sum(F.element_at("within", j + 1)), F.lit(0)) for j in range(len(templates))]).alias("shared"),
    )
    base = F.array(*[F.lit(float(b)) for b in model["base"]])
    logits = F.transform(F.zip_with("z", base, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda v: v["a"] / F.sqrt(F.greatest("hits", F.lit(1))) + v["b"])
    scored = summed.withColumn("logit", logits)
    scored = scored.withColumn("top", F.array_max("logit")).withColumn("e", F.transform("logit", lambda v: F.exp(v - F.col("top"))))
    scored = scored.withColumn("p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    best = F.array_max(F.arrays_zip(F.slice("p", 1, k - 1).alias("p"), F.slice(names, 1, k - 1).alias("f")))
    scored = scored.withColumn("best", best).withColumn("unknown_probability", F.element_at("p", k))
    sims = F.array(*[F.struct(F.lit(f).alias("f"), (F.element_at("shared", j + 1) / F.least(F.col("n"), F.lit(len(s)))).alias("s")) for j, (f, s) in enumerate(templates)])
    near = F.array_max(F.transform(F.filter(sims, lambda v: v["f"] == F.col("best")["f"]), lambda v: v["s"]))
    known = F.col("best")["p"] >= sure
    own = F.array_contains("soles", F.array_position(names, F.col("best")["f"]).cast("int") - 1)
    out = scored.select(
        "paragraph", "stem", F.when(known, F.col("best")["f"]).otherwise("unknown").alias("family"), F.col("best")["p"].alias("probability"), "unknown_probability",
        near.alias("similarity"), (known & own & (near >= like)).alias("confirmed")).where("stem OR confirmed")
    return lines.join(out, "paragraph").select("doc_id", "paragraph", "family", "probability", "unknown_probability", "similarity", "confirmed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its confirmed family (the most probable one), else unknown or none."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_paragraphs"), F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"),
        F.max(F.struct("confirmed", "probability", "family", "similarity")).alias("best"))
    ids = docs.select("doc_id").withColumnRenamed("doc_id", "__id")
    return ids.join(found, F.col("__id").eqNullSafe(F.col("doc_id")), "left").select(
        F.col("__id").alias("doc_id"),
        F.when(F.col("best").isNull(), "none").when(F.col("best.confirmed"), F.col("best.family")).otherwise("unknown").alias("license"),
        F.coalesce(F.round("best.probability", 6), F.lit(0.0)).alias("probability"), F.coalesce(F.round("best.similarity", 6), F.lit(0.0)).alias("similarity"),
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"))
