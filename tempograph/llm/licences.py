"""License scans: a trained paragraph classifier, scoring with DataFrame functions only.

Training, on the driver, from the fixed notices below (a few dozen short paragraphs, no corpus data): multinomial
logistic regression over the words, word pairs and word triples of a paragraph, one class for each licence family
and one for `unknown`, whose examples mention licences without granting one.  Copies of the notices with words left
out stand for variants; every third copy is held out and gives the temperature that calibrates the probabilities.

Scoring: a paragraph is a line, or a run of lines over which a notice is wrapped.  Which texts are scored follows from
the notices' own word pairs: a notice can only be confirmed where one of its `telling_pairs` is, over line ends too.
Paragraphs are cut into their distinct n-grams, these meet the sparse weights by a broadcast join (the weights have a
row for each n-gram of the notices, a number that doesn't depend on the data), and sums per paragraph give calibrated
probabilities.  The best family stands if it has at least MIN_PROBABILITY; otherwise the paragraph is `unknown`.
Template comparison then confirms: at least MIN_TEMPLATE of the word pairs of one of the family's notices are in the
paragraph.  Rows are: each line with one of the ANCHORS, confirmed or not; each other line that is confirmed; of runs,
those confirmed for a family of which no line of the run has a notice, the shortest with the largest share.  A run ends at a line without
words, and the lines between its first and last have fewer words than the longest notice; of the first and last line
as many words count, those next to the line end.

Nulls: null and empty texts have no paragraphs.  Rows are told apart by a number that each gets before its candidates are written,
so equal rows and null ids give their own results each.  Ties between families go to the earlier of NOTICES, between runs to
the earlier and shorter.  Empty tables give empty results; other columns are ignored, whatever their names.  Very long
paragraphs are read whole.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

MIN_PROBABILITY, MIN_TEMPLATE, MAX_N = 0.6, 0.7, 3
UNKNOWN = "unknown"
#: Notices of each family, longer paragraphs of full licence texts by the sentence.
NOTICES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at", "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "GNU General Public License v2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
        "either version 2 of the License, or (at your option) any later version",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "GNU General Public License v3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
        "either version 3 of the License, or (at your option) any later version",
    ],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": [
        "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer",
        "may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at", "SPDX-License-Identifier: MPL-2.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License", "Licensed under the Eclipse Public License, Version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright to the public domain.", "This work is in the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved.", "Copyright the authors. All rights reserved.", "No part of this publication may be reproduced without prior written permission."],
}
#: Paragraphs that mention licences or rights without granting any.
OTHERS = [
    "He showed his driving licence to the officer.", "The licence fee goes up next year.", "A fishing license costs more in spring.", "The software license market grew last year.", "License plates are made in this town.",
    "The city reserved all seats.", "Apache helicopters flew over the valley.", "The MIT campus is in Cambridge.", "Copyright law protects authors.", "The public domain is a matter of debate.", "She has a licence to teach.",
    "The general public was not admitted.", "Creative work is common here.", "The version of the story was licensed to a studio.", "Released under a new title.", "Licensed under the Foo License.", "This work is licensed under terms to be agreed.", "Attribution of the painting is not certain.",
]
#: one of these is in every lower-case text with an anchor
ANCHORED = ("licen", "copyright", "rights reserved", "public domain", "permission", "redistribution", "cc0", "cc by", "creative commons")
ANCHORS = r"(?i)licen[cs]|copyright|rights reserved|public domain|permission|redistribution|\bcc0\b|\bcc by|creative commons"
#: words that telling pairs avoid, as they are in most texts; the choice changes the work, not the result
COMMON = frozenset("a all any are as at be by can file for free has in is it law may modify no not obtain of only or part person provided software source subject terms that the this to under use version with without work you an on at have had was were been but which who will would should your he she we our their there these those one two more most other such than then into over after before up out made also when where what how so if do does did been being am me my him her us them some each every same own very just only".split())
TOKEN = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"


#: Names in statements without more, such as "Distributed under the GPL v3"
NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], "Apache-2.0": ["Apache License 2.0", "Apache 2.0"], "GPL-2.0": ["GPL v2", "GPLv2", "GPL 2.0", "GNU GPL v2", "GNU GPLv2", "GPL version 2"],
    "GPL-3.0": ["GPL v3", "GPLv3", "GPL 3.0", "GNU GPL v3", "GNU GPLv3", "GPL version 3"], "LGPL": ["LGPL", "GNU LGPL"],
    "AGPL-3.0": ["AGPL v3", "AGPLv3", "AGPL 3.0", "GNU AGPL v3", "GNU AGPLv3"], "BSD": ["BSD License", "BSD 3 Clause", "BSD 2 Clause"], "MPL-2.0": ["MPL 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["EPL 2.0", "Eclipse Public License 2.0"], "BSL-1.0": ["Boost Software License 1.0"],
}
NOTICES = {k: [*v, *(f"under {the}{n}" for n in NAMES.get(k, []) for the in ("", "the "))] for k, v in NOTICES.items()}


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())


def grams(words: list[str], sizes=range(1, MAX_N + 1)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


@lru_cache(maxsize=1)
def model(rounds: int = 400, copies: int = 6, seed: int = 7) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """Classes, weights of each n-gram by class, and the classes' constants, divided by the calibrating temperature."""
    rng = random.Random(seed)
    classes = [*NOTICES, UNKNOWN]
    fit, held = [], []
    for k, texts in enumerate([*NOTICES.values(), OTHERS]):
        for text in texts:
            words = tokens(text)
            fit.append((words, k))
            for c in range(copies):
                less = [w for w in words if rng.random() > 0.15] or words
                noise = [f"filler{rng.randrange(50)}" for _ in range(rng.randrange(6))]
                (held if c % 3 == 2 else fit).append((less + noise, k))
    fit += [([f"filler{rng.randrange(50)}" for _ in range(12)], len(classes) - 1) for _ in range(30)]
    names = sorted(set().union(*(grams(w) for w, _ in fit if w)))
    index = {g: i for i, g in enumerate(names)}

    def matrix(rows: list) -> np.ndarray:
        x = np.zeros((len(rows), len(names)))
        for r, (w, _) in enumerate(rows):
            for g in grams(w):
                if g in index:
                    x[r, index[g]] = 1
        return x

    x, y = matrix(fit), np.eye(len(classes))[[k for _, k in fit]]
    w, b, step, decay = np.zeros((len(names), len(classes))), np.zeros(len(classes)), 0.5, 1e-3
    share = y.sum(0)
    each = (y / share).sum(1, keepdims=True) / len(classes)  # classes count alike
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        e = (p - y) * each
        w -= step * (x.T @ e + decay * w)
        b -= step * e.sum(0)
    z, k = matrix(held) @ w + b, [k for _, k in held]

    def loss(t: float) -> float:
        s = z / t
        s -= s.max(1, keepdims=True)
        return -np.mean((s - np.log(np.exp(s).sum(1, keepdims=True)))[range(len(k)), k])

    t = min((0.25 * 1.1**i for i in range(40)), key=loss)
    keep = [(g, w[i] / t) for g, i in index.items() if not g.startswith("filler") and np.abs(w[i]).max() > 1e-4]
    return classes, {g: [float(v) for v in row] for g, row in keep}, [float(v / t) for v in b]


def judged_by_model(words: list[str]) -> tuple[str, float]:
    """Best class and its probability of a paragraph's words, as the DataFrame does it."""
    classes, weights, constants = model()
    z = np.array(constants) + sum((np.array(weights[g]) for g in grams(words) if g in weights), np.zeros(len(classes)))
    p = np.exp(z - z.max())
    return classes[int(z.argmax())], float(p.max() / p.sum())


def confusion(seed: int = 99, copies: int = 20) -> dict[tuple[str, str], int]:
    """(family, what is found, `unknown` under MIN_PROBABILITY) and how often, for new variants of the notices: words left out, others put in."""
    rng, found = random.Random(seed), {}
    for family, texts in [*NOTICES.items(), (UNKNOWN, OTHERS)]:
        for text in texts:
            for _ in range(copies):
                words = [w for w in tokens(text) if rng.random() > 0.1] or tokens(text)
                for _ in range(rng.randrange(4)):
                    words.insert(rng.choice((0, len(words))), f"other{rng.randrange(99)}")
                best, p = judged_by_model(words)
                got = best if p >= MIN_PROBABILITY else UNKNOWN
                found[family, got] = found.get((family, got), 0) + 1
    return found


def templates() -> list[tuple[str, int, str, int]]:
    """(family, notice, word pair, word pairs of the notice) of every notice."""
    out = []
    for family, texts in NOTICES.items():
        for k, text in enumerate(texts):
            pairs = grams(tokens(text), [2])
            out += [(family, k, g, len(pairs)) for g in sorted(pairs)]
    return out


def n_grams(words: Column) -> Column:
    part = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.array_distinct(F.concat(*[F.when(F.size(words) >= n, part(n)).otherwise(F.array().cast("array<string>")) for n in range(1, MAX_N + 1)]))


def telling_pairs(min_template: float) -> list[str]:
    """Word pairs of which a text has at least one if it has a share of min_template of any notice's pairs."""
    notices, out = [tokens(t) for texts in NOTICES.values() for t in texts], set()
    for words in notices:
        pairs = grams(words, [2])
        missing = len(pairs) - max(1, math.ceil(round(min_template * len(pairs), 6)))
        out |= set(sorted(pairs, key=lambda g: (sum(w in COMMON for w in g.split()), -len(g), g))[: missing + 1])
    return sorted(out)


def any_of(strings: list[str]) -> str:
    """A pattern of all strings, letter by letter as a tree, so that few alternatives are tried at each place; one that begins with another is left out."""
    tree: dict = {}
    for x in sorted(strings):
        node = tree
        for c in x:
            if None in node:
                break
            node = node.setdefault(c, {})
        node.clear()
        node[None] = None

    def pattern(node: dict) -> str:
        if None in node:
            return ""
        parts = [(GAP if c == " " else re.escape(c)) + pattern(child) for c, child in node.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return pattern(tree)


GAP = r"[^\p{L}\p{N}]+"


def telling(min_template: float) -> str:
    """A pattern for lower-case texts that have a telling pair (and some others, as words may go on)."""
    return r"(?<![a-z0-9])" + any_of(telling_pairs(min_template))


def reach() -> int:
    """Words of the longest notice."""
    return max(len(tokens(t)) for texts in NOTICES.values() for t in texts)


def runs(words: Column, pattern: str) -> Column:
    """(first line, last line, words) of the runs of two lines or more with a telling pair; words: an array for each line."""
    longest = reach()
    line = lambda k: F.get(words, k)

    def of(k: Column, m: Column) -> Column:
        head, last = line(k), line(k + m)
        head = F.slice(head, F.greatest(F.lit(1), F.size(head) - (longest - 1)), F.lit(longest))
        return F.struct(k.alias("paragraph"), (k + m).alias("last"), F.concat(head, F.flatten(F.slice(words, k + 2, m - 1)), F.slice(last, 1, longest)).alias("_w"))

    def ends(k: Column, m: Column) -> Column:
        inner = F.slice(words, k + 2, m - 1)
        return (F.size(line(k + m)) > 0) & F.forall(inner, lambda w: F.size(w) > 0) & (F.aggregate(inner, F.lit(0), lambda a, w: a + F.size(w)) < longest)

    def starting(k: Column) -> Column:
        after = F.least(F.lit(longest), F.size(words) - 1 - k)
        steps = F.when((after > 0) & (F.size(line(k)) > 0), F.sequence(F.lit(1), after)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(F.filter(steps, lambda m: ends(k, m)), lambda m: of(k, m)), lambda r: F.array_join(r["_w"], " ").rlike(pattern))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), starting))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_template: float = MIN_TEMPLATE) -> DataFrame:
    """id, paragraph (number of its first line from 0), last (line), start (code points before it), text, _w (its words): lines with an anchor or a
    telling pair, and runs of lines with a telling pair."""
    pattern = telling(min_template)
    text, cut = F.col(text_col), lambda t: F.regexp_extract_all(F.lower(t), F.lit(f"({TOKEN})"))
    tells = F.lower(text).rlike(pattern)
    low = F.lower(text)
    anchored = reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in ANCHORED])  # a plain search is ten times as fast as a pattern
    df = docs.where(anchored | tells).select(F.col(id_col).alias("id"), text.alias("_t"), F.monotonically_increasing_id().alias("row_key"), tells.alias("_tells"))
    lines = F.split("_t", "\n")
    single = F.filter(F.transform(lines, lambda t, k: F.struct(k.alias("paragraph"), k.alias("last"), F.when(t.rlike(ANCHORS) | F.lower(t).rlike(pattern), cut(t)).alias("_w"))), lambda r: r["_w"].isNotNull())
    several = F.when(F.col("_tells"), runs(F.col("_words"), pattern)).otherwise(F.filter(single, lambda r: F.lit(False)))
    df = df.withColumn("_words", F.when(F.col("_tells"), F.transform(lines, cut)))
    df = df.select("id", "row_key", "_t", F.inline(F.concat(single, several)))
    own = F.slice(lines, F.col("paragraph") + 1, F.col("last") - F.col("paragraph") + 1)
    ahead = F.aggregate(F.slice(lines, F.lit(1), F.col("paragraph")), F.lit(0).cast("long"), lambda a, x: a + F.length(x) + 1)
    return df.select("id", "row_key", "paragraph", "last", ahead.alias("start"), F.array_join(own, "\n").alias("text"), "_w")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_probability: float = MIN_PROBABILITY, min_template: float = MIN_TEMPLATE) -> DataFrame:
    """A row per candidate paragraph: id, paragraph, start, text, family, probability, template_share, confirmed."""
    spark = docs.sparkSession
    classes, weights, constants = model()
    table_ = F.broadcast(spark.createDataFrame([(g, *row) for g, row in weights.items()], "gram string, " + ", ".join(f"w{i} double" for i in range(len(classes)))))
    notice = F.broadcast(spark.createDataFrame(templates(), "t_family string, notice int, gram string, pairs int"))
    paragraphs = stored(candidates(docs, id_col, text_col, min_template), "licence_paragraphs")
    key = ["id", "row_key", "paragraph", "last"]
    cut = paragraphs.select(*key, "start", "text", F.explode_outer(n_grams(F.col("_w"))).alias("gram"))
    sums = cut.join(table_, "gram", "left").groupBy(*key).agg(F.first("start").alias("start"), F.first("text").alias("text"), *[F.round(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)) + F.lit(c), 9).alias(f"z{i}") for i, c in enumerate(constants)])
    top = F.greatest(*[F.col(f"z{i}") for i in range(len(classes))])
    total = sum((F.exp(F.col(f"z{i}") - top) for i in range(len(classes))), F.lit(0.0))
    best = F.coalesce(*[F.when(F.col(f"z{i}") == top, F.lit(c)) for i, c in enumerate(classes)])
    judged = sums.select(*key, "start", "text", best.alias("best"), F.round(1 / total, 6).alias("probability"))
    shares = cut.join(notice, "gram").groupBy(*key, "t_family", "notice").agg((F.count("*") / F.first("pairs")).alias("_s")).groupBy(*key, "t_family").agg(F.round(F.max("_s"), 6).alias("template_share"))
    before = W.partitionBy("id", "row_key", "t_family").orderBy("last", F.desc("paragraph")).rowsBetween(W.unboundedPreceding, -1)
    alone = (F.col("paragraph") == F.col("last")) & (F.col("template_share") >= min_template)
    shares = shares.withColumn("_line", F.coalesce(F.max(F.when(alone, F.col("paragraph"))).over(before) >= F.col("paragraph"), F.lit(False)))
    shares = shares.toDF(*[f"_{k}" for k in key], "t_family", "template_share", "_line")
    on = [judged[k].eqNullSafe(shares[f"_{k}"]) for k in key] + [judged["best"] == shares["t_family"]]
    out = judged.join(shares, on, "left").withColumn("template_share", F.coalesce("template_share", F.lit(0.0)))
    known = (F.col("best") != UNKNOWN) & (F.col("probability") >= min_probability)
    out = out.withColumn("family", F.when(known, F.col("best")).otherwise(UNKNOWN))
    out = out.withColumn("confirmed", known & (F.col("template_share") >= min_template))
    single = F.col("paragraph") == F.col("last")
    columns = ["id", "paragraph", "start", "text", "family", "probability", "template_share", "confirmed"]
    out = out.where(F.when(single, F.col("confirmed") | F.col("text").rlike(ANCHORS)).otherwise(F.col("confirmed") & ~F.col("_line")))
    return best_runs(out.withColumn("_run", ~single)).select(*columns)


def best_runs(found: DataFrame) -> DataFrame:
    """found without the runs that have a part of no lower share, and then without those that are part of one with a higher."""
    near = W.partitionBy("id", "row_key", "family", "_run").orderBy("paragraph").rangeBetween(-reach(), reach())  # a run has reach() + 1 lines at most
    own = F.struct("paragraph", "last", "template_share")
    for drops in (
        lambda o, r: (o["paragraph"] >= r["paragraph"]) & (o["last"] <= r["last"]) & (o["last"] - o["paragraph"] < r["last"] - r["paragraph"]) & (o["template_share"] >= r["template_share"]),
        lambda o, r: (o["paragraph"] <= r["paragraph"]) & (o["last"] >= r["last"]) & (o["template_share"] > r["template_share"]),
    ):
        others = F.collect_list(F.when(F.col("_run"), own)).over(near)
        found = found.withColumn("_near", others).withColumn("_own", own).where(~F.exists("_near", lambda o: drops(o, F.col("_own"))))
    return found


def op7_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
