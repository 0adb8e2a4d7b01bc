"""License scans: a trained classifier of paragraphs, confirmed by comparison with templates.

A paragraph is a block of lines between blank lines. Its units are its lines, windows of up to ``WINDOW``
lines joined by a space, and its sentences across lines; one without a cue (``CUES``) is of the unknown
class by definition. Cues are so chosen that no unit that a template confirms is without one. Units are
classified by multinomial logistic regression on the presence of word unigrams and bigrams. The model is
trained on the driver on ``VARIANTS`` variants of each of the ``TEMPLATES``; the unknown class learns from
sentences that use the same words otherwise and from notices of licences that are none of the families.
Variants left out, and notices of still other licences, which the model has never seen, set the
temperature (by likelihood) and the least probability of a known family (so that at most ``FALSE`` of
those notices reach it). A prediction is confirmed if the paragraph holds
at least ``CONFIRM`` of the word pairs of one template of that family, and no larger share of another
family's. Windows and sentences count only if confirmed, single lines also if not. Texts are only touched by
DataFrame operations; weights and templates, fixed tables of a few thousand rows, are broadcast.

Defined results: a null or empty text has no paragraph; a text, or a paragraph, that occurs many times
is classified once and each row gets the result; a family is listed once for each text, and as unconfirmed
only if a paragraph has it that doesn't confirm it; a line that names two licences in one sentence gets one class; a text of any length is
read whole; of classes with equal probability the first is taken; null ids keep their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

CONFIRM = 0.8
VARIANTS = 24
EPOCHS = 40
BATCH = 32
RATE = 0.5
DECAY = 1e-4
FALSE = 0.1
SEED = 5
UNKNOWN = "unknown"
WINDOW = 4
#: Characters on either side of a line's end that a notice across it can have; over twice the longest template.
NEAR = 400
CUES = (
    r"(?i)licen[sc]|copyright|\(c\)|©|permission|redistribut|warrant|public\s+domain|rights\s+reserved|spdx|creative\s+commons|gpl|\bcc0|\bcc[ -]by"
    r"|hereby[^a-z0-9]+granted|associated[^a-z0-9]+documentation|documentation[^a-z0-9]+files|binary[^a-z0-9]+forms|without[^a-z0-9]+modification|following[^a-z0-9]+conditions|permitted[^a-z0-9]+provided"
    r"|\bgnu\b|free[^a-z0-9]+software|general[^a-z0-9]+public|mozilla|waived|unencumbered|dedicated[^a-z0-9]+to|prior[^a-z0-9]+written"
)
#: Of each cue, lower-cased, what a text must hold to have it; looked for first, as plain search is far cheaper than CUES.
HOLD = "licen,copyright,(c),©,permission,redistribut,warrant,domain,reserved,spdx,commons,gpl,cc0,cc-by,cc by,hereby,documentation,forms,modification,conditions,permitted,gnu,software,general,mozilla,waived,unencumbered,dedicated,prior".split(",")
WORDS = r"[a-z0-9]+(?:[.+'-][a-z0-9]+)*"

#: Fixed wording of the licences' own notices.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL v2.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "This work is dedicated to the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without prior written permission.",
    ),
}
#: The same words in other senses.
OTHERS = (
    "He lost his driving license last year and had to renew the licence at the town office.",
    "The restaurant holds a liquor license and a permission to serve guests outside.",
    "Students need the permission of their parents to join the trip.",
    "The car came with a warranty of two years, which the dealer would not honour.",
    "Copyright law and the history of licences were discussed at the conference.",
    "Police had a warrant to search the house of the suspect.",
    "The committee will redistribute the funds among the members of the public.",
    "A fishing license is required under the terms of the state law.",
    "The software was released last week and the work received attention.",
    "Version 2.0 of the library will be released in spring, version 3 later.",
    "The public library is free and open to any person in the general area.",
    "The domain of the function is public knowledge in the field of analysis.",
    "Point (c) of the second paragraph was rejected by the foundation.",
    "The licensed doctor works under the public health service.",
    "A licensing office issued the licence to the company without permission.",
)
#: Notices of other licences: the unknown class learns from the first of each pair of lists, and is calibrated on the second.
OTHER_NOTICES = (
    (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Distributed under the Boost Software License, Version 1.0.",
        "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Use of this software is governed by the Business Source License included in the LICENSE file.",
        "SPDX-License-Identifier: EPL-2.0",
        "SPDX-License-Identifier: Zlib",
        "SPDX-License-Identifier: BSL-1.0",
        "SPDX-License-Identifier: OFL-1.1",
        "Released under the Eclipse license.",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Licensed under the EUPL, Version 1.2 or subsequent versions of the EUPL.",
        "The contents of this file are subject to the terms of the Common Development and Distribution License.",
        "This database is made available under the Open Database License.",
        "This program is free software: you can use it under the terms of the Server Side Public License, version 1, as published by its owner.",
        "This source is subject to the Microsoft Public License.",
        "SPDX-License-Identifier: ISC",
        "SPDX-License-Identifier: CDDL-1.0",
        "SPDX-License-Identifier: EUPL-1.2",
        "This work is made available under the Mulan Permissive Software License, Version 2.",
        "You may use this code under the terms of the Q Public License.",
        "Released under the terms of the zlib license.",
    ),
)
FILLER = "the of and a to in that it was for on are with as at be this have from or by not but what all were when we there can an your which their if will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def grams(text: str) -> set[str]:
    words = re.findall(WORDS, text.lower())
    return {*words, *map(" ".join, zip(words, words[1:]))}


def pairs(text: str) -> set[str]:
    words = re.findall(WORDS, text.lower())
    return set(map(" ".join, zip(words, words[1:])))


def _variants(text: str, rng: random.Random) -> list[str]:
    """The text itself, and with words lost, and among other words."""
    out = [text]
    for k in range(1, VARIANTS):
        words = [w for w in text.split() if k % 3 or rng.random() > 0.1]
        around = lambda: [rng.choice(FILLER) if rng.random() < 0.5 else "".join(rng.choices("abdeghilmnorstuz", k=rng.randint(2, 9))) for _ in range(rng.randint(0, 25))]
        out.append(" ".join([*around(), *words, *around()]) if k % 2 else " ".join(words))
    return out


class Model:
    """Weights by gram, one for each class; temperature; least probability of a known family."""

    def __init__(self) -> None:
        rng, order = random.Random(SEED), np.random.default_rng(SEED)
        self.classes = [*TEMPLATES, UNKNOWN]
        last = len(self.classes) - 1
        learn, held, strange = [], [], []
        for k, name in enumerate(self.classes):
            for text in TEMPLATES.get(name, (*OTHERS, *OTHER_NOTICES[0])):
                for n, v in enumerate(_variants(text, rng)):
                    (held if n % 6 == 5 else learn).append((grams(v), k))
        for text in OTHER_NOTICES[1]:
            strange += [(grams(v), last) for v in _variants(text, rng)]
        count = Counter(g for x, _ in learn for g in x)
        self.at = {g: i for i, g in enumerate(sorted(g for g, n in count.items() if n > 2))}
        x, y = self._matrix(learn), np.eye(len(self.classes))[[k for _, k in learn]]
        self.values, self.bias = np.zeros((len(self.at), len(self.classes))), np.zeros(len(self.classes))
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch / 8)
            for at in np.array_split(order.permutation(len(x)), len(x) // BATCH):
                off = (_softmax(x[at] @ self.values + self.bias) - y[at]) * rate
                self.values -= x[at].T @ off / len(at) * 8 + rate * DECAY * self.values
                self.bias -= off.mean(0)
        logits, right = self._matrix(held + strange) @ self.values + self.bias, np.array([k for _, k in held + strange])
        loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(right)), right], 1e-12)).mean()
        self.temperature = min((t / 10 for t in range(3, 101)), key=loss)
        known = _softmax(logits / self.temperature)[len(held) :, :last].max(1)
        self.least = float(min(0.99, max(0.5, np.quantile(known, 1 - FALSE))))
        self.weights = {g: self.values[i].tolist() for g, i in self.at.items()}
        self.bias = self.bias.tolist()

    def _matrix(self, rows: list[tuple[set[str], int]]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.at)))
        for i, (x, _) in enumerate(rows):
            out[i, [self.at[g] for g in x if g in self.at]] = 1
        return out

    def probabilities(self, x: set[str]) -> list[float]:
        """Of each class, for a unit with these grams."""
        return _softmax((self._matrix([(x, 0)]) @ self.values + self.bias) / self.temperature)[0].tolist()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(1)
def model() -> Model:
    return Model()


def _grams(words: Column) -> tuple[Column, Column]:
    two = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return words, F.array_distinct(two)


def classify(units: DataFrame) -> DataFrame:
    """(key, family, probability, confirmed) of the distinct units (key, par) that are of a known family; only keys are shuffled."""
    spark, m = units.sparkSession, model()
    values = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))  # noqa: E731  fixed tables
    weights = values([(g, *w) for g, w in m.weights.items()], "gram string, " + ", ".join(f"w{k} double" for k in range(len(m.classes))))
    templates = [(k, n, t) for k, name in enumerate(TEMPLATES) for n, t in enumerate(TEMPLATES[name])]
    known = values([(g, k, n, len(pairs(t))) for k, n, t in templates for g in sorted(pairs(t))], "gram string, class int, template int, size int")
    words = F.regexp_extract_all(F.lower("par"), F.lit(WORDS), 0)
    rows = units.select("key", words.alias("words"))
    one, two = _grams(F.col("words"))
    present = rows.select("key", F.explode(F.array_distinct(F.concat(one, two))).alias("gram"))
    sums = present.join(weights, "gram").groupBy("key").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(len(m.classes))])
    z = [(F.col(f"w{k}") + m.bias[k]) / m.temperature for k in range(len(m.classes))]
    top = F.greatest(*z)
    total = sum((F.exp(v - top) for v in z[1:]), F.exp(z[0] - top))
    first = F.coalesce(*[F.when(v == top, F.lit(k)) for k, v in enumerate(z)])
    sums = sums.select("key", first.alias("class"), (1 / total).alias("probability"))
    sums = sums.where((F.col("class") < len(TEMPLATES)) & (F.col("probability") >= m.least))
    held = rows.select("key", F.explode(two).alias("gram")).join(known, "gram").groupBy("key", "class", "template").agg((F.count("*") / F.max("size")).alias("share"))
    held = held.groupBy("key", "class").agg(F.max("share").alias("share"))
    best = held.groupBy("key").agg(F.max("share").alias("best"))
    names = F.array(*[F.lit(name) for name in TEMPLATES])
    joined = sums.join(held, ["key", "class"], "left").join(best, "key", "left")
    return joined.select("key", F.element_at(names, F.col("class") + 1).alias("family"), "probability", F.coalesce((F.col("share") >= CONFIRM) & (F.col("share") >= F.col("best")), F.lit(False)).alias("confirmed"))


def _cued(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, [low.contains(part) for part in HOLD]) & text.rlike(CUES)


def _units(block: Column) -> Column:
    """The units of a paragraph that have a cue: (par, joined), joined for what isn't a line of its own."""
    lines = lambda b: F.transform(F.split(b, "\n", -1), lambda p: F.trim(p))
    unit = lambda joined: lambda p: F.struct(p.alias("par"), F.lit(joined).alias("joined"))

    def of(ls: Column) -> Column:
        # Lines i to i + n - 1 for each n; too few lines give none, nor does a longer one between others. Of the outer ones only what is near the border counts.
        def window(n: int, i: Column) -> Column:
            inner = F.slice(ls, i + 1, F.lit(n - 2)) if n > 2 else F.array().cast("array<string>")
            parts = F.concat(F.array(F.right(F.get(ls, i - 1), F.lit(NEAR))), inner, F.array(F.left(F.get(ls, i + n - 2), F.lit(NEAR))))
            return F.when(~F.exists(inner, lambda p: F.length(p) > NEAR), F.array_join(parts, " "))

        def of_size(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(ls) - (n - 1), F.lit(1)))
            found = F.filter(F.transform(starts, lambda i: window(n, i)), lambda p: p.isNotNull())
            return F.when(F.size(ls) >= n, found).otherwise(F.array().cast("array<string>"))

        windows = [of_size(n) for n in range(2, WINDOW + 1)]
        sentences = F.split(F.array_join(ls, " "), r"(?<=[.!?])\s+", -1)
        joined = F.array_except(F.concat(*windows, sentences), ls)
        cued = lambda a: F.filter(a, lambda p: p.rlike(CUES))
        return F.concat(F.transform(cued(ls), unit(False)), F.transform(cued(joined), unit(True)))

    return F.element_at(F.transform(F.array(lines(block)), of), 1)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_cued (lines with a cue), n_licensed (lines of a family, and families that only joined lines show), families (confirmed, joined by commas), unconfirmed, probability (of the surest)."""
    text = F.coalesce("text", F.lit(""))
    blocks = F.filter(F.split(text, r"\n[ \t\r]*\n", -1), lambda b: b.rlike(CUES))
    # The only pass over the texts; of a text without a cue nothing but the id is left.
    rows = docs.select("doc_id", F.when(_cued(text), F.struct(F.sha2(text.cast("binary"), 256).alias("blob"), blocks.alias("blocks"))).alias("cued"))
    rows = materialize(rows.select("doc_id", "cued.blob", "cued.blocks"))
    texts = rows.where("blob IS NOT NULL").dropDuplicates(["blob"]).select("blob", F.posexplode("blocks").alias("block", "lines"))
    units = texts.select("blob", "block", F.explode(_units(F.col("lines"))).alias("unit"))
    units = materialize(units.select("blob", "block", "unit.joined", F.unhex(F.sha2(F.col("unit.par").cast("binary"), 256)).alias("key"), "unit.par"))
    found = classify(units.select("key", "par").dropDuplicates(["key"]))
    rated = units.drop("par").join(found, "key", "left").where("not joined or confirmed")
    line = ~F.col("joined")
    families = lambda which: F.collect_set(F.when(which, F.col("family")))
    by_block = rated.groupBy("blob", "block").agg(
        F.count_if(line).alias("n_cued"), F.count_if(line & F.col("family").isNotNull()).alias("n_lines"), families(line).alias("of_lines"),
        families(F.col("confirmed")).alias("yes"), families(~F.col("confirmed")).alias("no"), F.max("probability").alias("probability"),
    )
    names = lambda c: F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))), ",")
    by_text = by_block.groupBy("blob").agg(
        F.sum("n_cued").alias("n_cued"), F.sum(F.col("n_lines") + F.size(F.array_except("yes", "of_lines"))).alias("n_licensed"),
        names(F.col("yes")).alias("families"), names(F.array_except("no", "yes")).alias("unconfirmed"), F.max("probability").alias("probability"),
    )
    of_cued = rows.where("blob IS NOT NULL").drop("blocks").join(by_text, "blob", "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    absent = {c: F.lit(None).cast(of_cued.schema[c].dataType) for c in of_cued.columns if c != "doc_id"}
    out = of_cued.unionByName(rows.where("blob IS NULL").select("doc_id").withColumns(absent))
    return out.select("doc_id", F.coalesce("n_cued", zero).alias("n_cued"), F.coalesce("n_licensed", zero).alias("n_licensed"), F.coalesce("families", none).alias("families"), F.coalesce("unconfirmed", none).alias("unconfirmed"), "probability")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
