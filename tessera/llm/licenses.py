"""License scans: a trained paragraph classifier over sparse word n-grams, confirmed by template comparison.

Fit (driver, once a process, from the fixed notices below): word 1- to 3-grams with at least one content word, multinomial
logistic regression over the families and an unknown class, whose examples are sentences that share words with licences.
The unknown class is calibrated: its intercept is raised until half of the margin between the notices and the best unknown
sentence, left out in turn by folds, lies on either side. British and American spellings of a license are one.

Scan (DataFrame functions only): a paragraph is a line, or a span of up to ``WRAP`` neighbouring lines that holds half of a
notice's 3-grams, those over line ends too (reported as first-last, in place of its lines' own predictions). A line with no
content word of the vocabulary, or with a single one whose gains can't reach the intercepts' lead, is unknown by arithmetic;
the others' n-grams meet the weights (a broadcast table as large as the fixed notices), are summed per paragraph, and the
softmax gives a family and its probability. A predicted family is confirmed where at least half of the word 3-grams of one
of its notices, in whole or in one of its sentences, are in the paragraph, and no word contradicts it: one that sets its kin
apart and is in none of its notices (``NoDerivatives`` contradicts CC-BY).

Scale: one pass over the texts keeps candidate lines only; n-grams are made of those. Shuffles carry sums per paragraph, keyed
by row and line, so neither a hot document nor a hot line gathers in one task.

Cases: null text counts as empty. Null and repeated doc_ids are rows of their own. Documents without a licence have empty
results. Paragraphs of any length are read whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table, text_of

#: Fixed public notices by family.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
        "Available under the Apache License 2.0, see the file for details.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This software is licensed under the terms of the MIT license.",
        "The MIT License applies.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "Licensed under the GNU GPL v3.",
        "Distributed under the GPL version 3 or any later version.",
        "GNU GPL version 3 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "Licensed under the GNU GPL v2.",
        "Distributed under the GPL version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "Distributed under the GNU AGPL version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
        "Dedicated to the public domain under CC0.",
        "Released under the Creative Commons Zero license.",
        "CC0 1.0 Universal Public Domain Dedication",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "CC-BY-ND": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
        "Creative Commons Attribution-NoDerivs License",
        "Attribution-NoDerivatives 4.0 International (CC BY-ND 4.0)",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "CC-BY-NC-SA": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ),
    "CC-BY-NC-ND": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Released under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ),
    "EUPL-1.2": (
        "Licensed under the EUPL, Version 1.2 or later.",
        "Licensed under the European Union Public License.",
        "SPDX-License-Identifier: EUPL-1.2",
    ),
    "Artistic-2.0": (
        "Licensed under the Artistic License 2.0.",
        "SPDX-License-Identifier: Artistic-2.0",
    ),
    "ODbL-1.0": (
        "This database is made available under the Open Database License.",
        "Any rights in individual contents of the database are licensed under the Database Contents License.",
        "SPDX-License-Identifier: ODbL-1.0",
    ),
    "OFL-1.1": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ),
    "CDDL-1.0": (
        "The contents of this file are subject to the terms of the Common Development and Distribution License.",
        "SPDX-License-Identifier: CDDL-1.0",
    ),
    "Proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ),
}
#: Fixed full names of the families, notices too.
NAMES = {
    "Apache-2.0": "Apache License 2.0", "MIT": "The MIT License", "GPL-3.0": "GNU General Public License v3.0", "GPL-2.0": "GNU General Public License v2.0", "LGPL": "GNU Lesser General Public License v2.1",
    "AGPL-3.0": "GNU Affero General Public License v3.0", "BSD": "BSD 3-Clause \"New\" or \"Revised\" License", "MPL-2.0": "Mozilla Public License 2.0", "CC-BY": "Creative Commons Attribution 4.0 International",
    "CC-BY-SA": "Creative Commons Attribution Share Alike 4.0 International", "CC-BY-NC": "Creative Commons Attribution Non Commercial 4.0 International", "CC-BY-ND": "Creative Commons Attribution No Derivatives 4.0 International",
    "CC-BY-NC-SA": "Creative Commons Attribution Non Commercial Share Alike 4.0 International", "CC-BY-NC-ND": "Creative Commons Attribution Non Commercial No Derivatives 4.0 International",
    "CC0": "Creative Commons Zero v1.0 Universal", "ISC": "The ISC License", "BSL-1.0": "Boost Software License 1.0", "EPL-2.0": "Eclipse Public License 2.0", "Zlib": "The zlib License",
    "EUPL-1.2": "European Union Public License 1.2", "Artistic-2.0": "Artistic License 2.0", "ODbL-1.0": "Open Data Commons Open Database License v1.0", "OFL-1.1": "SIL Open Font License 1.1",
    "CDDL-1.0": "Common Development and Distribution License 1.0",
}
NOTICES = {f: (*ns, *([NAMES[f]] if f in NAMES else [])) for f, ns in NOTICES.items()}
#: Fixed sentences of no licence that share its words.
UNKNOWN = (
    "A driving license must be renewed each year.", "The fishing license was granted to the local club.", "He lost his pilot license last spring.",
    "Poetic license is free for any person.", "The restaurant sells wine under a license from the city.", "The general public was free to visit the work.",
    "Version 2.0 of the software ships in the spring.", "Version 3 of the work was printed in the city.", "This software is slow and the documentation is poor.",
    "You may not use this door.", "The foundation published the terms of the agreement.", "The law required a copy of the agreement in writing.",
    "Apache is a word for a people of the south west.", "Students at MIT built the program.", "The gnu is a large animal.", "The commons is open to the public.",
    "Attribution of the painting is not certain.", "The source of the river is in the hills.", "The library is open to any person free of charge.",
    "Copies of the book are in the library.", "The conditions of the road are poor.", "The author of the work is not known.", "Mozilla has an office in the city.",
    "A license plate was found along the road.", "The program was released in the spring.", "The permission of the owner was not required.",
    "Please read the file in the public folder.", "The form and the source code are in the notice.", "Redistribution of land was the subject of the law.",
    "His driving licence was taken away after the third accident.", "A licence fee is paid by every household.", "The pilot's licence is valid for two years.", "The board revoked the restaurant's licence.",
    "Public records are available at the library.", "The eclipse was seen in the north.", "The font was cut by hand in the city.", "The database was lost in a fire.", "European law is taught at the university.",
    "Her work is artistic and free of ornament.", "No event was held in the hall.", "The software was distributed on discs.", "The boost in sales came late.", "Commercial fishing is banned in the bay.",
    "The general was licensed to carry a weapon.", "The lesser of the two evils was chosen.", "All persons are free to copy the recipe.", "The terms of the treaty were met.", "The version of the story is not confirmed.",
    "Permission to land was denied.", "The patent was granted in all states.", "Open source news is read in the morning.", "The licence office is closed on Monday.", "A copyright dispute was settled out of court.",
    "The notice was copied and included in the file.", "Distribution of the software started in version 2.", "The work was licensed to a publisher.",
)
#: Fixed words that alone make no feature.
PLAIN = frozenset("a an and any are as at be by can either for from has have if in is it later may no not of on only or other see should that the this to under was with without work you your http www org".split())
#: Fixed words that set kin families apart, and the families.
KIN = (
    (("nc", "noncommercial", "nd", "noderivatives", "noderivs", "sa", "sharealike"), ("CC-BY", "CC-BY-SA", "CC-BY-NC", "CC-BY-ND", "CC-BY-NC-SA", "CC-BY-NC-ND", "CC0")),
    (("lesser", "lgpl", "affero", "agpl"), ("GPL-3.0", "GPL-2.0", "LGPL", "AGPL-3.0")),
)
#: A word; a full stop before a digit is part of it.
TOKEN = r"[a-z0-9]+(?:\.[0-9][a-z0-9]*)*"
NGRAMS = (1, 2, 3)
#: Where the unknown class's lead lies between the notices' least margin (0) and the best unknown sentence's (1).
CAUTION = 0.5
#: Lines that a wrapped notice's matched words may span.
WRAP = 12


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower().replace("licenc", "licens"))


def ngrams(words: list[str], sizes: tuple[int, ...] = NGRAMS) -> list[str]:
    return [" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)]


def _grams(text: str) -> list[str]:
    return sorted({g for g in ngrams(tokens(text)) if not PLAIN.issuperset(g.split())})


def _fit(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 2e-3, steps: int = 300, rate: float = 2.0) -> np.ndarray:
    """Multinomial logistic weights by accelerated gradient steps; the last row holds the intercepts."""
    x = np.c_[x, np.ones(len(x))]
    once = np.eye(k)[y] / np.bincount(y, minlength=k)[y][:, None] / k  # classes weigh alike
    w = old = np.zeros((x.shape[1], k))
    for i in range(steps):
        at = w + i / (i + 3) * (w - old)
        s = x @ at
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        old, w = w, at - rate * (x.T @ (p * once.sum(1, keepdims=True) - once) + ridge * np.r_[at[:-1], np.zeros((1, k))])
    return w


@functools.cache
def model() -> tuple[list[str], list[str], np.ndarray]:
    """Families (unknown last), n-grams and weights, the last row the calibrated intercepts."""
    families = [*NOTICES, "unknown"]
    texts = [(t, families.index(f)) for f, ts in NOTICES.items() for t in ts] + [(t, len(NOTICES)) for t in UNKNOWN]
    texts += [("", len(NOTICES))]
    vocabulary = sorted({g for t, y in texts if y < len(NOTICES) for g in _grams(t)})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)))
    for i, (t, _) in enumerate(texts):
        x[i, [place[g] for g in _grams(t) if g in place]] = 1
    y, k, n = np.array([y for _, y in texts]), len(families), len(texts)
    gap = np.zeros(n)
    folds = np.arange(n) % 8
    for f in range(8):
        w = _fit(x[folds != f], y[folds != f], k)
        s = np.c_[x[folds == f], np.ones((folds == f).sum())] @ w
        gap[folds == f] = s[:, :-1].max(1) - s[:, -1]
    w = _fit(x, y, k)
    s = np.c_[x, np.ones(n)] @ w
    known = (s[:, :-1].max(1) - s[:, -1])[y < k - 1]
    w[-1, -1] += max(0.0, CAUTION * gap[y == k - 1].max() + (1 - CAUTION) * known.min())
    return families, vocabulary, w


def strong_words() -> tuple[list[str], list[str]]:
    """Content words, and those that could make a family with no other content word beside them.

    A line of one content word has at most the n-grams whose only content word it is; where even all of their gains over
    unknown stay under the intercepts' lead, the word alone is never enough.
    """
    _, vocabulary, w = model()
    alone: dict[str, np.ndarray] = {}
    for g, row in zip(vocabulary, w, strict=False):
        words = {*g.split()} - PLAIN
        if len(words) == 1:
            gain = np.maximum(row[:-1] - row[-1], 0)
            alone[min(words)] = alone.get(min(words), 0) + gain
    content = sorted({t for g in vocabulary for t in g.split()} - PLAIN)
    return content, sorted(t for t, gain in alone.items() if (gain + w[-1, :-1]).max() >= w[-1, -1])


def templates(confirm: float = 0.5) -> list[tuple[str, int, list[str]]]:
    """(family, number of 3-grams, 3-grams) of each notice and each of its sentences of three words or more.

    Left out are those that several families have, and those of which one content word alone could bring ``confirm``.
    """
    found: dict[tuple, set] = {}
    for family, notices in NOTICES.items():
        for t in {p for n in notices for p in (n, *re.split(r"(?<=[.;:])\s+", n))}:
            own = [{*g.split()} - PLAIN for g in {*ngrams(tokens(t), (3,))}]
            if own and all(sum(o <= {w} for o in own) < confirm * len(own) for w in set().union(*own) | {""}):
                found.setdefault(tuple(sorted({*ngrams(tokens(t), (3,))})), set()).add(family)
    return sorted((min(families), len(grams), [*grams]) for grams, families in found.items() if len(families) == 1)


def contradictions() -> dict[str, list[str]]:
    """For a family the words of its kin that none of its notices has."""
    own = {f: {t for n in ns for t in tokens(n)} for f, ns in NOTICES.items()}
    return {f: [w for w in words if w not in own[f]] for words, families in KIN for f in families}


def scan_paragraphs(docs: DataFrame, confirm: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (rid, doc_id), and a row per paragraph of a predicted family: rid, line, family, probability, likeness, confirmed."""
    spark = docs.sparkSession
    families, vocabulary, w = model()
    k = len(families)
    content, strong = strong_words()
    words = lambda c: f"regexp_extract_all(replace(lower({c}), 'licenc', 'licens'), r'{TOKEN}', 0)"
    listed, sole, plain = (", ".join(repr(t) for t in [*ts, ""]) for ts in (content, strong, sorted(PLAIN)))
    told = f"array_distinct(filter(words, t -> t IN ({listed})))"
    every = f"transform(transform(split(text, '\n'), (l, i) -> named_struct('line', i, 'words', {words('l')})), x -> named_struct('line', x.line, 'words', x.words, 'told', array_distinct(filter(x.words, t -> t IN ({listed})))))"
    lines = f"transform(filter(every, x -> size(x.told) > 1 OR size(x.told) = 1 AND x.told[0] IN ({sole})), x -> named_struct('line', x.line, 'words', x.words))"
    parts = f"transform(filter(every, x -> size(x.told) > 0 OR size(x.words) > 0 AND forall(x.words, t -> t IN ({plain}))), x -> named_struct('line', x.line, 'words', x.words))"
    kept = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), text_of(text_col).alias("text"))
    # No family is predicted by one word, or by a strong one alone, and no notice found by one: other documents are done after one pass.
    kept = kept.select("doc_id", "rid", "text", F.expr(words("text")).alias("words")).select("doc_id", "rid", F.expr(f"CASE WHEN size({told}) >= {1 if strong else 2} THEN text END").alias("text"))
    kept = kept.select("doc_id", "rid", F.expr(f"CASE WHEN text IS NOT NULL THEN {every} END").alias("every")).select("doc_id", "rid", F.expr(lines).alias("lines"), F.expr(parts).alias("parts"))
    kept = materialise(kept, "licence-lines")
    line = kept.select("rid", F.explode("lines").alias("x")).select("rid", "x.line", "x.words")
    each = ", ".join(f"transform(sequence(1, size(words) - {n - 1}), i -> array_join(slice(words, i, {n}), ' '))" if n > 1 else "words" for n in NGRAMS)
    both = "array_distinct(concat(" + ", ".join(f"if(size(words) >= {n}, {e}, array())" for n, e in zip(NGRAMS, re.split(r", (?=transform\(seq)", each), strict=True)) + "))"
    grams_of = lambda df: df.select("rid", "line", *("family" for c in df.columns if c == "family"), F.explode(F.expr(both)).alias("gram"))
    grams = grams_of(line)
    shown = [(g, [float(v) for v in w[i]]) for i, g in enumerate(vocabulary) if np.abs(w[i]).max() > 1e-6]
    weights = spark.createDataFrame(shown, "gram string, w array<double>")  # as long as the fixed notices
    most = lambda scores: F.greatest(*scores)

    def classified(grams: DataFrame) -> DataFrame:
        sums = grams.join(F.broadcast(weights), "gram").groupBy("rid", "line").agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)))
        scores = [F.col(f"s{i}") + float(w[-1, i]) for i in range(k)]
        total = functools.reduce(lambda a, b: a + b, (F.exp(s - most(scores)) for s in scores))
        family = F.element_at(F.array(*(F.lit(f) for f in families)), F.array_position(F.array(*scores), most(scores)).cast("int"))
        return sums.select("rid", "line", family.alias("family"), F.round(1 / total, 6).alias("probability")).where("family <> 'unknown'")

    predicted = classified(grams)
    # Template comparison: shares of a notice's 3-grams.
    known = [(f, i, n, g) for i, (f, n, gs) in enumerate(templates(confirm)) for g in gs]
    notes = spark.createDataFrame(known, "family string, notice int, n int, gram string")
    shared = grams_of(line.join(predicted.select("rid", "line", "family"), ["rid", "line"])).join(F.broadcast(notes), ["family", "gram"])
    likeness = shared.groupBy("rid", "line", "notice", "n").agg(F.count("*").alias("c")).groupBy("rid", "line").agg(F.max(F.col("c") / F.col("n")).alias("likeness"))
    hits = predicted.join(likeness, ["rid", "line"], "left").withColumn("likeness", F.round(F.coalesce("likeness", F.lit(0.0)), 6))
    pairs = ", ".join(f"'{f}', array({', '.join(repr(w) for w in ws)})" for f, ws in contradictions().items())
    contradicted = F.expr(f"coalesce(arrays_overlap(words, try_element_at(map({pairs}), family)), false)")
    hits = hits.join(line, ["rid", "line"]).withColumn("confirmed", (F.col("likeness") >= confirm) & ~contradicted).drop("words").withColumn("last", F.col("line"))
    # Wrapped notices: template 3-grams over neighbouring lines, in windows of WRAP lines; few rows are left by the first join.
    ended = "if(i + 1 < size(parts) AND parts[i + 1].line = x.line + 1, x.words, concat(x.words, array('|')))"  # nothing runs on over a gap
    told = kept.where("size(parts) > 1").select("rid", F.expr(f"flatten(transform(parts, (x, i) -> transform({ended}, w -> named_struct('line', x.line, 'word', w))))").alias("t"))
    runs = told.where("size(t) > 2").select("rid", F.explode(F.expr("transform(sequence(0, size(t) - 3), i -> named_struct('a', t[i].line, 'b', t[i + 2].line, 'gram', concat_ws(' ', t[i].word, t[i + 1].word, t[i + 2].word)))")).alias("x"))
    found = runs.select("rid", "x.*").join(F.broadcast(notes), "gram")
    at = found.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("b") - (WRAP - 1)), F.col("a"))).alias("from"))
    spans = at.groupBy("rid", "family", "notice", "n", "from").agg(F.count_distinct("gram").alias("c"), F.min("a").alias("first"), F.max("b").alias("last"))
    spans = spans.withColumn("likeness", F.round(F.col("c") / F.col("n"), 6)).where(F.col("likeness") >= confirm).where("last > first")
    best = spans.groupBy("rid", "family", "first").agg(F.max_by(F.struct("last", "likeness"), F.struct("likeness", -F.col("last"))).alias("x")).select("rid", "family", "first", "x.*")
    alone = hits.where("confirmed").select(F.col("rid").alias("r2"), F.col("family").alias("f2"), F.col("line").alias("l2"))
    inside = lambda lo, hi: (F.col("rid") == F.col("r2")) & (F.col("family") == F.col("f2")) & F.col("l2").between(lo, hi)
    best = best.join(alone, inside(F.col("first"), F.col("last")), "left_anti")
    better = best.select(F.col("rid").alias("r2"), F.col("family").alias("f2"), F.struct(-F.col("likeness"), F.col("last") - F.col("first"), F.col("first")).alias("rank"), F.col("first").alias("a2"), F.col("last").alias("b2"))
    order = F.struct(-F.col("likeness"), F.col("last") - F.col("first"), F.col("first"))
    same = (F.col("rid") == F.col("r2")) & (F.col("family") == F.col("f2")) & (F.col("a2") <= F.col("last")) & (F.col("b2") >= F.col("first")) & (F.col("rank") < order)
    best = materialise(best.join(better, same, "left_anti").withColumn("line", F.monotonically_increasing_id()), "licence-spans")
    body = best.join(told, "rid").select("rid", "line", F.expr("transform(filter(t, x -> x.line BETWEEN first AND last), x -> x.word)").alias("words"))
    right = body.join(best.select("rid", "line", "family"), ["rid", "line"]).where(~contradicted).select("rid", "line")
    sure = best.join(classified(grams_of(body)), ["rid", "line", "family"]).join(right, ["rid", "line"]).select("rid", F.col("first").alias("line"), "family", "probability", "likeness", F.lit(True).alias("confirmed"), "last")
    part = sure.select(F.col("rid").alias("r2"), F.col("family").alias("f2"), F.col("line").alias("a2"), F.col("last").alias("b2"))
    hits = hits.join(part, (F.col("rid") == F.col("r2")) & (F.col("family") == F.col("f2")) & F.col("line").between(F.col("a2"), F.col("b2")), "left_anti")
    return kept.select("rid", "doc_id"), hits.unionByName(sure)


def scan_licenses(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, families (confirmed, distinct, sorted), paragraphs (line:family of each), n_confirmed, n_unconfirmed."""
    rows, hits = scan_paragraphs(docs, **options)
    sure = F.col("confirmed")
    at = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(sure, F.struct("line", "family", "last")))), lambda x: F.concat(x["line"].cast("string"), F.when(x["last"] > x["line"], F.concat(F.lit("-"), x["last"].cast("string"))).otherwise(""), F.lit(":"), x["family"])), ",")
    per = hits.groupBy("rid").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"), at.alias("paragraphs"), F.count_if(sure).alias("n_confirmed"), F.count_if(~sure).alias("n_unconfirmed")
    )  # lines of one document
    blank = {"families": "", "paragraphs": "", "n_confirmed": 0, "n_unconfirmed": 0}
    return rows.join(per, "rid", "left").select("doc_id", *blank).fillna(blank)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
