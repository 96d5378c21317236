"""Licence scan by a trained paragraph classifier.

A paragraph is a line with a word; lines in a row that are found to be of one kind, as those of
a wrapped notice, are one span. Sparse word 1- to 3-grams of the licence
notices below feed a multinomial logistic regression (Spark ML, mostly L1, so
few weights remain), trained on cut and reworded versions of the notices, on short
lines cut from them and on a bounded sample of corpus paragraphs (from SAMPLE / 2 distinct texts) as the class
`none`, those that would be scored included unless they may be a notice.
Comparison with the notices confirms a family: the paragraph must share a stretch of 3-grams with
a notice, and that must be enough of the paragraph's 3-grams or of the notice's. Three or more words
in a row may be left out in it, but not one or two, which may name the licence, and no word that the
notice does not have may be put in.

A paragraph whose best family stays under a calibrated probability, or is not confirmed,
counts as `unknown`. The probability comes from FOLDS further fits. Each leaves out whole
families, which stand for licences that no template names (the GNU licences, whose notices
have sentences in common, go together), and one whole notice of every other
family that has several. Over what was left out, families given at or above the threshold
and confirmed are right in 99 of 100 cases; naming a family that the fit has not seen is an error.

A paragraph speaks of a licence if it has three words in a row of a notice, as the
lines of a wrapped notice have, or a word of CUES. Those paragraphs are scored. Any
other shares no 3-gram with a notice, so it could not be confirmed. Defined results: null text has no paragraphs;
texts are read whole, in time in proportion to their length; offsets are code points; of equally likely
families the first in FAMILIES counts; repeated rows each get a row; an
empty table gives an empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import cut, sampled
from .pii import SPANS

SAMPLE = 2000  # corpus paragraphs for the class `none`, and half as many of those that would be scored
VARIANTS = 40
SHARED = 0.6
PRECISION = 0.99
FOLDS = 2
CUES = re.compile(r"licen[sc]e|copyright|creative commons|warrant(?:y|ies)|public domain|redistribut|\bcc[- ]?(?:by|0)|\b(?:a|l)?gpl\b|lizenz|licencia|all rights reserved", re.I | re.A)

#: Customary short notices by licence family.
NOTICES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "This project is available under the terms of the MIT license."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GPL version 2 or later."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the LGPL version 3."],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL version 3 or later."],
    "bsd": ["Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "public-domain": ["This work has been dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0."],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher."],
}
FAMILIES = [*NOTICES, "none"]
KIN = {"lgpl": "gpl", "agpl": "gpl"}  # families that are left out together with another


def grams(text: str) -> set[str]:
    w = re.findall(r"[a-z0-9]+", text.lower())
    return {" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}


def vocabulary() -> dict[str, int]:
    return {g: i for i, g in enumerate(sorted(set().union(*(grams(t) for ts in NOTICES.values() for t in ts))))}


def variants(seed: int = 5) -> list[tuple[str, str, int]]:
    """(family, text, number of its notice): notices with words dropped or cut at the ends, behind names and years."""
    rng, out = random.Random(seed), []
    for family, texts in NOTICES.items():
        for k, t in enumerate(texts):
            out.append((family, t, k))
            for _ in range(VARIANTS):
                w = t.split()
                if len(w) > 12:
                    a = rng.randrange(0, len(w) // 3)
                    w = w[a : a + rng.randrange(max(8, len(w) // 2), len(w) + 1)]
                elif rng.random() < 0.3:
                    w.pop(0)
                lead = rng.choice(["", "", "Copyright (c) 2019 Someone. ", "Note: ", "// ", "* "])
                out.append((family, lead + " ".join(w), k))
    return out


def wrapped(seed: int = 6) -> list[tuple[str, str, int]]:
    """(family, text, number of its notice): lines of long notices, as wrapping or quoting leaves them."""
    rng, out = random.Random(seed), []
    for family, texts in NOTICES.items():
        for k, w in ((k, t.split()) for k, t in enumerate(texts) if len(t.split()) > 12):
            for _ in range(VARIANTS):
                n = rng.randint(5, 16)
                a = rng.randrange(max(1, len(w) - n + 1))
                out.append((family, " ".join(w[a : a + n]), k))
    return out


def left_out(fold: int, family: str, notice: int) -> bool:
    """Whether a fold's fit goes without the rows of a notice: a half of the families, and one
    notice of every other family that has several."""
    i = FAMILIES.index(KIN.get(family, family))
    return i % FOLDS == fold or len(NOTICES[family]) > 1 and notice == (fold + i) % len(NOTICES[family])


@dataclass
class Model:
    weights: np.ndarray  # families x vocabulary, mostly zero
    bias: np.ndarray
    threshold: float

    def predict(self, index: list[int]) -> tuple[str, float]:
        z = self.weights[:, index].sum(axis=1) + self.bias
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return FAMILIES[k], float(p[k] / p.sum())


def paragraphs(t: str) -> list[tuple[int, int]]:
    out, a = [], 0
    for line in t.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            out.append((a, a + len(line)))
        a += len(line) + 1
    return out


def trained(made: DataFrame, vocab: dict[str, int]) -> Model:
    lr = LogisticRegression(featuresCol="x", labelCol="label", weightCol="n", family="multinomial", elasticNetParam=0.9, regParam=0.0005, maxIter=25).fit(made)
    weights, bias = np.zeros((len(FAMILIES), len(vocab))), np.full(len(FAMILIES), -50.0)
    k = lr.coefficientMatrix.numRows
    weights[:k], bias[:k] = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    return Model(weights, bias, 0.0)


def calibrated(judged: list[tuple[float, bool]]) -> float:
    """The lowest probability from which on PRECISION of the judged are right; 1 if there is none."""
    good, line = 0, 1.0
    judged = sorted(judged, reverse=True)
    for n, (p, ok) in enumerate(judged, 1):
        good += ok
        if good >= PRECISION * n and (n == len(judged) or judged[n][0] < p):
            line = p
    return line


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    spark, vocab = docs.sparkSession, vocabulary()

    @pandas_udf("array<struct<text: string, scored: boolean>>")
    def plain(text: pd.Series) -> pd.Series:
        return pd.Series([[{"text": x, "scored": speaks(x)} for a, z in paragraphs(t) if may_be_none(x := t[a:z])] for t in text])

    lines = cut(sampled(docs, sample // 2).select(F.inline(plain("text"))).distinct(), "lines")
    of = lambda which, n: lines.filter(which).select("text").orderBy(F.xxhash64("text"), "text").limit(n)
    ordinary = of("scored", sample // 2).union(of("not scored", sample))
    notices = variants() + wrapped()
    rows = spark.createDataFrame(notices, "family string, text string, notice int").union(ordinary.select(F.lit("none"), "text", F.lit(0)))

    @pandas_udf(ArrayType(IntegerType()))
    def known(text: pd.Series) -> pd.Series:
        return pd.Series([sorted(vocab[g] for g in grams(t) if g in vocab) for t in text])

    # MLlib wants vectors; a dense one of this vocabulary is a few kilobytes, and the rows are bounded
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(len(vocab) - 1)), lambda i: F.array_contains("index", i).cast("double"))
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
    alike = rows.select("family", "notice", label.alias("label"), known("text").alias("index")).groupBy("family", "notice", "label", "index").agg(F.count(F.lit(1)).cast("double").alias("n"))
    made = cut(alike.withColumn("x", array_to_vector(one_hot)).coalesce(1), "licences").cache()  # some thousand rows, read over and over
    indexes = [(f, k, t, [vocab[g] for g in grams(t) if g in vocab]) for f, t, k in notices]  # some thousand short texts
    judged = []
    for fold in range(FOLDS):
        gone = F.lit(False)
        for f, ts in NOTICES.items():
            for k in range(len(ts)):
                if left_out(fold, f, k):
                    gone = gone | ((F.col("family") == f) & (F.col("notice") == k))
        model = trained(made.filter(~gone), vocab)
        for f, k, t, index in indexes:
            if left_out(fold, f, k):
                family, p = model.predict(index)
                if family != "none" and confirmed(family, t):
                    judged.append((p, family == f))
    model = trained(made, vocab)
    model.threshold = calibrated(judged)
    made.unpersist()
    return model


def phrases(text: str) -> list[str]:
    """The runs of three words of a text in order, or the whole of a shorter one."""
    w = re.findall(r"[a-z0-9]+", text.lower())
    return [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]


_SHAPES = {f: [{x: i for i, x in enumerate(phrases(t))} for t in ts] for f, ts in NOTICES.items()}


def confirmed(family: str, p: str) -> bool:
    """Whether a stretch, in which no word is put in and no name left out, is shared with a notice of
    the family, enough of either."""
    three = phrases(p)
    for s in _SHAPES[family]:
        shared = [(i, s[x]) for i, x in enumerate(three) if x in s]
        whole = all(j - i == 1 or j - i == 3 and b - a >= 6 for (i, a), (j, b) in zip(shared, shared[1:], strict=False))
        if shared and whole and len(shared) >= SHARED * min(len(three), len(s)):
            return True
    return False


_PHRASES = {tuple(g.split()) for shapes in _SHAPES.values() for s in shapes for g in s}


def phrased(p: str) -> bool:
    """Whether three words in a row are those of a notice."""
    w = re.findall(r"[a-z0-9]+", p.lower())
    return not _PHRASES.isdisjoint(zip(w, w[1:], w[2:], strict=False))


def speaks(p: str) -> bool:
    return phrased(p) or bool(CUES.search(p))


def may_be_none(p: str) -> bool:
    """Whether a corpus paragraph may stand for the class `none`."""
    if not phrased(p):
        return True
    return not CUES.search(p) and not any(confirmed(f, p) for f in NOTICES)


def found(t: str, model: Model, vocab: dict[str, int]) -> list[dict]:
    out: list[dict] = []
    for a, z in paragraphs(t):
        if speaks(t[a:z]):
            g = grams(t[a:z])
            family, p = model.predict([vocab[x] for x in g if x in vocab])
            if family != "none":
                kind = family if p >= model.threshold and confirmed(family, t[a:z]) else "unknown"
                if out and out[-1]["kind"] == kind and out[-1]["end"] + 1 == a:  # the line before
                    out[-1].update(end=z, score=max(p, out[-1]["score"]))
                else:
                    out.append({"kind": kind, "start": a, "end": z, "score": p})
    return out


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, spans (family or unknown, start, end, probability)."""
    model = model or fit(docs)
    vocab = vocabulary()

    @pandas_udf(SPANS)
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([found(t or "", model, vocab) for t in text])

    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\s]"))).cast("long")
    return docs.select("doc_id", n.alias("n_paragraphs"), of("text").alias("spans"))
