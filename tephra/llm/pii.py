"""Personal data by candidate gradient boosting.

Generators with high recall propose spans, which may overlap; boosted trees score
them by format and context; thresholds calibrated on held-out rows choose which
to redact. Spans of the four base kinds are exact and always stay; of the
others, the best-scored of those that overlap is taken, and none that overlaps
a base span.

There are no span labels, so training rows come from the base spans of all
distinct texts: they are the positives, rewritten into the looser formats that the
generators propose (national phone numbers, spelled-out addresses), and the same
spans damaged so that they are no personal data any more (dates, decimals, amounts,
failed check digits) are the negatives, all in their own contexts. Their features
are small whole numbers, so rows that are equal are one row with their count, which
Spark's GBTClassifier takes as its weight; a task applies the trees to the candidates
of its documents.

Defined results: null text counts as empty; texts are read whole, by patterns
that need time in proportion to the length, and candidates meet the taken spans in a
sorted list; offsets are code points; of overlapping candidates with equal scores the
first by start, then by end, is taken; a table without any base span has only base
spans; repeated rows each get a row; an empty table gives an empty result; other columns,
of whatever names, are ignored, or kept by redact.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import cut_tidy, sampled

PRECISION = 0.99
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "number", "account")
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())]))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.])[(+]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}(?![0-9A-Za-z])")
_AT = re.compile(r"\x20?(?:[(\[{]at[)\]}]|\x20at\x20)\x20?", re.I | re.A)
_SPELLED = re.compile(r"[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[{]dot[)\]}]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,63})+", re.I | re.A)
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_CUE = re.compile(r"mail|contact|phone|tel|call|fax|mobile|card|visa|iban|account|ssn|write|reach", re.I)
#: What a text with a base span has at least.
POSSIBLE = r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]|[0-9]([\x20-]?[0-9]){15}"
_DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}")


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain; a local part is looked up backwards from its @."""
    out, at, done = [], t.find("@"), 0
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = t.find("@", max(at + 1, done))
    return out


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """The four base kinds, in this order, each by start."""
    out = [("email", a, z) for a, z in emails(t)]
    out += [("ip", *m.span()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() < 40 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in _PHONE.finditer(t) if 8 <= sum(map(str.isdigit, m[0])) <= 15]


def candidates(t: str) -> list[tuple[str, int, int]]:
    """What the generators propose beside the base kinds."""
    out = [("number", *m.span()) for m in _NUMBER.finditer(t)] + [("account", *m.span()) for m in _ACCOUNT.finditer(t)]
    for m in _AT.finditer(t):
        start = m.start()
        while start > 0 and m.start() - start < 64 and t[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (d := _SPELLED.match(t, m.end())):
            out.append(("address", start, d.end()))
    return out


def features(t: str, kind: str, a: int, z: int) -> list[float]:
    s, before, after = t[a:z], t[max(0, a - 40) : a], t[z : z + 12]
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    return [
        float(KINDS.index(kind)), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(set(re.findall(r"[^0-9A-Za-z]", s))),
        "+" in s, "(" in s, s.count("."), s.count("-"), s.count(" "), "/" in s, z - a, sum(c.isalpha() for c in s), len(digits) > 11 and luhn(digits),
        len(groups) == 4 and all(len(g) < 4 and int(g) <= 255 for g in groups), bool(_CUE.search(before)), before[-1:].isalnum(), after[:1].isalnum(), before[-2:].strip()[-1:] in set("$€£#%:v"),
        bool(_DATE.fullmatch(s)), [len(g) for g in groups][-3:] == [3, 3, 4], "dot" in s.lower() or "." in s,
    ]


def training_rows(t: str, rng: random.Random) -> list[tuple[str, float, list[float]]]:
    """(generator, label, features) made from the base spans of one text, in their contexts."""
    out = []

    def put(kind: str, label: int, a: int, z: int, s: str) -> None:
        text = t[max(0, a - 60) : a] + s + t[z : z + 20]
        start = min(a, 60)
        out.append((kind, float(label), [float(x) for x in features(text, kind, start, start + len(s))]))

    for kind, a, z in base_spans(t):
        s = t[a:z]
        d = re.sub("[^0-9]", "", s)
        if kind == "email":
            local, domain = s.split("@", 1)
            put("address", 1, a, z, f"{local} [at] {domain.replace('.', ' [dot] ')}")
            put("address", 1, a, z, f"{local} (at) {domain}")
            put("address", 1, a, z, f"{local} at {domain.replace('.', ' dot ')}")
            put("address", 0, a, z, f"{local} at {rng.choice(['home', 'noon', 'the'])}.{rng.choice(['The', 'It', 'We'])}")
            put("account", 1, a, z, f"{rng.choice(['DE', 'GB', 'FR', 'ES'])}{rng.randrange(10, 99)}{rng.randrange(10**15, 10**16)}")
            put("account", 0, a, z, "".join(rng.choices("ABCDEFGHJKLM", k=2)) + "20" + "".join(rng.choices("ABCDEFGHJKLM", k=12)))
        if kind == "phone" and len(d) >= 10:
            n = d[-10:]
            for form in (f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]} {n[3:6]} {n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}"):
                put("number", 1, a, z, form)
        if kind == "card":
            put("number", 0, a, z, d[:-1] + str((int(d[-1]) + 1 + rng.randrange(8)) % 10))
            put("number", 0, a, z, d[:8])
        if kind in ("card", "ip", "phone"):
            y, m = 1950 + int(d[:2]), 1 + int(d[2:4]) % 12
            for form in (f"{y}-{m:02d}-{1 + int(d[4:6]) % 28:02d}", f"{1 + int(d[4:6]) % 28:02d}/{m:02d}/{y}", f"{d[:3]}.{d[3:9]}", f"{d[:1]}.{d[1:2]}.{d[2:4]}.{d[4:6]}.{d[6:8]}", d[:7], f"{y}-{y + 1}", f"{d[:3]}.{d[3:6]}.{300 + rng.randrange(700)}.1"):
                put("number", 0, a, z, form)
    return out


@dataclass
class Model:
    """Boosted trees as flat arrays, and the score from which a generator's span is taken."""

    trees: list[tuple[float, list[tuple[int, float, int, int, float]]]]
    thresholds: dict[str, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for weight, nodes in self.trees:
            feature, split, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
            at = np.zeros(len(x), dtype=int)
            for _ in range(8):  # deeper than any tree
                f = feature[at]
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= split[at], left[at], right[at])
                at = np.where(f < 0, at, down)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def flat(tree) -> list[tuple[int, float, int, int, float]]:  # noqa: ANN001
    """(feature or -1, threshold, left, right, value) per node of a fitted tree."""
    nodes: list = []

    def add(node) -> int:  # noqa: ANN001
        at = len(nodes)
        nodes.append(None)
        if node.subtreeDepth() == 0:
            nodes[at] = (-1, 0.0, 0, 0, node.prediction())
        else:
            nodes[at] = (node.split().featureIndex(), node.split().threshold(), add(node.leftChild()), add(node.rightChild()), 0.0)
        return at

    add(tree._call_java("rootNode"))
    return nodes


def fit(docs: DataFrame, sample: int | None = None) -> Model:
    """Train on all distinct texts with a possible base span, or on `sample` of them, chosen by a hash; copies count once."""
    possible = F.col("text").rlike(POSSIBLE)
    chosen = docs.select("text", F.xxhash64("text").alias("h")).filter(possible) if sample is None else sampled(docs, sample, possible)

    def rows(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            found = []
            for t, h in zip(pdf["text"], pdf["h"], strict=True):
                equal = Counter((g, y, tuple(map(int, f))) for g, y, f in training_rows(t, random.Random(int(h))))
                found += [(h, *row, n) for row, n in equal.items()]
            yield pd.DataFrame(found, columns=["h", "generator", "label", "f", "n"])

    each = chosen.mapInPandas(rows, "h long, generator string, label double, f array<int>, n long").distinct().withColumn("held", F.pmod("h", F.lit(10)) < 3)
    equal = each.groupBy("generator", "label", "f", "held").agg(F.sum("n").alias("n")).sortWithinPartitions("generator", "label", "f", "held")
    made = cut_tidy(equal, "pii").withColumn("x", array_to_vector(F.col("f").cast("array<double>")))
    if made.select("label", "held").distinct().count() < 4:
        return Model([], {})
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="n", maxIter=15, maxDepth=4, seed=1).fit(made.filter("not held"))
    scored = model.transform(made.filter("held")).select("generator", "label", "n", F.floor(vector_to_array("probability")[1] * 100).alias("bin"))
    bins = scored.groupBy("generator", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()  # 101 bins for each generator
    line = {}
    for g in {b.generator for b in bins}:
        n = good = 0.0
        for b in sorted((b for b in bins if b.generator == g), key=lambda b: -b.bin):
            n, good = n + b.n, good + b.good
            if good >= PRECISION * n:
                line[g] = b.bin / 100
    return Model([(w, flat(t)) for w, t in zip(model.treeWeights, model.trees, strict=True)], line)


class Taken:
    """Disjoint intervals in order."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, z in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(z, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(z)

    def add(self, a: int, z: int) -> bool:
        """Take a span unless it overlaps a taken one."""
        i = bisect_left(self.starts, z)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, z)
        return True


def all_spans(t: str, model: Model) -> list[tuple[str, int, int, float]]:
    base = base_spans(t)
    out = [(*b, 1.0) for b in base]
    if model.trees and (c := candidates(t)):
        p = model.scores(np.array([features(t, *x) for x in c], dtype=float))
        taken = Taken([(a, z) for _, a, z in base])
        for s, (kind, a, z) in sorted(((float(s), x) for s, x in zip(p, c, strict=True) if s >= model.thresholds.get(x[0], math.inf)), key=lambda y: (-y[0], y[1][1:])):
            if taken.add(a, z):
                out.append((kind, a, z, s))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def spans(model: Model):  # noqa: ANN201
    @pandas_udf(SPANS)
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in all_spans(t or "", model)] for t in text])

    return of


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id and its spans (kind, start, end, score)."""
    return docs.select("doc_id", spans(model or fit(docs))("text").alias("spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with each chosen span replaced by its kind in brackets; n_chars follows."""
    model = model or fit(docs)

    @pandas_udf(StringType())
    def without(text: pd.Series) -> pd.Series:
        def of(t: str | None) -> str | None:
            found, end, out = sorted(all_spans(t or "", model), key=lambda s: (s[1], -s[2])), 0, []
            for kind, a, z, _ in found:
                if a >= end:
                    out += [t[end:a], f"[{kind.upper()}]"]
                end = max(end, z)
            return t if not found else "".join(out) + t[end:]

        return pd.Series([of(t) for t in text])

    text = without("text")
    return docs.withColumns({"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}))
