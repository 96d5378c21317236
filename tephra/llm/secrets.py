"""Secrets by grammar inference.

Labelled credentials, from a bounded sample of the spans that base patterns
find, build a prefix tree over character classes. States whose continuations a
Hoeffding test cannot tell apart are merged (ALERGIA), which leaves a
probabilistic automaton of credential formats. Every candidate token is then
scored by its log-likelihood per character against a background model of
ordinary tokens, and a threshold calibrated on held-out tokens decides. Base
spans are exact and always stay.

A candidate is any run of six or more characters of which an assigned value may be
made, except a plain word: letters only, all of one case but for the first. Such a word
has the form of most of the text, and nothing in its form could tell that it is a secret.

The fit takes a bounded sample: at most SAMPLE distinct credentials from all texts, and
at most PLAIN distinct ordinary tokens from ORDINARY_TEXTS texts, both by hash.
Credentials of over LONGEST characters are left out of the automaton, which has one
state for a character; they are found all the same.

Defined results: null text counts as empty; texts are read whole, in time in proportion
to their length; offsets are code points; candidates do not overlap, so there are no ties; without labelled
credentials only base spans remain; repeated rows each get a row; an empty table gives
an empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from .common import cut, sampled
from .pii import SPANS, Taken

SAMPLE = 2000  # labelled credentials
PLAIN = 20_000  # ordinary tokens
ORDINARY_TEXTS = 4000  # texts that these come from
LONGEST = 256
ALPHA = 0.05
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "format")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile("(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = "[A-Za-z0-9+/_.=-]"
# a run that goes on behind its first plain word; it is looked at from its first character only
_TOKEN = re.compile(rf"(?<!{_RUN})(?:[A-Z]?[a-z]++|[A-Z]++)?+(?=[.=-]*+[A-Za-z0-9+/_]){_RUN}++")
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds by start, then kind as listed."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(t)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(t: str) -> list[tuple[int, int]]:
    """Runs of six or more characters of a value that are no plain words, without marks around them."""
    out = []
    for m in _TOKEN.finditer(t):
        x = m[0].rstrip(".-")
        z, x = m.start() + len(x), x.lstrip(".=-")
        if len(x) >= 6 and not _WORD.fullmatch(x):
            out.append((z - len(x), z))
    return out


def shape(s: str) -> str:
    """Character classes: digits d, a-f h, other lower case l, A-F H, other upper case U, marks as they are."""
    return "".join("d" if c.isdigit() else ("h" if c in "abcdef" else "l") if c.islower() else ("H" if c in "ABCDEF" else "U") if c.isupper() else c for c in s)


@dataclass
class State:
    n: int = 0
    ends: int = 0
    out: Counter = field(default_factory=Counter)
    to: dict[str, int] = field(default_factory=dict)


def prefix_tree(strings: list[str]) -> list[State]:
    states = [State()]
    for s in strings:
        at = 0
        states[at].n += 1
        for c in s:
            states[at].out[c] += 1
            if c not in states[at].to:
                states[at].to[c] = len(states)
                states.append(State())
            at = states[at].to[c]
            states[at].n += 1
        states[at].ends += 1
    return states


def differ(a: int, n: int, b: int, m: int, alpha: float) -> bool:
    return n > 0 and m > 0 and abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def compatible(states: list[State], a: int, b: int, alpha: float) -> bool:
    """Whether no test tells the languages of two states apart, as deep as both have data."""
    stack = [(a, b)]
    while stack:
        x, y = (states[i] for i in stack.pop())
        if differ(x.ends, x.n, y.ends, y.n, alpha) or any(differ(x.out[c], x.n, y.out[c], y.n, alpha) for c in {*x.out, *y.out}):
            return False
        stack += [(x.to[c], y.to[c]) for c in x.to if c in y.to]
    return True


def fold(states: list[State], into: int, b: int) -> None:
    """Merge the subtree of b into a state of the automaton."""
    stack = [(into, b)]
    while stack:
        i, j = stack.pop()
        x, y = states[i], states[j]
        x.n, x.ends = x.n + y.n, x.ends + y.ends
        x.out.update(y.out)
        for c, k in y.to.items():
            if c in x.to:
                stack.append((x.to[c], k))
            else:
                x.to[c] = k


def alergia(strings: list[str], alpha: float = ALPHA) -> list[State]:
    """Red states are settled; each blue successor is merged with a compatible one or settled itself."""
    states = prefix_tree(sorted(strings))
    red = [0]
    while blue := next(((r, c) for r in red for c in sorted(states[r].to) if states[r].to[c] not in red), None):
        b = states[blue[0]].to[blue[1]]
        if (home := next((r for r in red if compatible(states, r, b, alpha)), None)) is None:
            red.append(b)
        else:
            states[blue[0]].to[blue[1]] = home
            fold(states, home, b)
    return states


def likelihood(states: list[State], s: str) -> float:
    """Log-likelihood per step, with a little mass for what a state has not seen."""
    at, total, free = 0, 0.0, math.log(1e-4)
    for c in s:
        if at < 0 or c not in states[at].to:
            at, total = -1, total + free
            continue
        total += math.log((states[at].out[c] + 1e-3) / (states[at].n + 1e-1))
        at = states[at].to[c]
    total += free if at < 0 else math.log((states[at].ends + 1e-3) / (states[at].n + 1e-1))
    return total / (len(s) + 1)


@dataclass
class Model:
    states: list[State]
    background: dict[str, dict[str, float]]
    threshold: float

    def score(self, token: str) -> float:
        s = shape(token)
        ordinary = sum(self.background.get(a, {}).get(b, math.log(0.01)) for a, b in zip("^" + s, s + "$", strict=True)) / (len(s) + 1)
        return likelihood(self.states, s) - ordinary


def labelled(docs: DataFrame, sample: int = SAMPLE, plain: int = PLAIN, texts: int = ORDINARY_TEXTS) -> tuple[list[str], list[str]]:
    """Samples, by hash, of distinct credentials and of distinct ordinary tokens."""

    @pandas_udf(ArrayType(StringType()))
    def secret(text: pd.Series) -> pd.Series:
        def of(t: str) -> list[str]:
            found = {t[a:z] for k, a, z in base_spans(t) if k != "assign"} | {m[2] for m in _ASSIGN.finditer(t) if len(m[2]) >= 6}
            return [x for x in found if len(x) < LONGEST]

        return pd.Series([of(t) for t in text])

    @pandas_udf(ArrayType(StringType()))
    def ordinary(text: pd.Series) -> pd.Series:
        def of(t: str) -> list[str]:
            base = Taken([(a, z) for _, a, z in base_spans(t)])
            return list({t[a:z] for a, z in candidates(t) if z - a < LONGEST and base.add(a, z)} | set(re.findall(r"[A-Za-z]{12,40}", t)))

        return pd.Series([of(t) for t in text])

    def lowest(each: DataFrame, n: int) -> list[str]:
        """At most n of the distinct short strings."""
        return [r.token for r in each.distinct().orderBy(F.xxhash64("token"), "token").limit(n).collect()]

    with_secret = docs.filter(F.col("text").rlike("(?i)pass|secret|token|api|AKIA|[0-9a-f]{24}"))  # no base span is without one of these
    good = lowest(with_secret.select(F.explode(secret("text")).alias("token")), sample)
    return good, lowest(cut(sampled(docs, texts).select(F.explode(ordinary("text")).alias("token")), "ordinary"), plain)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    good, plain = labelled(docs, sample)
    if len(good) < 10:
        return None
    held, rest = good[::4], [x for i, x in enumerate(good) if i % 4]
    pairs: dict = defaultdict(Counter)
    for x in plain[1::2] or ["ordinaryword"]:
        for a, b in zip("^" + (s := shape(x)), s + "$", strict=True):
            pairs[a][b] += 1
    background = {a: {b: math.log((n + 0.1) / (c.total() + 1)) for b, n in c.items()} for a, c in pairs.items()}
    model = Model(alergia([shape(x) for x in rest]), background, 0.0)
    known = set(good)
    bad = sorted(model.score(x) for x in plain[::2] if x not in known)
    # nineteen in twenty held-out credentials pass, unless ordinary tokens would; of these one in a thousand may
    model.threshold = max(sorted(model.score(x) for x in held)[len(held) // 20], (bad[-1 - len(bad) // 1000] if bad else 0.0) + 0.1)
    return model


def all_spans(t: str, model: Model | None) -> list[tuple[str, int, int, float]]:
    out = [(*b, 1.0) for b in base_spans(t)]
    if model:
        taken = Taken([b[1:3] for b in out])
        for a, z in candidates(t):
            if taken.add(a, z) and (s := model.score(t[a:z])) >= model.threshold:
                out.append(("format", a, z, s))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id and its spans (kind, start, end, score)."""
    model = model or fit(docs)

    @pandas_udf(SPANS)
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in all_spans(t or "", model)] for t in text])

    return docs.select("doc_id", of("text").alias("spans"))
