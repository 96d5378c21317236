"""Spelling variants by a trie of frequency vectors.

A word's vector counts its letters in 16 groups. One inserted, deleted or replaced letter
adds at most one to one group (surplus) and takes at most one from one group (deficit).
Words are arranged in a trie by successive group counts. The top of the trie is dealt over
tasks: a branch is a prefix of the vector, as long as the largest branch needs to hold few enough
words, and a word is sent to the branches that its budget of one surplus and one deficit
reaches. In a branch the rest of the trie is searched depth-first, each node once for all
the words whose budget reaches it, and words at the leaves are verified: by parity masks of their
pairs and triples of letters, which an edit changes in few bits, and then letter by letter.
Branches that stay too large at full length are split into pieces of words and of searches, each
of which meets each other one, so no task holds more than `most` words and as many searches.

Counting is the only pass over the texts: tasks count words before they are shuffled.

Defined results: a null text has no words; a null doc_id is written as nothing before the
colon; ties of n go to the smaller word by code points; copies of rows count again;
long texts and words are read whole; an empty table gives an empty result; other columns, of
whatever names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType

from .common import cut, discard, small

MIN_LENGTH, MIN_COUNT, DAMAGE = 5, 3, 97
GROUPS = 16
#: Usual letters get a group of their own; the others follow their code points.
OWN_GROUP = {c: i for i, c in enumerate("etaoinsrhldcumfp")}
#: Words of one branch, or searches in it, that one task takes.
MOST = 50_000

def count_runs(found: dict[bytes, int], doc_id: int | None, text: str | None, runs: re.Pattern, least: int, damage: int) -> None:
    """Add the words of one document to found, as Latin-1, a byte a letter; every `damage`th word or so lacks a letter in all of it (0: none does)."""
    began, crc, get = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), zlib.crc32, found.get
    low = (text or "").encode("latin-1", "replace").lower()  # bytes have A-Z lower-cased alone; other letters become a question mark
    plain = low.isascii() or not damage
    for word in runs.findall(low):
        if damage and not (h := crc(word if plain else word.decode("latin-1").encode(), began)) % damage:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        found[word] = get(word, 0) + 1


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word, n: words of so many code points and occurrences."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % min_length)  # from where it begins, a match is the whole run
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                count_runs(found, doc_id.as_py(), text.as_py(), runs, min_length, damage)
                if len(found) > 200_000:
                    yield flush()
                    found.clear()
        yield flush()

    parts = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


_GROUP_OF = np.array([OWN_GROUP.get(chr(c), c % GROUPS) for c in range(256)])


def letters_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the words in a row, and the number of each letter's word."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8), np.repeat(np.arange(len(words)), [len(w) for w in words])


def vectors_of(words: np.ndarray) -> np.ndarray:
    """A table of the group counts of the words."""
    letters, of = letters_of(words)
    return np.bincount(of * GROUPS + _GROUP_OF[letters], minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def masks_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit parity masks of the pairs and triples of letters of each word, with its borders.

    An edit removes and adds no more than 4 pairs and 6 triples, so masks of words of one edit differ in no more bits."""
    letters, _ = letters_of(["\1\1" + w + "\2\2" for w in words])
    ends = np.cumsum([len(w) + 4 for w in words])
    code, out = letters.astype(np.uint64), []
    for k, prime in ((2, 0x9E3779B97F4A7C15), (3, 0xC2B2AE3D27D4EB4F)):
        gram = sum(code[i : len(code) - k + 1 + i] << np.uint64(8 * i) for i in range(k))
        bit = np.uint64(1) << ((gram * np.uint64(prime)) >> np.uint64(58))
        bit = np.concatenate([bit, np.zeros(k - 1, dtype=np.uint64)])
        for i in range(1, k):
            bit[ends - i] = 0  # what would reach into the next word
        out.append(np.bitwise_xor.reduceat(bit, np.r_[0, ends[:-1]]))
    return out[0], out[1]


@pandas_udf(ArrayType(LongType()))
def vectors(words: pd.Series) -> pd.Series:
    return pd.Series(list(vectors_of(words.to_numpy())), dtype=object)


def reached(counts: list[int], k: int) -> list[str]:
    """The branches, prefixes of k counts, that one surplus and one deficit reach from a vector."""
    own, out = counts[:k], []
    for up in range(-1, k):
        for down in range(-1, k):
            if up == down != -1 or down >= 0 and own[down] == 0:
                continue
            other = list(own)
            if up >= 0:
                other[up] += 1
            if down >= 0:
                other[down] -= 1
            out.append(".".join(map(str, other)))
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def search(members: np.ndarray, probes: np.ndarray, page: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probe numbers, member numbers) of the leaves of the trie and the probes whose budget reaches them.

    members and probes are tables of vectors. A node is a run of the sorted members; it is visited once, with all probes
    that still have a budget there. Nodes whose members times probes fit a page are leaves.
    """
    order = np.lexsort(members.T[::-1])
    ranked = members[order]
    stack = [(0, len(order), 0, np.arange(len(probes)), np.ones(len(probes), dtype=np.int8), np.ones(len(probes), dtype=np.int8))]
    while stack:
        lo, hi, level, alive, surplus, deficit = stack.pop()
        if not len(alive) or lo == hi:
            continue
        if level == GROUPS or (hi - lo) * len(alive) <= page:
            yield alive, order[lo:hi]
            continue
        starts = lo + np.flatnonzero(np.diff(ranked[lo:hi, level], prepend=-1))
        own = probes[alive, level]
        for a, z in zip(starts, [*starts[1:], hi], strict=True):
            change = ranked[a, level] - own
            s, d = surplus - (change == 1), deficit - (change == -1)
            go = (np.abs(change) <= 1) & (s >= 0) & (d >= 0)
            stack.append((a, z, level + 1, alive[go], s[go], d[go]))


def verified(probes: np.ndarray, members: np.ndarray, page: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probe numbers, member numbers) of all words and members of exactly one edit."""
    (p2, p3), (m2, m3) = masks_of(probes), masks_of(members)
    for p, m in search(vectors_of(members), vectors_of(probes)):
        own2, most = m2[m], max(1, page // len(m))
        for some in (p[i : i + most] for i in range(0, len(p), most)):
            i, j = np.nonzero(np.bitwise_count(p2[some, None] ^ own2) <= 4)
            i, j = some[i], m[j]
            few = np.bitwise_count(p3[i] ^ m3[j]) <= 6
            i, j = i[few], j[few]
            sure = np.fromiter((one_edit(a, b) for a, b in zip(probes[i], members[j], strict=True)), dtype=bool, count=len(i))
            yield i[sure], j[sure]


def _searched(group: pd.DataFrame) -> pd.DataFrame:
    is_member = group["member"].to_numpy()
    words, near = group["word"].to_numpy(), group[is_member]
    own, counts, probes = near["word"].to_numpy(), near["n"].to_numpy(), words[~is_member]
    found = list(verified(probes, own)) if len(own) and len(probes) else []
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
    return pd.DataFrame({"word": pd.Series(probes[i], dtype=object), "near": pd.Series(own[j], dtype=object), "n": counts[j]})


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, n): all pairs of one edit in both directions, n that of `near`. words(word, n) is a written table."""
    vectored = words.withColumn("counts", vectors("word"))
    sizes = cut(vectored.groupBy("counts").agg(F.count(F.lit(1)).alias("n")), "vectors")
    for k in range(1, GROUPS + 1):
        prefix = F.concat_ws(".", F.slice("counts", 1, k).cast("array<string>"))
        if (sizes.groupBy(prefix.alias("branch")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) <= most:
            break

    @pandas_udf(ArrayType(StringType()))
    def reach(words: pd.Series) -> pd.Series:
        return pd.Series([reached(v, k) for v in vectors_of(words.to_numpy()).tolist()], dtype=object)

    members = vectored.select("word", "n", prefix.alias("branch"))
    probes = words.select("word", F.explode(reach("word")).alias("branch"))
    pieces = lambda name: F.ceil(F.col(name) / most).cast("int")
    held = members.groupBy("branch").agg(F.count(F.lit(1)).alias("held"))
    asked = probes.groupBy("branch").agg(F.count(F.lit(1)).alias("asked"))
    plan = cut(held.join(asked, "branch").select("branch", pieces("held").alias("held"), pieces("asked").alias("asked")), "branches")
    hint = small(plan)
    piece = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(hint, "branch").select("branch", piece("held").alias("h"), each("asked").alias("a"), "word", "n", F.lit(True).alias("member"))
    right = probes.join(hint, "branch").select("branch", each("held").alias("h"), piece("asked").alias("a"), "word", F.lit(0).cast("long").alias("n"), F.lit(False).alias("member"))
    return left.union(right).groupBy("branch", "h", "a").applyInPandas(_searched, "word string, near string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from forms(word, form): pointers double until none moves. n at least doubles with each form, so there is an end."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(now.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = moved
        if not moved.filter("moved").head(1):
            return moved.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE, most: int = MOST) -> DataFrame:
    """One row per word: word, form (its usual spelling, else null), root, n, n_near, form_n."""
    words = cut(vocabulary(docs, min_length, min_count, damage), "words")
    near = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    better = F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n"))
    out = cut(out, "variants")
    return out.join(roots(out.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
