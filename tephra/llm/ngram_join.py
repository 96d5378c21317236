"""N-gram Jaccard join by universe-partition pigeonhole.

A document is the set of its shingles. Sets of sizes n and s that share 80 % of their union differ in
at most H = (n + s) // 9 shingles. Sizes fall into bands; a band cuts the universe of hashes
into somewhat more segments than H + 1, and a set is cut with it. Every set indexes its segments in its own band,
and the one-deletion neighbours of a few of them; it probes its own band and the next one. A probe
spends H + 1 units: one on a segment that has to be equal, a second one where one
shingle may be missing on either side. Then one unit at least finds every partner.

Allocation is by cost: keys are counted over all sets, a unit costs the sets that its keys meet,
and the cheapest units are taken. Keys that nobody else has cost nothing, so sets without a
partner mostly pay for nothing at all, and segments of shared passages are passed over.

Cells of one key are not expanded into pairs. First each set is compared with the one of the cells'
leading probes that it shares most cells with. Links merge classes, and from then on only cells that hold several
classes are looked at: some of their probes, 64 times as many each round, are
compared with the members of other classes, until each probe of a cell has been compared or
its cell is one class. So classes are complete, and a group of near copies costs few comparisons for each copy.
Cells with the same lead, their set of the least hash, have much the same sets and are compared as one.
Pairs are dismissed if the parity bits of their shingles differ in more than H, within the join of the cells, and otherwise
verified on the whole sets.

A key that a third of all sets share is found by counting the keys of every 64th set, and
dealt over tasks; that changes no result. Equal texts are merged first.

Shingles and sets are named by 64-bit hashes: of N different sets, about N * N / 2**65 pairs share a name.

Defined results: a null, empty or wordless text has no shingles and links with nothing; fewer
words than a shingle are one shingle; repeated rows each get a row; a class without any non-null
doc_id has a null component_id; a similarity of just 80 % links; long texts are read whole; an
empty table gives an empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from .common import cut_tidy as cut
from .common import keyed, met, small
from .simhash import classes

SHINGLE = 5
#: Jaccard similarity of 80 %: sets of sizes n and s differ in (n + s) // 9 shingles at most, and sizes by a quarter.
SHARE, OF = 80, 100
LEAST = 4  # smaller sets are only similar if they are equal
#: First sizes of the bands. Partners of a set are in its own band, the one below or the one above.
BANDS = [LEAST]
while BANDS[-1] < 1 << 40:
    BANDS.append(BANDS[-1] * 8 // 5)
EXACT, DELETED, PROBE_DELETED, PROBE_EXACT = range(4)  # kinds of keys; DELETED is only indexed, the last two are only probed
SAMPLE, HOT = 64, 2_000

_U = np.uint64
_RANDOM = np.random.default_rng(42)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_P, _Q = (int(x) for x in _RANDOM.integers(1 << 40, 1 << 62, 2) * 2 + 1)
_LETTER = np.ones(256, dtype=bool)
_LETTER[[32, *range(9, 14)]] = False
_powers: list[np.ndarray] = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of an odd number and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 14, 2 * len(_powers[0]))
        for i, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            _powers[i] = np.r_[_U(1), np.cumprod(np.full(n - 1, p, dtype=_U), dtype=_U)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of whole numbers."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def totals(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2 ... numbers, modulo 2**64."""
    out = np.zeros(len(x) + 1, dtype=_U)
    np.cumsum(x, dtype=_U, out=out[1:])
    return out


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles of one text; of all words if they are fewer."""
    letters = np.frombuffer((text or "").encode().lower(), dtype=np.uint8)
    inside = np.zeros(len(letters) + 2, dtype=bool)
    np.take(_LETTER, letters, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=_U)
    up, down = powers(len(letters) + 1)
    sums = totals(_BYTE[letters] * up[: len(letters)])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    k = min(k, len(words))
    grams = np.full(len(words) - k + 1, k, dtype=_U)
    for i in range(k):
        grams *= _U(_Q)
        grams += words[i : len(words) - k + 1 + i]
    grams = mix(grams)
    grams.sort()
    return grams[np.concatenate(([True], grams[1:] != grams[:-1]))]


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def parity(hashes: np.ndarray) -> np.ndarray:
    """A power of two of parity bits, two to four for a shingle, as whole numbers."""
    n = 64 << max(0, int(len(hashes) - 1).bit_length() - 5)
    odd = np.bincount((hashes & _U(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def band_of(n: int) -> int:
    return bisect_right(BANDS, n) - 1


def shape(band: int) -> tuple[int, int]:
    """How many segments a band has, and how many of them index one-deletion neighbours."""
    most = 2 * (BANDS[band + 1] - 1) // 9 + 1
    return most + most // 24 + 1, most // 32 + 1


def units(n: int, band: int) -> int:
    """How many units a set of n shingles spends on a band to find all its larger or equal partners there; 0: there are none."""
    largest = min(BANDS[band + 1] - 1, 5 * n // 4)
    return (n + largest) // 9 + 1 if largest >= BANDS[band] else 0


@cache
def salts(band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers that keep the keys of bands, segments and kinds apart, and the meaning of the keys of whole segments."""
    m, r = shape(band)
    at = np.arange(m, dtype=np.int32) << 3
    of = lambda n, deleted: mix(_U((band * 2 + deleted) * 0xD6E8FEB86659FD93 % (1 << 64)) + np.arange(n, dtype=_U))
    return of(m, 0), of(r, 1), np.concatenate([at | EXACT, at[:r] | PROBE_DELETED])


def keys_of(hashes: np.ndarray, mixed: np.ndarray, sums: np.ndarray, band: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their meaning, position * 8 + 4 for the next band + kind, of one set in one band; sums are the totals of mixed hashes."""
    m, r = shape(band)
    exact, deleted, what = salts(band)
    segment = (((hashes >> _U(32)) * _U(m)) >> _U(32)).astype(np.int32)
    bounds = np.zeros(m + 1, dtype=np.int64)
    np.cumsum(np.bincount(segment, minlength=m), out=bounds[1:])
    ends = sums[bounds]
    whole = ends[1:] - ends[:-1]
    where = segment[: bounds[r]]  # the shingles of the first r segments come first
    less, place = whole[where] - mixed[: bounds[r]], where << 3
    parts, meant = [whole + exact, whole[:r] + deleted, less + exact[where]], [what, place | PROBE_EXACT]
    if own:
        parts.append(less + deleted[where])
        meant.append(place | DELETED)
    return mix(np.concatenate(parts)).view(np.int64), np.concatenate(meant) | np.int32(0 if own else 4)


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """key, id, what from rows(text): all keys of the set of each text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, size = [], 0
            for text in b.column(0):
                hashes = shingles(text.as_py(), k)
                if len(hashes) >= LEAST:
                    name, band, mixed = set_id(hashes), band_of(len(hashes)), mix(hashes ^ _U(0x9E3779B97F4A7C15))
                    sums = totals(mixed)
                    for x in (band, band + 1):
                        if units(len(hashes), x):
                            keys, what = keys_of(hashes, mixed, sums, x, x == band)
                            found.append((keys, np.full(len(keys), name), what))
                            size += len(keys)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["key", "id", "what"])
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["key", "id", "what"])

    return rows.select("text").mapInArrow(made, "key long, id long, what int")


#: Conditions on `what`, as SQL.
_INDEXED, _PROBED, _HIGHER = f"((what & 7) = {EXACT} OR (what & 7) = {DELETED})", f"(what & 3) != {DELETED}", "(what & 4) > 0"


def cells(rows: DataFrame, k: int) -> DataFrame:
    """key, id, what, cost: the keys under which an indexed set and another set's probe meet; cost: sets that index the key."""
    signed = signatures(rows, k)
    some = signatures(rows.filter(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0), k)
    often = cut(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "hot")
    often = often.filter(F.col("n") > max(1_000, (often.agg(F.sum("n")).first()[0] or 0) // HOT)).select("key")  # HOT keys at most
    signed = signed.join(F.broadcast(often.withColumn("hot", F.lit(True))), "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("id", F.lit(256))).otherwise(0))
    w = W.partitionBy("key", "salt")
    counts = {"cost": F.sum(F.when(F.expr(_INDEXED), 1).otherwise(0)).over(w), "probes": F.sum(F.when(F.expr(_PROBED), 1).otherwise(0)).over(w), "least": F.min("id").over(w), "largest": F.max("id").over(w)}
    kept = signed.repartition("key", "salt").withColumns(counts).filter("hot OR (cost > 0 AND probes > 0 AND least < largest)")
    kept = cut(kept.select("key", "id", "what", F.when(F.col("hot").isNull(), F.col("cost")).alias("cost")), "cells")
    if not often.head(1):
        return kept
    costs = cut(kept.join(F.broadcast(often), "key").groupBy("key").agg(F.sum(F.when(F.expr(_INDEXED), 1).otherwise(0)).alias("all")), "costs")
    return cut(kept.join(F.broadcast(costs), "key", "left").select("key", "id", "what", F.coalesce("cost", "all").alias("cost")), "cells")


def cheapest(n: int, higher: bool, what: np.ndarray, keys: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The keys that the cheapest units of a set in a band probe, of the keys that meet any set."""
    band = band_of(n) + higher
    m, r = shape(band)
    kind, at = what & 3, what >> 3
    once, twice = np.zeros(m, dtype=np.int64), np.zeros(r, dtype=np.int64)
    exact = kind == EXACT
    once[at[exact]] = cost[exact]
    np.add.at(twice, at[~exact], cost[~exact])
    order = np.argsort(np.r_[once, np.maximum(twice, once[:r])], kind="stable")[: units(n, band)]
    taken = np.zeros(m + r, dtype=bool)
    taken[order] = True
    return keys[taken[np.where(exact, at, at + m)]]


@pandas_udf(ArrayType(LongType()))
def allocated(n: pd.Series, higher: pd.Series, what: pd.Series, keys: pd.Series, cost: pd.Series) -> pd.Series:
    return pd.Series([cheapest(*x) for x in zip(n, higher, what, keys, cost, strict=True)], dtype=object)


def probes(found: DataFrame, sets: DataFrame) -> DataFrame:
    """key, id: the keys of each set on which units are spent."""
    own = found.filter(_PROBED).groupBy("id", F.expr(_HIGHER).alias("higher")).agg(F.collect_list(F.struct("what", "key", "cost")).alias("x"))  # of one set
    part = lambda c: F.transform("x", lambda e: e[c])
    return own.join(sets.select("id", "n"), "id").select("id", F.explode(allocated("n", "higher", part("what"), part("key"), part("cost"))).alias("key"))


def close(na: str, xa: str, nb: str, xb: str) -> Column:
    """Whether the sizes na, nb and the parity bits xa, xb of two sets allow a link."""
    half = lambda x: F.zip_with(F.slice(x, 1, F.size(x) / 2), F.slice(x, (F.size(x) / 2 + 1).cast("int"), F.size(x) / 2), lambda p, q: p.bitwiseXOR(q))
    folded = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(F.col(x))  # noqa: E731  sizes of partners differ by a quarter, so by one fold
    change = F.aggregate(F.zip_with(folded(xa, xb), folded(xb, xa), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return (F.least(na, nb) * OF >= F.greatest(na, nb) * SHARE) & (change * 9 <= F.col(na) + F.col(nb))


def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n: of distinct pairs (a, b) of sets those whose sizes and parity bits allow a link, and the sum of both sizes."""
    one, other = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return pairs.join(one, "a").join(other, "b").filter(close("na", "xa", "nb", "xb")).select("a", "b", (F.col("na") + F.col("nb")).alias("n"))


def gathered(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """lead, id, class, member, now, n, bits from placed(lead, id, ask, class, now): a set once in all cells of one lead, with its size and bits.

    Cells of one lead have much the same sets, so bits, which are some hundred bytes, are sent once for many cells."""
    once = placed.filter("ask = 0 OR now").groupBy("lead", "id").agg(F.min("class").alias("class"), (F.min("ask") == 0).alias("member"), F.max("now").alias("now"))
    return cut(once.join(sets.select("id", "n", "bits"), "id"), "gathered")


def meeting(placed: DataFrame) -> DataFrame:
    """a, b, n: pairs of sets of different classes that meet in the cells of one lead in placed(lead, id, class, member, now, n, bits), as near() has them.

    Bits and sizes are part of the join, so a pair that they dismiss is no row, however many near misses a cell holds."""
    one = placed.filter("member").select("lead", F.col("id").alias("a"), F.col("class").alias("ca"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    other = placed.filter("now").select(F.col("lead").alias("led"), F.col("id").alias("b"), F.col("class").alias("cb"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    pairs = one.join(other, F.expr("lead = led AND ca != cb") & close("na", "xa", "nb", "xb"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("n")).distinct()


def similar(pairs: DataFrame, sets: DataFrame, rows: DataFrame, texts: DataFrame | None, k: int) -> tuple[DataFrame, DataFrame]:
    """Of distinct pairs (a, b, n) of sets, as near() has them, those that link, and the whole sets (id, set) read so far.

    Each whole set is read once in all rounds, and only those of this round's pairs are joined."""

    @pandas_udf(ArrayType(LongType()))
    def whole(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, k).view(np.int64) for t in text], dtype=object)

    pairs = cut(pairs, "near")
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    wanted = ids if texts is None else ids.join(texts.select("id"), "id", "left_anti")
    wanted = cut(wanted.join(sets.select("id", "uid"), "id"), "wanted")
    if texts is None or wanted.head(1):
        fresh = cut(rows.join(small(wanted), "uid").select("id", whole("text").alias("set")), "sets")
        texts = fresh if texts is None else texts.union(fresh)
    own = texts.join(small(ids), "id", "left_semi")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(own.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    linked = both.filter(common * OF >= (F.col("n") - common) * SHARE)
    return cut(linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges"), texts


def links(members: DataFrame, asking: DataFrame, sets: DataFrame, rows: DataFrame, k: int) -> DataFrame | None:
    """(node, root) of the classes of all sets that meet in cells: members(key, id) and asking(key, id), written tables.

    Rounds are few, as each is some twenty small stages: a cell is asked by 1, 64, 4,096 ... probes."""
    lead = asking.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"].alias("lead"))
    lead = cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(lead, "key"), "lead")
    first = met(members, lead, "key", "n").filter("id != lead").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("n"))
    first = first.groupBy("id").agg(F.max(F.struct("n", "lead"))["lead"].alias("lead")).select(F.greatest("id", "lead").alias("a"), F.least("id", "lead").alias("b")).distinct()
    edges, texts = similar(near(first, sets), sets, rows, None, k)
    both = members.withColumn("ask", F.lit(0)).unionByName(asking.withColumn("ask", F.lit(1))).withColumn("class", F.col("id"))
    roots, width = None, 1
    while True:
        if edges.head(1):  # classes so far are stars, so only new links are many
            roots = cut(classes(edges if roots is None else edges.union(roots.filter("node != root").select("node", "root")).distinct()), "roots")
            both = both.join(roots, F.col("id") == F.col("node"), "left").withColumn("class", F.coalesce("root", "id")).drop("node", "root")
            both = cut(both, "both")
        mixed = both.groupBy("key").agg(F.sum("ask").alias("probes"), F.count(F.lit(1)).alias("count"), F.min("class").alias("least"), F.max("class").alias("largest"), F.min(F.xxhash64("id")).alias("lead"))
        mixed = cut(mixed.filter("probes > 0 AND least < largest").select("key", "probes", "count", "lead"), "mixed")
        if not mixed.head(1):
            return roots
        now = F.pmod(F.xxhash64("id", "key", F.lit(width)), F.lit(1 << 20)) * F.col("probes") < F.lit(width << 20)
        placed = cut(met(both, mixed, "key", "count").withColumn("now", now & (F.col("ask") == 1)).drop("probes", "count"), "placed")
        edges, texts = similar(meeting(gathered(placed, sets)), sets, rows, texts, k)
        both, width = placed.filter("NOT now").drop("now", "lead"), width * 64


def linked(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id of its class)."""

    @pandas_udf("id long, n long, bits array<long>")
    def named(text: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, k) for t in text]
        return pd.DataFrame({"id": [set_id(s) for s in sets], "n": list(map(len, sets)), "bits": pd.Series([parity(s) for s in sets], dtype=object)})

    whole = keyed(docs, "rows").select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    slim = cut(whole.select("uid", "doc_id", named("text").alias("x")).select("uid", "doc_id", "x.*"), "named")
    sets = cut(slim.filter("n > 0").groupBy("id").agg(F.max("n").alias("n"), F.min("uid").alias("uid"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.any_value("bits").alias("bits")), "sets")
    others = slim.select("uid", "n", "id").join(sets.select("uid").withColumn("first", F.lit(True)), "uid", "left").filter(F.col("first").isNull() | (F.col("n") < LEAST)).select("uid")
    rows = whole.join(small(cut(others, "others")), "uid", "left_anti").select("uid", "text")
    found = cells(rows, k)
    asking = cut(probes(found, sets), "probes")
    members = cut(found.filter(_INDEXED).select("key", "id").join(asking.select("key").distinct(), "key", "left_semi"), "members")
    roots = links(members, asking, sets, rows, k)
    if roots is None:
        classed = sets.select("id", "copies", F.col("least_id").alias("component_id"))
    else:
        rooted = cut(sets.join(roots, F.col("id") == F.col("node"), "left").select("id", "copies", "least_id", F.coalesce("root", "id").alias("root")), "rooted")
        least = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
        classed = met(rooted, least, "root", "n").select("id", "copies", "component_id")
    some = met(slim.filter("n > 0").select("doc_id", "n", "id"), cut(classed, "classed"), "id", "copies")
    return some.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(slim.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
