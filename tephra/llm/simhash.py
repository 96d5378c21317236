"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 bits have a common neighbour within 1
bit of each. So every distinct fingerprint emits itself and its 64 one-bit
variants; rows meet on the variant, and colliding pairs are verified. At most 65
distinct fingerprints can meet on one variant, whatever the corpus holds, as
equal fingerprints are merged before. Each meeting links its members to the
smallest one, which keeps the classes whole without all pairs. Classes come
from alternating large-star and small-star steps on the links.

Two edited words in a hundred already move more bits than that. So one_of_each can
also link texts by the Jaccard similarity of their shingles: MinHash values are
compared in bands, each meeting is a link to one member of the band, and the share
of equal values verifies it; cells of several classes meet again around 8 members, then 64, until
each two of different classes have been compared. Links by fingerprint stay.

Rows join their fingerprint, and fingerprints their class, by met(), which deals no hot
key to one task.

Defined results: null or wordless text has fingerprint zero and links like any
other; a bit set in just half of the shingles is 0; a class without any non-null doc_id has a null
component_id; repeated rows each get a row, and one of them stays; long texts are read whole, in
time in proportion to their length; an empty table gives an empty result; other columns, of
whatever names, are ignored, or kept by one_of_each.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType

from .common import cut, discard, keyed, met, small

SEED = 42
SHINGLE = 3
BANDS, IN_BAND = 20, 5  # texts of similarity 0.8 meet in a band with probability 0.9996
PLANES, WORDS = 4, -(-BANDS * IN_BAND // 64)  # bits of each value that are compared first, and the numbers that hold one bit of all values


def hashes_of(text: str | None, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of one text; of the whole text if it is shorter."""
    joined = b" ".join(ws := (text or "").encode().lower().split())
    if len(ws) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if ws else [], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in ws])
    starts, ends = [0, *ends[:-k].tolist()], (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=len(ends))


def fingerprint_of(text: str | None, k: int = SHINGLE) -> int:
    """SimHash of k-word shingles of one text, as a signed 64-bit integer."""
    hashes = hashes_of(text, k)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


@pandas_udf(LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in text], dtype="int64")


_FACTORS, _TERMS = np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * IN_BAND, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash_of(text: str | None, k: int) -> np.ndarray:
    """BANDS * IN_BAND MinHash values of the k-word shingles of one text."""
    hashes, least = hashes_of(text, k), np.full(BANDS * IN_BAND, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[i : i + 512] * _FACTORS + _TERMS).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


@pandas_udf(ArrayType(LongType()))
def planes(values: pd.Series) -> pd.Series:
    """The last PLANES bits of all MinHash values of a text, plane by plane, each plane in whole numbers of 64 bits."""
    found = np.zeros((len(values), PLANES, 64 * WORDS), dtype=np.uint8)
    if len(values):
        found[:, :, : BANDS * IN_BAND] = (np.stack(values)[:, None, :] >> np.arange(PLANES)[None, :, None]) & 1
    return pd.Series(list(np.packbits(found, axis=2, bitorder="little").reshape(len(values), -1).view(np.int64)), dtype=object)


def meeting(placed: DataFrame, similarity: float) -> DataFrame:
    """id, centre: pairs of texts of different classes that meet in a cell of placed(key, id, class, now, bits), one of them a centre.

    Bits of values differ only where values do. They are part of the join, so a pair that they dismiss is no row."""
    one = placed.select("key", "id", F.col("class").alias("ca"), F.col("bits").alias("x"))
    other = placed.filter("now").select(F.col("key").alias("cell"), F.col("id").alias("centre"), F.col("class").alias("cb"), F.col("bits").alias("y"))
    differ = [reduce(lambda p, q: p.bitwiseOR(q), [F.get("x", F.lit(i)).bitwiseXOR(F.get("y", F.lit(i))) for i in range(w, PLANES * WORDS, WORDS)]) for w in range(WORDS)]
    near = sum(map(F.bit_count, differ[1:]), F.bit_count(differ[0])) <= (1 - similarity) * BANDS * IN_BAND + 1e-6
    pairs = one.join(other, F.expr("key = cell AND ca != cb") & near).select("id", "centre")
    return pairs.groupBy(F.least("id", "centre"), F.greatest("id", "centre")).agg(F.min(F.struct("id", "centre")).alias("x")).select("x.*")


def similar_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b), a > b, of fingerprints of rows(fp, values): their classes are those of all texts that meet in a band and share so many MinHash values.

    The texts of a cell are compared with its centre, another one in each band. Linked texts are one class, and from
    then on only cells of several classes are looked at: they take 8 centres in the next round, then 64, 512 ..., and a centre is compared with the members of
    other classes and leaves. So rounds are as few as the logarithm of the largest cell, a cell of copies costs one comparison for each, and no
    two members of different classes are left uncompared."""
    texts = cut(rows.select("fp", "values").distinct().select("fp", "values", F.xxhash64("fp", "values").alias("id"), planes("values").alias("bits")), "texts")
    both = texts.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("values", i * IN_BAND + 1, IN_BAND)))).alias("key")).withColumn("class", F.col("id"))
    one, other = texts.select("id", F.col("fp").alias("f"), F.col("values").alias("v")), texts.select(F.col("id").alias("centre"), F.col("fp").alias("g"), F.col("values").alias("w"))
    equal, links, roots = F.size(F.filter(F.zip_with("v", "w", lambda x, y: x == y), lambda e: e)), None, None
    width = 1
    while True:
        hashed = F.xxhash64("id", "key", F.lit(width))
        mixed = both.groupBy("key").agg(F.min(F.struct(hashed.alias("h"), "id"))["id"].alias("head"), F.count(F.lit(1)).alias("n"), F.min("class").alias("least"), F.max("class").alias("largest"))
        mixed = cut(mixed.filter("least < largest").select("key", "head", "n"), "mixed")
        if links is not None and not mixed.head(1):
            return links.distinct()
        also = F.lit(width > 1) & (F.pmod(hashed, F.lit(1 << 20)) * F.col("n") < F.lit(width << 20))
        placed = met(both, mixed, "key", "n").withColumn("now", (F.col("id") == F.col("head")) | also).drop("head", "n")
        placed = cut(placed.join(texts.select("id", "bits"), "id") if width == 1 else placed, "placed")
        members = cut(meeting(placed, similarity), "members")
        stars = cut(members.groupBy("centre").agg(F.count(F.lit(1)).alias("n")), "stars")
        pairs = met(members.join(one, "id"), cut(stars.join(other, "centre"), "stars"), "centre", "n").filter(equal >= similarity * BANDS * IN_BAND)
        pairs = cut(pairs.select("id", "centre", "f", "g"), "pairs")
        found = pairs.filter("f != g").select(F.greatest("f", "g").alias("a"), F.least("f", "g").alias("b"))
        links, width = found if links is None else links.union(found), width * 8
        both = placed.filter("NOT now").drop("now")
        if pairs.head(1):  # classes so far are stars, so only new links are many
            edges = pairs.select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b"))
            roots = cut(classes(edges if roots is None else edges.union(roots.filter("node != root").select("node", "root")).distinct()), "roots")
            both = both.join(roots, F.col("id") == F.col("node"), "left").withColumn("class", F.coalesce("root", "id")).drop("node", "root")
            both = cut(both, "left")


def ball_links(prints: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that join all distinct fingerprints within 2 bits of each other."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    ball = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    meeting = ball.withColumn("least", F.min("fp").over(W.partitionBy("variant")))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= 2
    return meeting.filter((F.col("fp") > F.col("least")) & near).select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def classes(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links; root is the smallest node of its class.

    The minimum of a node's neighbours is aggregated before it is joined back,
    so the centre of a large star is never one task's group.
    """
    edges, before = cut(links, "links"), None
    for _ in range(rounds):
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first()
        if tuple(seen) == before or not seen[0]:
            break
        before = tuple(seen)
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = cut(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", "m")).filter("a != b").distinct()
        small_ = cut(small_, "small")
        discard(edges, large)
        edges = small_
    else:
        raise RuntimeError(f"classes did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def components(rows: DataFrame, similarity: float | None = None) -> DataFrame:
    """(fp, n, root, component_id) for each distinct fp of rows(doc_id, fp), a written table; n rows have it.

    With a similarity, rows(values) link too."""
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "prints")
    links = ball_links(prints)
    roots = classes(links if similarity is None else links.union(similar_links(rows, similarity)).distinct())
    rooted = cut(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "n", "least_id", F.coalesce("root", "fp").alias("root")), "roots")
    least = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("prints")), "least")
    return cut(met(rooted, least, "root", "prints").select("fp", "n", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id."""
    rows = cut(docs.select("doc_id", fingerprint("text").alias("fp")), "fp")
    return met(rows, components(rows), "fp", "n").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of docs without near-duplicates: of each class the smallest doc_id stays.

    With a similarity, texts whose shingles of so many words are that similar are near-duplicates too.
    Rows that go are the smaller part: they are broadcast if they are few, and shuffled if not."""

    @pandas_udf(ArrayType(IntegerType()))
    def minhash(text: pd.Series) -> pd.Series:
        return pd.Series([minhash_of(t, shingle) for t in text])

    rows = keyed(docs, "rows")
    extra = [] if similarity is None else [minhash("row.text").alias("values")]
    slim = cut(rows.select(F.col("row.doc_id").alias("doc_id"), fingerprint("row.text").alias("fp"), "uid", *extra), "fp")
    rooted = cut(met(slim.select("doc_id", "fp", "uid"), components(slim, similarity), "fp", "n").select("root", "doc_id", "uid"), "rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("x")).select("x.uid")
    return rows.join(small(cut(rooted.select("uid").join(first, "uid", "left_anti"), "gone")), "uid", "left_anti").select("row.*")
