"""Benchmark decontamination (native: DataFrame functions only).

The hashes of all normalised test n-grams are broadcast, if their counted size is within
a bound, and the windows of every document are looked up among them. Documents with a hit, few as a rule,
are read again, and equality of the whole window text verifies each hit. Only hits and word counts are
written; texts are neither copied for their windows nor shuffled, unless those with a hit, whose keys
alone are broadcast, are too many for that: then Spark joins by shuffle, with the same result.

Defined results: null or wordless texts have no windows; items with a null
item_id mark hits but are not listed; repeated rows are judged one by one, repeated items
count once, and overlapping windows hit a word once; a long text takes 24 bytes a word for each length of
a window, of which there are ten at most; without items nothing is hit; an empty table gives an
empty result; other columns, of whatever names, are ignored, or kept by decontaminate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed, let, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text that has not been lower-cased.
INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS, -1), "")


def windows(w: Column, k: int, text: bool = False) -> Column:
    """All runs of k words, as structs of their place, k, a hash, and, if asked for, their words space-joined."""

    def one(x: Column, i: Column) -> Column:
        h = F.xxhash64(F.lit(k), x, *[F.get(w, i + d) for d in range(1, k)])
        gram = [F.array_join(F.slice(w, i + 1, k), " ").alias("gram")] if text else []
        return F.struct(i.cast("int").alias("at"), F.lit(k).alias("k"), h.alias("h"), *gram)

    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), one)


def test_ngrams(bench: DataFrame) -> DataFrame:
    """Distinct windows of the items: h, gram, k (its words), items that hold it."""
    w = bench.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    of = lambda k: F.size("w") >= k if k == WINDOW else F.size("w") == k
    each = F.coalesce(*[F.when(of(k), windows(F.col("w"), k, text=True)) for k in range(1, WINDOW + 1)])
    return w.select("item", F.inline(each)).groupBy("h", "gram", "k").agg(F.collect_set("item").alias("items"))


def covered(hits: Column) -> Column:
    """Words inside a set of (at, k) intervals."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["at"] + x["k"] - F.greatest(a["end"], x["at"]))).alias("n"), F.greatest(a["end"], x["at"] + x["k"]).alias("end"))
    return F.aggregate(F.array_sort(hits), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"].cast("long"))


def likely(rows: DataFrame, grams: DataFrame, counts: bool, max_broadcast: int = 2_000_000) -> DataFrame:
    """Per window of rows(uid, text) whose hash a test n-gram has: uid and its place `at`; with counts
    also a row for each text, with its number of words as k, at -1."""
    lengths = sorted(r.k for r in grams.select("k").distinct().collect())  # 10 values at most
    hashes = small(cut(grams.select("h").distinct().withColumn("known", F.lit(True)), "hashes"), max_broadcast)
    marker = lambda w: F.array(F.struct(F.lit(-1).alias("at"), F.size(w).alias("k"), F.lit(None).cast("long").alias("h")))
    each = let(normal_words(F.col("text")), lambda w: F.concat(marker(w), *[windows(w, k) for k in lengths]))
    met = rows.select("uid", F.inline(each)).join(hashes, "h", "left")
    return cut(met.filter("known or at < 0" if counts else "known").select("uid", "at", "k"), "likely")


def hits(rows: DataFrame, grams: DataFrame, found: DataFrame) -> DataFrame:
    """uid, at, k, gram of every window of rows(uid, text) that a test n-gram equals; only rows of likely() are read."""
    lengths = sorted(r.k for r in grams.select("k").distinct().collect())  # 10 values at most
    some = rows.join(small(cut(found.filter("at >= 0").select("uid").distinct(), "touched")), "uid", "left_semi")
    if not lengths:
        return some.select("uid", F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit("").alias("gram")).limit(0)
    each = some.select("uid", F.inline(let(normal_words(F.col("text")), lambda w: F.concat(*[windows(w, k, text=True) for k in lengths]))))
    return cut(each.join(small(cut(grams.select("h", "k", "gram"), "texts")), ["h", "k", "gram"], "left_semi").select("uid", "at", "k", "gram"), "hits")


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, contaminated."""
    grams = cut(test_ngrams(bench), "grams")
    rows = keyed(docs.select("doc_id", "text"), "rows").select("uid", "row.doc_id", "row.text")
    found = likely(rows.select("uid", "text"), grams, counts=True)
    hit = hits(rows.select("uid", "text"), grams, found)
    held = hit.select("uid", "k", "gram").distinct().join(small(cut(grams.select("k", "gram", F.explode("items").alias("item")), "held")), ["k", "gram"])
    items = held.groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = hit.groupBy("uid").agg(covered(F.collect_set(F.struct("at", "k"))).alias("n_hit"))
    each = small(cut(spans.join(items, "uid", "left"), "each"))
    slim = rows.select("uid", "doc_id").join(found.filter("at < 0").select("uid", F.col("k").cast("long").alias("n_words")), "uid")
    out = slim.join(each, "uid", "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents") -> DataFrame:
    """docs without the documents that are hit, or, with remove="spans", without the hit words."""
    rows, grams = keyed(docs, "rows"), cut(test_ngrams(bench), "grams")
    texts = rows.select("uid", F.col("row.text").alias("text"))
    hit = hits(texts, grams, likely(texts, grams, counts=False))
    if remove == "documents":
        return rows.join(small(cut(hit.select("uid").distinct(), "gone")), "uid", "left_anti").select("row.*")
    if remove != "spans":
        raise ValueError(f"remove must be documents or spans, not {remove}")
    joined = rows.join(small(cut(hit.groupBy("uid").agg(F.collect_set(F.struct("at", "k")).alias("spans")), "spans")), "uid", "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(without(F.col("row.text"), F.col("spans")))
    return joined.select(*[text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without(text: Column, spans: Column) -> Column:
    """The text without the words inside the spans; what stands between words stays."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{INSIDE}|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))

    def kept(p: Column) -> Column:
        lead = F.when(F.get(p, F.lit(0)).rlike(f"^{INSIDE}"), 0).otherwise(1)
        hit = lambda i: F.exists(spans, lambda s: (F.floor((i - lead) / 2) >= s["at"]) & (F.floor((i - lead) / 2) < s["at"] + s["k"]))
        return F.array_join(F.filter(p, lambda _, i: (F.pmod(i - lead, F.lit(2)) == 1) | ~hit(i)), "")

    return let(pieces, kept)
