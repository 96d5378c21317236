"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Per document a few whole-number measures are taken. For every language and
source their distribution is kept as a mergeable quantile sketch: a table of
counts per log-linear bucket (exact below 64, 32 buckets per octave above, so a
quantile is off by 1/32 at most), over the documents that pass the base rules.
Sketches of several groups merge by adding counts. The quartiles of each language and
source are blended with those of the language, and these with the corpus', by
weight: a prior of `prior` documents against the group's own, so every group moves
its own thresholds and a small one leans on the larger ones. Fences beyond the outer
quartiles replace fixed cutoffs, and documents are joined with the fences of their
group. A fence on a share never leaves more than half of a text to junk.

Defined results: null text counts as empty (no words, base_failed); null
language or source is a group of its own; a value on a fence is kept; repeated rows are
judged one by one; texts are read whole, in time that grows a little faster than
their length (a sort of their windows); an empty table gives an empty result; other
columns, of whatever names, are ignored or passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, let, packed, small, words

#: name: (numerator, denominator, scale, slack, highest fence or None for a measure with fences on both sides)
MEASURES = {
    "word_length": ("word_chars", "n_words", 100, 100, None),
    "symbols": ("n_symbols", "word_chars", 10_000, 300, 5_000),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 4_000, 5_000),
    "repeats": ("n_repeat_words", "n_words", 10_000, 3_500, 5_000),
}
QUARTILES = (25, 50, 75)


@dataclass(frozen=True)
class QualityParams:
    """prior: as many documents the quartiles of the next larger group count for. reach: how
    many times the distance from the median to the outer quartile a fence lies beyond it."""

    prior: int = 200
    reach: int = 6


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the list w."""

    def of_dups(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                return F.coalesce((a["h"] == b["h"]) & F.forall(F.array(*map(F.lit, range(3))), lambda d: F.get(w, a["i"] + d) == F.get(w, b["i"] + d)), F.lit(False))

            at = F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"]))
            return let(F.sort_array(F.filter(at, lambda x: x.isNotNull())), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

        return let(keyed, covered)

    hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), of_dups(h)).otherwise(0))


def counts(text: Column) -> Column:
    """All raw counts of one text, as a struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words"))

    return F.struct(
        let(words(text), of_words).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )


def measured(docs: DataFrame, keep_row: bool) -> DataFrame:
    """Counts and scaled measures per row of docs; the whole row too if keep_row."""
    work = {"doc_id": docs["doc_id"], "lang": docs["lang"], "source": docs["source"], "c": counts(docs["text"])}
    df = packed(docs, **work) if keep_row else docs.select(*[c.alias(k) for k, c in work.items()])
    keep = (["row"] if keep_row else []) + ["doc_id", "lang", "source"]
    df = df.select(*keep, "c.w.n_words", "c.w.word_chars", "c.n_symbols", "c.l.n_dup_lines", "c.w.n_repeat_words", "c.l.n_lines")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumns({"base_failed": failed} | {m: F.floor(F.col(a) * k / F.greatest(F.col(b), F.lit(1))).cast("long") for m, (a, b, k, *_) in MEASURES.items()})


def bucket(v: Column) -> Column:
    octave = F.length(F.bin(v)) - 6
    return F.when(v < 64, v.cast("int")).otherwise((octave * 32 + F.floor(v / F.pow(F.lit(2.0), octave))).cast("int"))


def bucket_top(b: Column) -> Column:
    """The largest value in a bucket."""
    octave = F.floor(b / 32) - 1
    return F.when(b < 64, b.cast("long")).otherwise(((b - octave * 32 + 1) * F.pow(F.lit(2.0), octave)).cast("long") - 1)


def sketch(rows: DataFrame) -> DataFrame:
    """Counts per language, source, measure and bucket, over all rows that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    return rows.filter("not base_failed").select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles for each group of merged sketches. A window holds the buckets of one measure of
    a group, some hundreds."""
    merged = sk.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "measure")
    at = merged.withColumns({"upto": F.sum("n").over(by.orderBy("bucket")), "total": F.sum("n").over(by)})
    q = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, bucket_top(F.col("bucket")))).alias(f"q{p}") for p in QUARTILES]
    return at.groupBy(*keys, "measure").agg(F.max("total").alias("total"), *q)


def blended(q: str, prior: int) -> str:
    """Own (o), language (l) and corpus (a) quantiles by weight, in whole numbers."""
    wide = f"((l.total * l.{q} + {prior} * a.{q}) div (l.total + {prior}))"
    return f"(o.total * o.{q} + {prior} * {wide}) div (o.total + {prior})"


def fences(sk: DataFrame, p: QualityParams) -> DataFrame:
    """One row per language and source: lowest and highest value allowed of each measure."""
    own, of_lang, of_all = (quantiles(sk, k) for k in (["lang", "source"], ["lang"], []))
    joined = own.alias("o").join(of_lang.alias("l"), (F.col("o.lang").eqNullSafe(F.col("l.lang"))) & (F.col("o.measure") == F.col("l.measure"))).join(of_all.alias("a"), F.col("o.measure") == F.col("a.measure"))
    chosen = joined.select("o.lang", "o.source", "o.measure", *[F.expr(blended(f"q{q}", p.prior)).alias(f"q{q}") for q in QUARTILES])
    of = lambda i: F.create_map(*[F.lit(x) for m, v in MEASURES.items() for x in (m, v[i])])[F.col("measure")]
    high = F.least(F.col("q75") + p.reach * (F.col("q75") - F.col("q50")) + of(3), of(4))  # least() passes over null
    low = F.col("q25") - p.reach * (F.col("q50") - F.col("q25")) - of(3)
    at = lambda c, m: F.max(F.when(F.col("measure") == m, c))
    return chosen.groupBy("lang", "source").agg(*[at(high, m).alias(f"{m}_high") for m in MEASURES], *[at(low, m).alias(f"{m}_low") for m, v in MEASURES.items() if v[4] is None])


def judged(rows: DataFrame, p: QualityParams) -> DataFrame:
    """rows (a written table) with the verdict `kept`, by a join with the fences."""
    limits = small(cut(fences(sketch(rows), p), "fences")).alias("f")
    joined = rows.alias("r").join(limits, F.col("r.lang").eqNullSafe(F.col("f.lang")) & F.col("r.source").eqNullSafe(F.col("f.source")), "left")
    ok = ~F.col("r.base_failed")
    for m, v in MEASURES.items():
        ok = ok & (F.col(m) <= F.coalesce(F.col(f"{m}_high"), F.col(m)))
        if v[4] is None:
            ok = ok & (F.col(m) >= F.coalesce(F.col(f"{m}_low"), F.col(m)))
    return joined.select("r.*", ok.alias("kept"))


def quality_rules(docs: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """One row per document: counts, measures, base_failed and kept."""
    return judged(cut(measured(docs, keep_row=False), "quality"), params or QualityParams())


def keep_good(docs: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """The rows of docs that the rules keep, unchanged."""
    return judged(cut(measured(docs, keep_row=True), "quality"), params or QualityParams()).filter("kept").select("row.*")
