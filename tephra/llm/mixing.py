"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source, in the order of a hash, form one stream of words that
is cut into blocks. A source's target is so many whole passes over its stream
plus so many blocks of one more pass, the last of them in part: an exact block
quota. A binary tree over
the output shards splits the vector of quotas: at each node the left half draws
its share of every source's blocks from a multivariate hypergeometric
distribution. The n-th draw of a source is the n-th block of a keyed permutation
of its blocks, so shards draw disjoint blocks without any table of blocks, and
each shard then shuffles what it drew by a hash.

Sources are dealt into a fixed number of buckets; the tree runs over the buckets
first and inside every bucket afterwards, which is the same distribution, so
neither the driver nor a task ever holds all sources. Sources are numbered by a
range sort and the counts of its partitions; the water level comes from a few
aggregates over the sources.

Defined results: null text has size 0, and a document of size 0 is never drawn;
a null source is a source of its own, last in order; repeated rows are drawn as
documents of their own; rows with equal hashes come in the order of doc_id and
then of their place, so reruns agree; a long text takes a task memory for itself and
its draws, one for about every 512 words of a pass; an empty table gives an empty result; other
columns, of whatever names, are passed on by mixed_documents alone.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import WORD, cut, keyed, met, running, words

CAP = 3  # passes over a source at most
BUCKETS = 256
NUMPY_MOST = 1_000_000_000  # numpy draws from fewer items only
DRAWS = ("epoch", "draw", "shard", "first", "n")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without return from good + bad items are good; exact for any numbers.

    From many items each is taken with probability n / all first, which leaves a set that is
    uniform given its size; about sqrt(n) draws then put the size right, by the same rule."""
    if n == 0 or good == 0:
        return 0
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    x, y = (int(rng.binomial(k, n / (good + bad))) for k in (good, bad))
    return x - hypergeometric(rng, x, y, x + y - n) if x + y > n else x + hypergeometric(rng, good - x, bad - y, n - x - y)


def split(quotas: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n draws without return from so many items of each kind, by kind."""
    left, out = int(quotas.sum()), np.zeros_like(quotas)
    if left < NUMPY_MOST:
        return rng.multivariate_hypergeometric(quotas, n, method="marginals")
    for i, q in enumerate(map(int, quotas)):
        out[i] = hypergeometric(rng, q, left - q, n)
        left, n = left - q, n - int(out[i])
    return out


def split_tree(quotas: np.ndarray, capacities: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows: shards; columns: how many of each kind's draws the shard gets."""
    if len(capacities) == 1:
        return quotas[None, :]
    half = len(capacities) // 2
    left = split(quotas, int(capacities[:half].sum()), rng)
    return np.vstack([split_tree(left, capacities[:half], rng), split_tree(quotas - left, capacities[half:], rng)])


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: a four-round Feistel network, walked until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for i in range(4):
            h = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 4 + i) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
        return (left << shift) | right

    out = once(x.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with `sid`, the rank of its source: a range sort, and the row counts of its partitions."""
    at = cut(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    at = at.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition of the sort
    starts = at.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    return at.join(F.broadcast(starts), "part").withColumn("sid", F.col("start") + F.col("at")).drop("part", "at", "start")


def water_level(plan: DataFrame) -> float:
    """Target words for each unit of weight of the sources that do not stop at `most`."""
    one = plan.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("rest")).first()
    level = (one.total or 0) / (one.rest or 1)
    while True:  # each round resets the excess of the sources that were found full, as the rule says
        full = F.col("most") <= F.col("weight") * level
        now = plan.agg(F.sum(F.when(full, F.col("most")).otherwise(0)).alias("spent"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("rest")).first()
        after = (one.total - now.spent) / now.rest if now.rest else level
        if after <= level:
            return level
        level = after


def source_plan(sizes: DataFrame, seed: int, block_words: int) -> DataFrame:
    """Per source of sizes(source, source_size, n_docs): target, sid, and its block quota."""
    plan = cut(ranked(sizes).withColumns({"weight": F.col("sid") % 3 + 1, "most": F.col("source_size") * CAP}), "ranked")
    target = F.least(F.col("most").cast("double"), F.col("weight") * water_level(plan))
    plan = plan.withColumn("target", target).withColumn("q", block_quota(seed, block_words)("sid", "source_size", "target"))
    return plan.select("source", "source_size", "n_docs", "target", "sid", "q.*", F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int").alias("bucket"))


_QUOTA = StructType([StructField(c, LongType()) for c in ("block", "blocks", "epochs", "extra", "rest", "quota")])


def block_quota(seed: int, block_words: int):  # noqa: ANN201
    """Block length and number, whole passes, further blocks, words of one more block, draws in all."""

    def of(sid: int, size: int, target: float) -> tuple:
        if not size:
            return 1, 1, 0, 0, 0, 0
        blocks = max(1, size // block_words)
        block = -(-size // blocks)
        blocks = -(-size // block)
        epochs = min(CAP, int(target // size))
        words = min(size, round(target - epochs * size))
        extra = words // block
        short = blocks * block - size  # by so many words the last block is shorter
        last = int(permuted(np.array([blocks - 1]), blocks, _key(seed, sid, epochs))[0])
        rest = words - extra * block + (short if last < extra else 0)
        if rest >= block:
            extra, rest = extra + 1, rest - block + (short if last == extra else 0)
        return block, blocks, epochs, extra, rest, epochs * blocks + extra + (rest > 0)

    @pandas_udf(_QUOTA)
    def quota(sid: pd.Series, size: pd.Series, target: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(int(a), int(b), float(c)) for a, b, c in zip(sid, size, target, strict=True)], columns=_QUOTA.names, dtype="int64")

    return quota


def _key(seed: int, sid: int, epoch: int) -> int:
    return (seed * 1_000_003 + sid) * 8 + epoch


def with_shards(plan: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """plan with `upto`: for every shard, the draws of the source up to its last one."""
    totals = np.zeros(BUCKETS, dtype=np.int64)
    for r in plan.groupBy("bucket").agg(F.sum("quota").alias("q")).collect():  # BUCKETS rows at most
        totals[r.bucket] = r.q
    each, more = divmod(int(totals.sum()), n_shards)
    tree = split_tree(totals, np.array([each + (i < more) for i in range(n_shards)], dtype=np.int64), np.random.default_rng(seed))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        pdf = pdf.sort_values("sid")
        quotas = split_tree(pdf["quota"].to_numpy(np.int64), tree[:, b], np.random.default_rng([seed, b]))
        return pd.DataFrame({"sid": pdf["sid"].to_numpy(np.int64), "upto": list(np.cumsum(quotas, axis=0).T)})

    shares = plan.select("bucket", "sid", "quota").groupBy("bucket").applyInPandas(inside, "sid long, upto array<long>")
    return plan.drop("bucket").join(shares, "sid")


_DRAWS = StructType([StructField("taken", LongType())] + [StructField(c, ArrayType(IntegerType() if c in ("epoch", "shard") else LongType())) for c in DRAWS])


def drawn(seed: int):  # noqa: ANN201
    """The draws that touch a document at words [at, at + size) of its source's stream."""

    @pandas_udf(_DRAWS)
    def draws(at: pd.Series, size: pd.Series, sid: pd.Series, block: pd.Series, blocks: pd.Series, epochs: pd.Series, extra: pd.Series, rest: pd.Series, upto: pd.Series) -> pd.DataFrame:
        a, z = at.to_numpy(np.int64), at.to_numpy(np.int64) + size.to_numpy(np.int64)
        out = {c: [[]] * len(a) for c in DRAWS}
        taken = np.zeros(len(a), dtype=np.int64)
        for s, rows in sid.groupby(sid).indices.items():
            i = rows[0]
            length, n, whole, part = int(block.iat[i]), int(blocks.iat[i]), int(epochs.iat[i]), int(rest.iat[i])
            full = whole * n + int(extra.iat[i])
            rows = rows[z[rows] > a[rows]]
            first, last = a[rows] // length, (z[rows] - 1) // length
            row = np.repeat(rows, last - first + 1)
            b = np.repeat(first - np.concatenate([[0], np.cumsum(last - first + 1)[:-1]]), last - first + 1) + np.arange(len(row)) if len(rows) else row
            start, end = np.maximum(a[row], b * length) - a[row], np.minimum(z[row], (b + 1) * length) - a[row]
            found = []
            for k in range(whole + 1):
                draw = k * n + permuted(b, n, _key(seed, int(s), k))
                last = np.where(draw == full, np.minimum(end, b * length + part - a[row]), end)  # one block in part
                ok = (draw <= full) & (last > start)
                found.append(np.stack([row[ok], np.full(ok.sum(), k), draw[ok], np.searchsorted(upto.iat[i], draw[ok], side="right"), start[ok], (last - start)[ok]]))
            all_ = np.concatenate(found, axis=1)
            all_ = all_[:, np.lexsort((all_[4], all_[1], all_[0]))]
            np.add.at(taken, all_[0], all_[5])
            ids, begins = np.unique(all_[0], return_index=True)
            for c, values in zip(DRAWS, all_[1:], strict=True):
                for r, part in zip(ids, np.split(values, begins[1:]), strict=False):
                    out[c][r] = part
        return pd.DataFrame({"taken": taken, **out})

    return draws


def mix(docs: DataFrame, n_shards: int = 16, seed: int = 7, block_words: int = 512, keep_row: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and its
    draws: epoch, draw, shard, first and n are arrays that go together (words first to
    first + n of the document are drawn). keep_row adds the input row as `row`."""
    whole = keyed(docs, "rows")
    text, doc_id = F.col("row.text"), F.col("row.doc_id")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = whole.select("uid", doc_id.alias("doc_id"), F.col("row.source").alias("source"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(F.lit(seed), doc_id, text).alias("order"))
    rows = cut(rows.withColumn("key", key), "mix")
    plan = cut(source_plan(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), seed, block_words), "plan")
    plan = cut(with_shards(plan, n_shards, seed).withColumn("key", key).drop("source"), "plan")
    placed = running(met(rows, plan, "key", "n_docs"), "sid", "n_docs", ["order", "doc_id", "uid"], "at", F.col("size"))
    found = placed.withColumn("d", drawn(seed)("at", "size", "sid", "block", "blocks", "epochs", "extra", "rest", "upto"))
    found = found.select("uid", "doc_id", "source", "size", "source_size", "target", "d.*")
    return found.join(whole, "uid").drop("uid") if keep_row else found.drop("uid")


def shards(mixed: DataFrame, n_shards: int = 16, seed: int = 7) -> DataFrame:
    """One row per drawn piece, dealt to its shard and shuffled inside it by a hash."""
    pieces = mixed.select("doc_id", F.inline(F.arrays_zip(*DRAWS)))
    order = F.xxhash64(F.lit(seed), "shard", "draw", "doc_id", "first")
    return pieces.withColumn("order", order).repartitionByRange(n_shards * 4, "shard", "order").sortWithinPartitions("shard", "order")


@pandas_udf(ArrayType(StringType()))
def pieces(text: pd.Series, epoch: pd.Series, first: pd.Series, n: pd.Series) -> pd.Series:
    """The texts of a document's draws: adjoining pieces of one pass are joined."""
    spaced = re.compile(WORD)

    def of(t: str, ks: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[str]:
        runs: list[list[int]] = []
        for k, a, m in zip(ks, starts, lengths, strict=True):
            if runs and runs[-1][0] == k and runs[-1][2] == a:
                runs[-1][2] = a + m
            else:
                runs.append([k, a, a + m])
        if not runs:
            return []
        at = [m.span() for m in spaced.finditer(t)]
        return [t if (a, z) == (0, len(at)) else t[at[a][0] : at[z - 1][1]] for _, a, z in runs]

    return pd.Series([of(*x) for x in zip(text, epoch, first, n, strict=True)])


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix as rows with the columns of docs: a document once for every run of its
    words that one pass draws, with those words as its text (whole passes: the whole
    text) and their length as n_chars."""
    found = mix(docs, seed=seed, keep_row=True).filter(F.size("epoch") > 0)
    each = found.select("row", F.explode(pieces(F.col("row.text"), "epoch", "first", "n")).alias("piece"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("piece")
        return F.length("piece").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"row.`{c}`")

    return each.select(*[column(c).alias(c) for c in docs.columns])
