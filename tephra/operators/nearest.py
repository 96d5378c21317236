"""Nearest-neighbour anomaly scores, patch maps, heatmaps and clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import levels
from ..functions.rounding import rounded
from ..sources.work import written
from .graph import merged
from .quantiles import quantiles

BLOCK_BYTES = 16_000_000
#: Distances that a task holds at once.
AT_ONCE = 1 << 20
#: At most so many pivots stand for the memory bank; they are the only vectors that pass the driver.
MOST_PIVOTS = 1024


def pivots_of(bank: DataFrame, most: int = MOST_PIVOTS) -> np.ndarray:
    """About as many vectors of bank(features) as the root of its rows, by the lowest hashes, as rows of a matrix."""
    n = min(most, max(1, math.isqrt(bank.count())))
    rows = bank.select("features", F.xxhash64("features").alias("h")).orderBy("h", "features").limit(n).collect()  # n is bounded
    return np.unique(np.array([r.features for r in rows], dtype=np.float64), axis=0)


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of two matrices."""
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def celled(vectors: DataFrame, pivots: np.ndarray, keep: list[str], empty: tuple[int, ...] = ()) -> DataFrame:
    """keep, features, cell (the nearest pivot that is not `empty`) and far (its distance)."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for part in parts_of(pdf, len(pivots)):
                d = gaps(matrix(part["features"]), pivots)
                d[:, list(empty)] = np.inf
                yield part.assign(cell=d.argmin(axis=1).astype(np.int32), far=d.min(axis=1))

    return vectors.select(*keep, "features").mapInPandas(run, f"{kinds_of(vectors, [*keep, 'features'])}cell int, far double")


def kinds_of(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in columns)


def parts_of(pdf: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """The rows of a batch, so many at once that their distances to `width` vectors are at most AT_ONCE."""
    step = max(1, AT_ONCE // max(1, width))
    for i in range(0, len(pdf), step):
        yield pdf.iloc[i : i + step]


def packed(sizes: dict[int, int], most: int) -> dict[int, int]:
    """A block for each cell: neighbours by number share one, as long as it holds at most so many vectors."""
    out, block, held = {}, 0, 0
    for cell, n in sorted(sizes.items()):
        if held and held + n > most:
            block, held = block + 1, 0
        out[cell], held = block, held + n
    return out


def in_blocks(pdf: pd.DataFrame, row: np.ndarray, cell: np.ndarray, blocks: dict[int, int], columns: list[str]) -> Iterator[pd.DataFrame]:
    """columns, block, cells: one row for each row of pdf and block, with the cells of that block that row[k] asks: cell[k]."""
    known = np.full(max([*blocks, *cell.tolist()], default=0) + 1, -1, dtype=np.int32)
    known[list(blocks)] = list(blocks.values())
    row, cell = row[known[cell] >= 0], cell[known[cell] >= 0]
    order = np.lexsort((cell, known[cell], row))
    row, cell, block = row[order], cell[order].astype(np.int32), known[cell[order]]
    starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(block) != 0)][: len(row)])
    lists = np.split(cell, starts[1:]) if len(starts) else []
    for i in range(0, len(starts), 8192):
        at = starts[i : i + 8192]
        yield pdf[columns].iloc[row[at]].assign(block=block[at], cells=lists[i : i + 8192])


def further_cells(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, keep: list[str], blocks: dict[int, int]) -> DataFrame:
    """keep, features, block, cells: the cells besides its own that can hold a vector nearer than `distance` to a query, by block.

    A vector of a cell is at least as far as the pivot less the radius, and as the plane between the
    pivots of the cell and of the query. Cells without vectors have radius -1."""
    between = gaps(pivots, pivots)

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for part in parts_of(pdf, len(pivots)):
                q = matrix(part["features"])
                d, own, best = gaps(q, pivots), part["cell"].to_numpy(), part["distance"].to_numpy()[:, None]
                mine = d[np.arange(len(q)), own][:, None]
                apart = np.where(between[own] > 0, between[own], np.inf)
                bound = np.maximum(d - radius, (d**2 - mine**2) / (2 * apart))
                slack = 1e-6 * (1 + np.abs(q).max(axis=1))[:, None]  # for rounding
                ask = (bound <= best + slack) & (radius >= 0) & (np.arange(len(pivots)) != own[:, None])
                yield from in_blocks(part, *np.nonzero(ask), blocks, [*keep, "features"])

    return queries.mapInPandas(run, f"{kinds_of(queries, [*keep, 'features'])}block int, cells array<int>")


def nearest_in_cells(q: np.ndarray, asks: list[np.ndarray], c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The distance of each query to the nearest of the vectors c whose cell (own) is among those it asks; infinite without any."""
    best = np.full(len(q), np.inf)
    order = np.argsort(own, kind="stable")
    c, own = c[order], own[order]
    row, cell = np.repeat(np.arange(len(q)), [len(x) for x in asks]), np.concatenate([*asks, np.zeros(0, dtype=np.int32)])
    by = np.argsort(cell, kind="stable")
    row, cell = row[by], cell[by]
    side = math.isqrt(AT_ONCE)
    for x in np.unique(own):
        rows, (a, b) = row[np.searchsorted(cell, x) : np.searchsorted(cell, x, "right")], np.searchsorted(own, [x, x + 1])
        for i in range(0, len(rows), side):
            some = rows[i : i + side]
            for j in range(a, b, side):
                best[some] = np.minimum(best[some], gaps(q[some], c[j : min(b, j + side)]).min(axis=1))
    return best


def met_in_cells(asked: DataFrame, bank: DataFrame, sizes: dict[int, int], blocks: dict[int, int], keep: list[str], dims: int) -> DataFrame:
    """keep, distance: of asked(keep, features, block, cells), a written table, to the nearest vector of bank(cell, features) in those cells.

    A block holds whole cells, so a query is sent once to each block and not to each cell. Large cells are cut into pieces and many
    queries of a block into shares; each group is one share and one piece."""
    per_block = max(1, BLOCK_BYTES // (8 * dims))
    asks = {r.block: r["count"] for r in asked.groupBy("block").count().collect()}  # one row per cell at most
    held: dict[int, int] = {}
    for c, n in sizes.items():
        held[blocks[c]] = held.get(blocks[c], 0) + n
    spark, count = asked.sparkSession, lambda n: -(-n // per_block)
    plan = F.broadcast(spark.createDataFrame([(k, count(asks[k]), count(held[k])) for k in asks], "block int, shares int, pieces int"))
    places = F.broadcast(spark.createDataFrame(list(blocks.items()), "cell int, block int"))
    dealt = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(plan, "block").select(*keep, "features", "cells", "block", dealt("shares", *keep).alias("share"), each("pieces").alias("piece"))
    right = bank.join(places, "cell").join(plan, "block").select("block", "cell", "features", each("shares").alias("share"), dealt("pieces", "features").alias("piece"))

    def near(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        return queries[keep].assign(distance=nearest_in_cells(matrix(queries["features"]), queries["cells"].tolist(), matrix(vectors["features"]), vectors["cell"].to_numpy()))

    by = ["block", "share", "piece"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(near, f"{kinds_of(asked, keep)}distance double")


def distances(queries: DataFrame, coreset: DataFrame, keep: list[str], dims: int) -> DataFrame:
    """keep columns of queries, which name a query, and `distance` to the nearest vector of coreset(features).

    Pivots of the coreset cut it into cells. A query first meets the cell of its nearest pivot; what it
    finds there bounds its distance, and of the other cells it meets only those that the triangle inequality
    leaves. So a query meets few vectors where these lie in clusters, and never one cell twice. It is sent once to each block
    of cells, so that where no cell is left out it is sent as often as the bank has blocks."""
    if not coreset.head(1):
        return queries.select(*keep, F.lit(None).cast("double").alias("distance"))
    pivots = pivots_of(coreset)
    bank = written(celled(coreset, pivots, []), "bank")
    stats = {r.cell: r for r in bank.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # one row per pivot at most
    sizes, radius = {c: r.n for c, r in stats.items()}, np.array([stats[c].far if c in stats else -1.0 for c in range(len(pivots))])
    blocks = packed(sizes, max(1, BLOCK_BYTES // (8 * dims)))
    own = written(celled(queries, pivots, keep, tuple(np.flatnonzero(radius < 0).tolist())), "queries")
    places = F.broadcast(own.sparkSession.createDataFrame(list(blocks.items()), "cell int, block int"))
    first = met_in_cells(own.join(places, "cell").withColumn("cells", F.array("cell")), bank, sizes, blocks, keep, dims)
    first = written(own.select(*keep, "features", "cell").join(first.groupBy(*keep).agg(F.min("distance").alias("distance")), keep), "first")
    more = met_in_cells(written(further_cells(first, pivots, radius, keep, blocks), "asked"), bank, sizes, blocks, keep, dims)
    return first.select(*keep, "distance").union(more).groupBy(*keep).agg(F.min("distance").alias("distance"))


def probed(queries: DataFrame, bank: DataFrame, keep: list[str], dims: int, tables: int = 24, bits: int = 6, seed: int = 42) -> DataFrame:
    """Like distances(), approximately: of the vectors that share a bucket with the query in any of the tables.

    A bucket is given by the signs of `bits` random projections; a query also probes the buckets next to its own, across
    the projection that it is nearest to and the second nearest. Candidates are ranked by their exact distance. A query without any has an infinite one.
    A bucket is one cell of met_in_cells, so buckets of any size are cut into pieces."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
    middle = bank.select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).collect()  # dims rows
    centre = np.array([v for _, v in sorted((r.i, r.v) for r in middle)] or [0.0] * dims)

    def buckets(x: np.ndarray, t: int, probes: int) -> list[np.ndarray]:
        """The buckets of the rows of x in one table."""
        side = x @ planes[t].T
        code = t * 2**bits + (side > 0) @ (1 << np.arange(bits))
        close = np.argsort(np.abs(side), axis=1)
        return [code, *[code ^ (1 << close[:, k]) for k in range(probes)]]

    def indexed(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf["features"]) - centre
                for t in range(tables):
                    yield pdf.assign(cell=buckets(x, t, 0)[0].astype(np.int32))

    held = written(bank.select("features").mapInPandas(indexed, f"{kinds_of(bank, ['features'])}cell int"), "buckets")
    sizes = {r.cell: r["count"] for r in held.groupBy("cell").count().collect()}  # one row per bucket, of which there are tables * 2 ** bits
    blocks = packed(sizes, max(1, BLOCK_BYTES // (8 * dims)))

    def asking(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for part in parts_of(pdf, 3 * tables):
                x = matrix(part["features"]) - centre
                cell = np.concatenate([c for t in range(tables) for c in buckets(x, t, 2)])
                yield from in_blocks(part, np.tile(np.arange(len(part)), 3 * tables), cell, blocks, [*keep, "features"])

    asked = queries.select(*keep, "features").mapInPandas(asking, f"{kinds_of(queries, [*keep, 'features'])}block int, cells array<int>")
    found = met_in_cells(written(asked, "probes"), held, sizes, blocks, keep, dims)
    none = queries.select(*keep, F.lit(float("inf")).alias("distance"))
    return none.union(found).groupBy(*keep).agg(F.min("distance").alias("distance"))


def greedy_order(vectors: np.ndarray) -> np.ndarray:
    """Farthest-first traversal from the first vector: how far each was from those taken before it; 1e300 for the first."""
    out, left = np.full(len(vectors), 1e300), gaps(vectors, vectors[:1])[:, 0]
    for _ in range(1, len(vectors)):
        k = int(left.argmax())
        out[k], left[k] = left[k], -1.0
        near = np.sqrt(np.maximum(((vectors - vectors[k]) ** 2).sum(axis=1), 0))
        left = np.where(left < 0, left, np.minimum(left, near))
    return out


def greedy_coreset(vectors: DataFrame, key: str, share: float = 0.15, least: int = 500, piece: int = 2000) -> DataFrame:
    """The rows of vectors(key, features) that a greedy k-center selection takes: so large a share, at least `least`.

    Every cell of a pivot, in pieces of some `piece` vectors, is traversed farthest first, which says for each vector
    how far it is from those before it. The k rows that are farthest are taken over all cells, so the cells are cut at one
    radius, within which every row has a taken one. Rows that are just as far as the last one are taken too."""
    total = vectors.count()
    k = min(total, max(least, math.floor(share * total)))
    if not k:
        return vectors.limit(0)
    cells = written(celled(vectors, pivots_of(vectors), [key]), "cells")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # one row per pivot at most
    dealt = cells.join(F.broadcast(sizes), "cell").withColumn("piece", F.pmod(F.xxhash64(key), F.ceil(F.col("n") / piece)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["far", key])
        return pd.DataFrame({key: pdf[key], "ahead": greedy_order(matrix(pdf["features"]))})

    ahead = written(dealt.groupBy("cell", "piece").applyInPandas(run, f"{key} {vectors.schema[key].dataType.simpleString()}, ahead double"), "ahead")
    if k == total:
        return vectors
    # between the k-th and the next value, from counts of distinct values in slices
    radius = quantiles(ahead, "ahead", [], {"radius": (total - k - 0.5) / (total - 1)}).first().radius
    return vectors.join(ahead.filter(F.col("ahead") >= radius).select(key), key, "left_semi")


def score_all(images: DataFrame, scores: DataFrame, old: str, test_year: int = 2018) -> DataFrame:
    """split, image_id, year, score of images(image_id, year, quality_flag) and scored_of_year, the
    scored images of a split and year. `test` scores the usable images of the test year, `all` those
    that are usable, dark or without a flag; `unfitted` takes the old score."""
    joined = images.join(scores, "image_id")
    usable_, year = F.col("quality_flag") == "usable", F.col("year") == test_year
    of = {"test": F.when(year & usable_, F.col("score")), "all": F.when(F.col("quality_flag").isin("usable", "dark") | F.col("quality_flag").isNull(), F.col("score")), "unfitted": F.col(old)}
    each = joined.select("image_id", "year", F.inline(F.array(*[F.struct(F.lit(k).alias("split"), v.alias("score")) for k, v in of.items()])))
    counts = each.groupBy("split", "year").agg(F.count("score").alias("scored_of_year"))
    return each.join(counts, ["split", "year"]).select("split", "image_id", "year", "score", "scored_of_year")


def usable(features: DataFrame) -> DataFrame:
    """Without vectors of zeros only."""
    return features.filter(F.exists("features", lambda x: x != 0))


def scaled(df: DataFrame, value: str, by: str) -> DataFrame:
    """`norm`: min-max inside each group, 0 where all values are equal."""
    w = W.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("norm", F.when(high - low < 1e-12, 0.0).otherwise((F.col(value) - low) / (high - low)))


def patch_metadata(maps: DataFrame, width: int) -> DataFrame:
    """Row, column, rounded score, level and rank of every patch of maps(image_id, patch_id, norm)."""
    s = rounded("norm", 5)
    rank = F.rank().over(W.partitionBy("image_id").orderBy(F.desc(s)))
    return maps.select("image_id", "patch_id", F.floor(F.col("patch_id") / width).cast("int").alias("row"), (F.col("patch_id") % width).alias("col"), s.alias("score"), levels.anomaly_level(F.col("norm")).alias("level"), rank.alias("rank"))


def zone_metrics(maps: DataFrame, width: int, threshold: float = 0.7) -> DataFrame:
    """Active share, centroid (the middle without any), maximum and count per image."""
    on = F.col("norm") > threshold
    x, y = F.col("patch_id") % width, F.floor(F.col("patch_id") / width)
    middle = lambda c: F.coalesce(F.avg(F.when(on, c)) / width, F.lit(0.5))
    return maps.groupBy("image_id").agg((100 * F.count_if(on) / F.count(F.lit(1))).alias("active_percent"), middle(x).alias("centroid_x"), middle(y).alias("centroid_y"), F.max("norm").alias("highest"), F.count_if(on).alias("n_active"))


def weight_parts(row, col, exp=np.exp, sqrt=np.sqrt):  # noqa: ANN001, ANN201
    """Crater, ring around it and slope at places of the unit square, as arrays or (with Spark's functions) columns."""
    crater = exp(-((row - 0.4) * (row - 0.4) + (col - 0.5) * (col - 0.5)) / (2 * 0.25**2))
    off = sqrt((row - 0.5) * (row - 0.5) + (col - 0.5) * (col - 0.5)) - 0.3
    return crater, exp(-off * off / (2 * 0.15**2)), exp(-(row - 0.75) * (row - 0.75) / (2 * 0.2**2))


def weight(row: Column, col: Column) -> Column:
    """Where activity is to be expected: crater, ring around it and slope, by the features."""
    crater, ring, slope = weight_parts(row, col, F.exp, F.sqrt)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return crater * (0.4 + 0.6 * z("thermal_gradient")) + ring * z("edge_density") + slope * (z("bright_zone_area") + z("bright_pixel_ratio")) + 0.1


def heatmap(df: DataFrame, score: str, by: list[str], size: int = 16) -> DataFrame:
    """A size x size grid per group: mean and sum of weight times score, each scaled to its maximum.

    The weight is linear in the features, so the sums of score times feature are
    aggregated first and the grid is built from one row per group."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = F.col(score)
    used = df.filter(s.isNotNull() & (s != 0))
    sums = used.groupBy(*by).agg(F.sum(s).alias("_s"), F.count(F.lit(1)).alias("_n"), F.sum(s * z("thermal_gradient")).alias("thermal_gradient"), F.sum(s * z("edge_density")).alias("edge_density"), F.sum(s * z("bright_zone_area")).alias("bright_zone_area"), F.sum(s * z("bright_pixel_ratio")).alias("bright_pixel_ratio"))
    # dividing by the sum of scores gives mean features, for which the weight is taken once
    mean = sums.withColumns({c: F.col(c) / F.col("_s") for c in ("thermal_gradient", "edge_density", "bright_zone_area", "bright_pixel_ratio")})
    grid = mean.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    total = weight(F.col("row") / (size - 1), F.col("col") / (size - 1)) * F.col("_s")
    raw = grid.select(*by, "row", "col", total.alias("sum"), (total / F.col("_n")).alias("mean"))
    top = lambda c: F.max(c).over(W.partitionBy(*by))
    return raw.select(*by, "row", "col", *[F.when(top(c) > 0, F.col(c) / top(c)).otherwise(F.col(c)).alias(c) for c in ("mean", "sum")])


def heatmap_max(df: DataFrame, score: str, by: list[str], size: int = 16) -> DataFrame:
    """The grid of the greatest weight times score of any image, scaled to its maximum.

    It is no sum over features, so every image meets every cell: the weight is a product of four numbers of an image with four of a
    cell, and each Arrow batch gives one row of maxima for each of its groups. No cell of an image becomes a row."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    s = F.col(score)
    used = df.filter(s.isNotNull() & (s != 0)).select(*by, s.cast("double").alias("_s"), *map(z, ("thermal_gradient", "edge_density", "bright_zone_area", "bright_pixel_ratio")))
    at = np.arange(size) / (size - 1)
    crater, ring, slope = (np.ravel(x) for x in np.broadcast_arrays(*weight_parts(at[:, None], at[None, :])))
    cell = np.stack([0.4 * crater + 0.1, 0.6 * crater, ring, slope])

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            if not len(pdf):
                continue
            group = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
            score_ = pdf["_s"].to_numpy()
            image = np.stack([score_, score_ * pdf["thermal_gradient"], score_ * pdf["edge_density"], score_ * (pdf["bright_zone_area"] + pdf["bright_pixel_ratio"])], axis=1)
            out = pdf[by].iloc[order[first]].reset_index(drop=True)
            out["top"] = list(np.maximum.reduceat((image @ cell)[order], first, axis=0))
            yield out

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    tops = used.mapInPandas(run, f"{kinds}, top array<double>").select(*by, F.posexplode("top").alias("at", "v"))
    tops = tops.groupBy(*by, "at").agg(F.max("v").alias("v"))
    return tops.select(*by, F.floor(F.col("at") / size).cast("int").alias("row"), (F.col("at") % size).alias("col"), (F.col("v") / F.max("v").over(W.partitionBy(*by))).alias("max"))


def labelled(value: np.ndarray, threshold: float) -> np.ndarray:
    """For cells at or over the threshold the smallest position (by rows) in their 4-connected group; for others the number of cells."""
    on = value >= threshold
    label = np.where(on, np.arange(on.size).reshape(on.shape), on.size)
    while True:
        framed = np.pad(label, 1, constant_values=on.size)
        near = np.minimum.reduce([label, framed[:-2, 1:-1], framed[2:, 1:-1], framed[1:-1, :-2], framed[1:-1, 2:]])
        after = np.where(on, near, on.size)
        after = np.where(on, np.minimum(after, np.r_[after.ravel(), on.size][after]), on.size)  # a label may point on
        if (after == label).all():
            return label
        label = after


def clusters(grid: DataFrame, by: str, threshold: float = 0.5, least: int = 2, tile: int = 64) -> DataFrame:
    """4-connected groups of cells at or over the threshold: centroid, mean, size, bounds, and rank by score (ties: the first cell by rows).

    Cells are labelled in tiles of tile x tile cells, each a task's group, whatever the size of a grid. A tile gives one row for each of its
    groups: sums, bounds and the seams (sides between two tiles) that it touches. Two groups that touch one seam are linked, and the
    classes of links are merged; a grid of one tile has none."""

    def of(cells: pa.Table) -> pa.Table:
        row, col, value = (cells.column(c).to_numpy() for c in ("row", "col", "value"))
        up, left = row[0] // tile * tile, col[0] // tile * tile
        y, x = row.min(), col.min()  # no more than the active part of the tile is labelled
        grid_ = np.full((row.max() - y + 1, col.max() - x + 1), -np.inf)
        grid_[row - y, col - x] = value  # a cell has one value
        rows, cols = np.nonzero(grid_ >= threshold)
        label, at = np.unique(labelled(grid_, threshold)[rows, cols], return_inverse=True)
        values, width = grid_[rows, cols], grid_.shape[1]
        rows, cols = rows + y, cols + x
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        each = lambda f, v: f.reduceat(v[order], starts)
        seams: list[list] = [[] for _ in label]
        for side, on in ((0, rows == up), (1, cols == left), (2, rows == up + tile - 1), (3, cols == left + tile - 1)):  # a seam is named by the cell below or to the right of it
            for k, r, c in zip(at[on].tolist(), rows[on].tolist(), cols[on].tolist(), strict=True):
                seams[k].append({"side": side % 2, "row": r + (side == 2), "col": c + (side == 3)})
        found = [(label // width + y) * (1 << 31) + label % width + x, np.diff(np.r_[starts, len(at)]), each(np.add, rows), each(np.add, cols), each(np.add, values), each(np.minimum, rows), each(np.maximum, rows), each(np.minimum, cols), each(np.maximum, cols), seams]
        whose = pa.array(cells.column(by)[:1].to_pylist() * len(label), cells.schema.field(by).type)
        return pa.table([whose, *map(pa.array, found[:-1], kinds[:-1]), pa.array(seams, kinds[-1])], names=[by, *names])

    kind = grid.schema[by].dataType.simpleString()
    on = grid.filter((F.col("value") >= threshold) & ~F.isnan("value"))
    on = on.select(by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"), F.floor(F.col("row") / tile).alias("_y"), F.floor(F.col("col") / tile).alias("_x"))
    names = ["label", "n", "rows", "cols", "total", "row_min", "row_max", "col_min", "col_max", "seams"]
    kinds = [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.int32()] * 4 + [pa.list_(pa.struct([("side", pa.int32()), ("row", pa.int64()), ("col", pa.int64())]))]
    fields = "label long, n long, rows double, cols double, total double, row_min int, row_max int, col_min int, col_max int, seams array<struct<side: int, row: long, col: long>>"
    parts = written(on.groupBy(by, "_y", "_x").applyInArrow(of, f"`{by}` {kind}, {fields}"), "tiles")
    seams = parts.select(by, "label", F.explode("seams").alias("seam")).groupBy(by, "seam").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n"))
    roots = merged(seams.filter("n > 1"), by)
    same = F.col("p.label").eqNullSafe(F.col("r.label")) & F.col(f"p.{by}").eqNullSafe(F.col(f"r.{by}"))
    rooted = parts.alias("p").join(roots.alias("r"), same, "left").select("p.*", F.coalesce("root", "p.label").alias("first"))
    n = F.sum("n")
    whole = rooted.groupBy(by, "first").agg(
        (F.sum("rows") / n).alias("centroid_row"), (F.sum("cols") / n).alias("centroid_col"), (F.sum("total") / n).alias("score"), n.cast("int").alias("size"),
        F.min("row_min").alias("row_min"), F.max("row_max").alias("row_max"), F.min("col_min").alias("col_min"), F.max("col_max").alias("col_max"))
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "first"))
    return whole.filter(F.col("size") >= least).withColumn("rank", rank).drop("first")
