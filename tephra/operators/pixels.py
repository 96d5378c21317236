"""Pixel kernels as relational plans over (image_id, x, y, v), and frame-to-frame scores.

Neighbours come from shifting rows: a pixel is sent to the places where it is
needed and the contributions are summed, so one shuffle by (image, y, x) replaces
windows over whole images.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stats(px: DataFrame) -> DataFrame:
    v = F.col("v")
    return px.groupBy("image_id").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("variance"), F.min(v).alias("low"), F.max(v).alias("high"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def level(v: Column) -> Column:
    """A value of [0, 1] as a gray level."""
    return F.floor(v * 255).cast("int")


def entropy(px: DataFrame) -> DataFrame:
    """Shannon entropy in bits of the gray levels."""
    counts = px.groupBy("image_id", level(F.col("v")).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    # -sum p log2 p = log2 n - sum c log2 c / n
    return counts.groupBy("image_id").agg((F.log2(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / F.sum("c")).alias("entropy"))


def bright_share(px: DataFrame, *above: int) -> DataFrame:
    g = level(F.col("v"))
    return px.groupBy("image_id").agg(*[F.avg(F.when(g > t, 1.0).otherwise(0.0)).alias(f"above_{t}") for t in above])


def night_score(px: DataFrame, dark: float = 30 / 255, bright: float = 60 / 255) -> DataFrame:
    return px.groupBy("image_id").agg(F.when(F.avg("v") >= dark, 0.0).otherwise(F.avg(F.when(F.col("v") > bright, 1.0).otherwise(0.0))).alias("night_score"))


def gathered(px: DataFrame, taps: dict[str, dict[tuple[int, int], float]], keep: tuple[str, ...] = ("v",)) -> DataFrame:
    """For every interior pixel the weighted sums of its neighbours, one column per kernel.

    Each pixel is sent to those places whose kernels use it."""
    places = sorted({p for k in taps.values() for p in k} | {(0, 0)})
    sent = F.explode(F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), *[F.lit(float(k.get((dx, dy), 0.0))).alias(n) for n, k in taps.items()]) for dx, dy in places]))
    each = px.withColumn("t", sent)
    at = each.groupBy("image_id", (F.col("x") + F.col("t.dx")).alias("x"), (F.col("y") + F.col("t.dy")).alias("y"))
    here = (F.col("t.dx") == 0) & (F.col("t.dy") == 0)
    out = at.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col("v") * F.col(f"t.{n}")).alias(n) for n in taps], *[F.max(F.when(here, F.col(c))).alias(c) for c in keep])
    return out.filter(F.col("_n") == len(places)).drop("_n")


#: The derivative kernels.
SOBEL = {"gx": {(1, -1): 1, (1, 0): 2, (1, 1): 1, (-1, -1): -1, (-1, 0): -2, (-1, 1): -1}, "gy": {(-1, 1): 1, (0, 1): 2, (1, 1): 1, (-1, -1): -1, (0, -1): -2, (1, -1): -1}}
LAPLACE = {"lap": {(1, 0): 1, (-1, 0): 1, (0, 1): 1, (0, -1): 1, (0, 0): -4}}
DIFFERENCE = {"gx": {(1, 0): 1, (-1, 0): -1}, "gy": {(0, 1): 1, (0, -1): -1}}


def thermal_gradient(px: DataFrame, scale: float = 1448.0) -> DataFrame:
    mag = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return gathered(px, SOBEL).groupBy("image_id").agg((F.avg(mag) / scale).alias("thermal_gradient"))


def texture_roughness(px: DataFrame, scale: float = 255.0) -> DataFrame:
    return gathered(px, LAPLACE).groupBy("image_id").agg((F.stddev_pop("lap") / scale).alias("texture_roughness"))


def edge_density(px: DataFrame, low: float = 0.1, high: float = 0.3, scale: float = 510.0) -> DataFrame:
    """Interior pixels over the low threshold that are, or touch, one over the high threshold."""
    mag = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / scale
    g = gathered(px, DIFFERENCE).select("image_id", "x", "y", mag.alias("m"))
    spread = g.select("image_id", F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("m") > high).alias("strong"), F.lit(dx == dy == 0).alias("here"), F.col("m")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])).alias("t"))
    at = spread.groupBy("image_id", "t.x", "t.y").agg(F.max("t.strong").alias("near"), F.max(F.when(F.col("t.here"), F.col("t.m"))).alias("m")).filter("m is not null")
    return at.groupBy("image_id").agg(F.avg(F.when((F.col("m") > low) & F.col("near"), 1.0).otherwise(0.0)).alias("edge_density"))


def frame_pairs(px: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pixels of image_id and of prev_id, for pairs(image_id, prev_id)."""
    now = px.join(pairs, "image_id")
    before = px.select(F.col("image_id").alias("prev_id"), "x", "y", F.col("v").alias("w"))
    return now.join(before, ["prev_id", "x", "y"])


def mad(both: DataFrame) -> DataFrame:
    """Mean, greatest and 95th percentile of the absolute differences; change against the spread of the earlier frame."""
    d = F.abs(F.col("v") - F.col("w"))
    return both.groupBy("image_id", "prev_id").agg(F.avg(d).alias("mad"), F.max(d).alias("most"), F.percentile(d, F.lit(0.95)).alias("p95"), (F.avg(d) / (1 + F.stddev_pop("w") + 1e-6)).alias("temporal_change"))


def ssim(both: DataFrame, window: int = 7) -> DataFrame:
    """1 - mean structural similarity: uniform windows, sample covariance, the larger range of the two frames.

    Window sums come in two passes, along x and then along y."""
    half, n = window // 2, window * window
    moments = {"s_v": F.col("v"), "s_w": F.col("w"), "s_vv": F.col("v") * F.col("v"), "s_ww": F.col("w") * F.col("w"), "s_vw": F.col("v") * F.col("w")}
    rng = both.groupBy("image_id", "prev_id").agg(F.greatest(F.max("v") - F.min("v"), F.max("w") - F.min("w")).alias("r"))
    sums = both.select("image_id", "prev_id", "x", "y", *[c.alias(k) for k, c in moments.items()])
    for axis in ("x", "y"):
        moved = sums.withColumn("_d", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn(axis, F.col(axis) + F.col("_d"))
        sums = moved.groupBy("image_id", "prev_id", "x", "y").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(k).alias(k) for k in moments]).filter(F.col("_n") == window).drop("_n")
    m, k = {c: F.col(c) / n for c in moments}, n / (n - 1)
    r = F.when(F.col("r") < 1e-8, 1.0).otherwise(F.col("r"))
    c1, c2 = (0.01 * r) * (0.01 * r), (0.03 * r) * (0.03 * r)
    var_v, var_w, cov = k * (m["s_vv"] - m["s_v"] * m["s_v"]), k * (m["s_ww"] - m["s_w"] * m["s_w"]), k * (m["s_vw"] - m["s_v"] * m["s_w"])
    one = (2 * m["s_v"] * m["s_w"] + c1) * (2 * cov + c2) / ((m["s_v"] * m["s_v"] + m["s_w"] * m["s_w"] + c1) * (var_v + var_w + c2))
    return sums.join(rng, ["image_id", "prev_id"]).groupBy("image_id", "prev_id").agg((1 - F.avg(one)).alias("ssim_distance"))


def normalised(px: DataFrame, how: str = "minmax") -> DataFrame:
    """Pixels scaled inside each image (a flat image gives 0), and as gray levels."""
    of = px.groupBy("image_id").agg(F.min("v").alias("_a"), F.max("v").alias("_z"), F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    flat = F.col("_z") - F.col("_a") < 1e-6
    scaled = (F.col("v") - F.col("_a")) / (F.col("_z") - F.col("_a")) if how == "minmax" else (F.col("v") - F.col("_m")) / F.col("_s")
    return px.join(of, "image_id").withColumn("norm", F.when(flat, 0.0).otherwise(scaled)).withColumn("gray", level(F.col("norm"))).drop("_a", "_z", "_m", "_s")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stretched(values: Column, low: Column, high: Column, flat: float | None = 0.0) -> Column:
    """An array by its own range: bounds are computed once for each array. `flat` takes the place of all values of one without a range."""
    span = lambda b: F.transform(values, lambda x: F.when(b["z"] - b["a"] < 1e-6, F.lit(flat)).otherwise(F.try_divide(x - b["a"], b["z"] - b["a"])))
    return let(F.struct(low.alias("a"), high.alias("z")), span)


def exploded(frames: DataFrame, value: str, width: Column) -> DataFrame:
    """image_id, x, y, v of an array by rows: pixels without a shuffle."""
    at = frames.select("image_id", width.alias("_w"), F.posexplode(value).alias("_p", "v"))
    return at.select("image_id", (F.col("_p") % F.col("_w")).alias("x"), F.floor(F.col("_p") / F.col("_w")).cast("int").alias("y"), "v")


def crop(px: DataFrame, x_min: int | None = None, x_max: int | None = None, y_min: int | None = None, y_max: int | None = None) -> DataFrame:
    """Pixels inside the bounds with the origin moved there; without all four bounds the whole image."""
    if None in (x_min, x_max, y_min, y_max):
        return px
    inside = F.col("x").between(x_min, x_max - 1) & F.col("y").between(y_min, y_max - 1)
    return px.filter(inside).withColumns({"x": F.col("x") - x_min, "y": F.col("y") - y_min})


def previous_in_month(frames: DataFrame) -> DataFrame:
    """Every readable frame with the readable one before it in its month. Days are ordered
    apart; the first frame of a day takes the last one of the latest earlier day."""
    ok = frames.filter("readable")
    month, order = ["camera", "year", "month"], ["hour", "minute", "filename", "image_id"]
    inside = ok.withColumn("prev_id", F.lag("image_id").over(W.partitionBy(*month, "day").orderBy(*order)))
    ends = ok.groupBy(*month, "day").agg(F.max_by("image_id", F.struct(*order)).alias("_end"))
    carried = ends.withColumn("_end", F.lag("_end").over(W.partitionBy(*month).orderBy("day")))  # one row a day
    carried = carried.select(*[F.col(c).alias(f"_{c}") for c in (*month, "day")], "_end")
    same = F.lit(True)
    for c in (*month, "day"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return inside.join(carried, same, "left").withColumn("prev_id", F.coalesce("prev_id", "_end")).select(*frames.columns, "prev_id")


def previous_in_gap(frames: DataFrame, minutes: int = 20) -> DataFrame:
    """Every frame with the row before it of the same camera, if that is recent enough.

    Time is cut into slices as long as the gap, and a row is also shown to the next
    slice: the row before, if recent enough, is then in the same slice."""
    gap = minutes * 60
    cut = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at")) / gap)
    shown = frames.withColumn("_t", F.explode(F.array(*[F.struct((cut + d).alias("cut"), F.lit(bool(d)).alias("ghost")) for d in (0, 1)])))
    by = W.partitionBy("camera", "_t.cut").orderBy("at", "image_id")
    out = shown.withColumns({"prev_id": F.lag("image_id").over(by), "_before": F.lag("at").over(by)}).filter("not _t.ghost")
    near = F.timestamp_diff("SECOND", F.col("_before"), F.col("at")) <= gap
    return out.withColumn("prev_id", F.when(near, F.col("prev_id"))).select(*frames.columns, "prev_id")
