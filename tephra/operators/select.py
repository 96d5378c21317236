"""Filters, splits and link extraction over index-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .quantiles import quantiles


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only if df, counted here, has max_rows rows at most; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= max_rows else df


def minmax_norm(df: DataFrame, score: str) -> DataFrame:
    """Rows with a score, and `norm`: the score between the least and the greatest."""
    df = df.filter(F.col(score).isNotNull())
    edges = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))  # one row
    return df.join(F.broadcast(edges)).withColumn("norm", (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).drop("_lo", "_hi")


def relative(df: DataFrame, score: str, by: str) -> DataFrame:
    """`relative`: the score divided by the greatest of its selection. The maximum is
    aggregated first and joined back, so that a hot selection is not one task's window."""
    df = df.filter(F.col(score).isNotNull())
    return df.join(df.groupBy(by).agg(F.max(score).alias("_hi")), by).withColumn("relative", F.col(score) / F.col("_hi")).drop("_hi")


def of_quality(df: DataFrame, flags: list[str], with_null: bool = True) -> DataFrame:
    keep = F.col("quality_flag").isin(flags)
    return df.filter(keep | F.col("quality_flag").isNull() if with_null else keep)


def cascade(df: DataFrame, chosen: dict) -> DataFrame:
    """What each level of year, month, day, quality and downloaded offers under the choices above it."""
    short = {"quality_flag": "quality"}
    steps, out = list(chosen.items()), None
    for i, (column, value) in enumerate(steps):
        keep = F.col(column) == value
        df = df.filter(keep | F.col(column).isNull() if column == "quality_flag" else keep)
        after = steps[i + 1][0] if i + 1 < len(steps) else "downloaded"
        offer = df.groupBy(F.col(after).cast("string").alias("choice")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(short.get(after, after)).alias("level"), "choice", "n")
        out = offer if out is None else out.union(offer)
    return out


def temporal_split(df: DataFrame, train: Column, test: Column) -> DataFrame:
    """Usable rows: `train` by day only, `test` at all hours."""
    split = F.when(train & F.col("hour").between(6, 17), "train").when(test, "test")
    return df.filter("quality_flag = 'usable'").withColumn("split", split).filter("split is not null")


def proxy_labels(df: DataFrame, score: str) -> DataFrame:
    """Dark images as positives, usable day images as negatives, where there is a score."""
    y = F.when(F.col("quality_flag") == "dark", 1).when((F.col("quality_flag") == "usable") & F.col("hour").between(6, 17), 0)
    return df.withColumn("y_true", y).filter(F.col("y_true").isNotNull() & F.col(score).isNotNull())


def categories(df: DataFrame) -> DataFrame:
    """A row for each of the overlapping categories that a usable image falls into; no score counts as 0."""
    df = df.filter("quality_flag = 'usable'")
    day, s = F.col("hour").between(6, 17), F.coalesce("anomaly_score", F.lit(0.0))
    found = [F.when(day & (s < 0.1), "day_calm"), F.when(day & (s >= 0.15), "day_active"), F.when(~day & (s >= 0.15), "night_active"), F.when(~day & (s < 0.05), "night_calm"), F.when(F.col("hour").between(18, 20), "dusk")]
    return df.withColumn("category", F.explode(F.array_compact(F.array(*found))))


def above(df: DataFrame, score: str, q: float) -> DataFrame:
    """Rows with a score above a quantile of all rows."""
    return df.join(F.broadcast(quantiles(df, score, [], {"_line": q}))).filter(F.col(score) > F.col("_line")).drop("_line")


def links(pages: DataFrame, tag: str, attribute: str) -> DataFrame:
    """pages with a row for each address (`href`) in an attribute of a kind of tag, and `link`, resolved
    against the page's own."""
    base = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", "")
    found = F.regexp_extract_all("html", F.lit(rf"""(?i)<{tag}\b[^>]*?\b{attribute}\s*=\s*["']([^"']*)["']"""), F.lit(1))
    each = pages.withColumn("base", base).withColumn("href", F.explode(found))
    link = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("/"), F.concat(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1), "href")).otherwise(F.concat("base", "href"))
    return each.withColumn("link", link).drop("base")


def image_links(pages: DataFrame, base: str, camera: str) -> DataFrame:
    """page_id and link, each once: the full images of one camera that pages(page_id, url, html, year,
    month) show or link to. Thumbnails, detail pages and file links count as their full images,
    decorations do not."""
    shown = links(pages, "img", "src").filter(~F.col("href").startswith("file://") & names.is_image_url(F.col("href")))
    linked = links(pages, "a", "href")
    local = F.col("href").startswith("file://") & F.col("href").contains("/html_images/") & F.lower("href").endswith(".html")
    linked = linked.filter(local | names.is_image_url(F.col("href")) | names.is_detail_page(F.col("link")))
    full = lambda df, thumb: df.select("page_id", F.when(thumb, names.rewritten(F.col("link"), base, F.col("year"), F.col("month"))).otherwise(F.col("link")).alias("link"))
    both = full(shown, F.lower("link").rlike("/icones/|/thumbnails/")).union(full(linked, local | ~names.is_image_url(F.col("href"))))
    return both.filter(F.col("link").isNotNull() & ~names.is_decoration(F.col("link")) & names.of_camera(F.col("link"), camera)).distinct()


def first_of(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in an order that must be total; a null order comes
    first. It is an aggregate, so the rows of a hot key are reduced before they are shuffled."""
    pick = F.max_by if last else F.min_by
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(pick(row, F.struct(order)).alias("_row")).select(*keys, "_row.*").select(df.columns)
