"""Columns derived from file names, paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name patterns in order; the first that matches wins.
STAMPS = [
    r"(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})?",
    r"(\d{4})(\d{2})(\d{2})_(\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})_(\d{2})\.(\d{2})(?:\.(\d{2}))?",
]
PARTS = ("year", "month", "day", "hour", "minute", "second")
#: Endings of images, words of the site's own pictures, and names of its decorations.
ENDINGS = r"\.(jpg|jpeg|JPG|JPEG|png|PNG)$"
SITE_WORDS = "title|logo|barre"
DECORATIONS = "barre_vert|barre_hor|_title|fleche|arrow|spacer"
#: Folders and words of detail pages, and how names of known cameras begin.
DETAIL_FOLDERS = "/html_images/|/html/"
CAMERA_WORDS = "canon|cam|kalor|suki"
KNOWN = "^(kalor|suki|canon|cam)"


def stamp_parts(filename: Column) -> Column:
    """Year to second of a file name as an array of texts; null if no pattern matches."""
    stem = F.regexp_replace(F.regexp_replace(filename, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    found = []
    for p in STAMPS:
        n = p.count("(") - p.count("(?:")
        found.append(F.when(stem.rlike(p), F.regexp_replace(stem, f"^.*?{p}.*$", " ".join(f"${i + 1}" for i in range(n)) + " " * (6 - n))))
    return F.split(F.coalesce(*found), " ", -1)


def stamped(df: DataFrame, filename: str = "filename", prefix: str = "p_") -> DataFrame:
    """df with the parts of the file name as whole numbers; ranges are not checked."""
    whole = lambda i: F.coalesce(F.nullif(F.get("_parts", F.lit(i)), F.lit("")), F.lit("0")).cast("int")
    parts = {f"{prefix}{c}": F.when(F.col("_parts").isNotNull(), whole(i)) for i, c in enumerate(PARTS)}
    return df.withColumn("_parts", stamp_parts(F.col(filename))).withColumns(parts).drop("_parts")


def fill_from_name(df: DataFrame, fields: tuple[str, ...] = ("day", "hour", "minute", "second")) -> DataFrame:
    """The named columns, with nulls filled from the file name."""
    return stamped(df, prefix="_p_").withColumns({c: F.coalesce(c, f"_p_{c}") for c in fields}).drop(*[f"_p_{c}" for c in PARTS])


def camera(filename: Column, pattern: str = r"^([A-Za-z0-9_]+)_Canon") -> Column:
    found = F.lower(F.regexp_extract(filename, pattern, 1))
    return F.when(F.coalesce(found, F.lit("")) == "", "unknown").otherwise(found)


def source_type(url: Column) -> Column:
    return F.when(url.contains("/icones/"), "icone").when(url.contains("/images_publiques/"), "image_publique").otherwise("autre")


def processed_path(raw: Column, raw_root: str = "data/raw", processed_root: str = "data/processed") -> Column:
    return F.regexp_replace(F.regexp_replace(raw, f"(^|/){raw_root}/", f"$1{processed_root}/"), r"\.[^./]*$", ".png")


def path_candidates(local_path: Column, filename: Column) -> Column:
    """Places to look for an image, in order."""
    return F.array(processed_path(local_path), local_path, F.concat(F.lit("data/processed/"), F.regexp_replace(filename, r"\.[^.]*$", ".png")), F.concat(F.lit("data/raw/"), filename))


def month_page_url(base: str, year: Column, month: Column) -> Column:
    two = F.lpad(month.cast("string"), 2, "0")
    names = F.array(*map(F.lit, "jan feb mar apr may jun jul aug sep oct nov dec".split()))
    return F.concat(F.lit(base), F.lit("/"), year.cast("string"), F.lit("_"), two, F.lit("/"), year.cast("string"), F.lit("_"), F.get(names, month - 1), F.lit(".html"))


def stem_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def is_image_url(url: Column) -> Column:
    path = F.regexp_replace(url, "[?#].*$", "")
    return path.rlike(ENDINGS) & ~F.lower(url).rlike(SITE_WORDS)


def is_detail_page(href: Column) -> Column:
    low = F.lower(href)
    return (href != "") & ~href.startswith("file://") & low.rlike(DETAIL_FOLDERS) & low.endswith(".html") & low.rlike(CAMERA_WORDS)


def is_decoration(url: Column) -> Column:
    return F.lower(stem_of(url)).rlike(DECORATIONS)


def of_camera(url: Column, camera: str) -> Column:
    """Whether the file is named after the camera, as it is or as a scaled copy."""
    return F.lower(stem_of(url)).rlike(f"^(ech_)?{camera}")


def rewritten(url: Column, base: str, year: Column, month: Column, public: bool = True) -> Column:
    """Thumbnails, detail pages and local file links as the address of the full image.
    `public` says which of the two layouts of older months the server has."""
    ym = F.concat(year.cast("string"), F.lit("_"), F.lpad(month.cast("string"), 2, "0"))
    stem, bare = stem_of(url), F.regexp_replace(stem_of(url), "^ech_", "")
    full = lambda folder, s: F.concat(F.lit(base), F.lit("/"), folder, F.lit("/html_images/ech_"), s, F.lit(".jpg"))
    filed = F.regexp_extract(url, r"(\d{4}_\d{2})[/\\]html_images", 1)
    known = F.lower(stem).rlike(KNOWN)
    icon = F.replace(url, F.lit("/icones/"), F.lit("/images_publiques/")) if public else full(ym, bare)
    return (
        F.when(url.startswith("file://"), F.when(known, full(F.coalesce(F.nullif(filed, F.lit("")), ym), stem)))
        .when(url.contains("/thumbnails/"), full(ym, bare)).when(url.contains("/icones/"), icon)
        .when(url.contains("/html_images/") & url.endswith(".html"), F.concat(F.regexp_extract(url, "^(.*)/[^/]*$", 1), F.lit("/ech_"), stem, F.lit(".jpg")))
        .when(url.contains("/html/"), F.regexp_replace(F.replace(url, F.lit("/html/"), F.lit("/images_publiques/")), r"\.[^./]*$", ".jpg")).otherwise(url)
    )
