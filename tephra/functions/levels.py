"""Levels, flags and rules as single column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of the five levels of a normalised score, with their upper bounds.
ANOMALY_LEVELS = [(0.2, "Normal 🟢"), (0.4, "Légère 🟡"), (0.6, "Modérée 🟠"), (0.8, "Forte 🔴"), (None, "Critique ⚠️")]
FLAGS = ["usable", "cloudy", "dark", "corrupted", "unknown"]


def quality_flag(size: Column, readable: Column, mean: Column, variance: Column, dark_below: float = 30.0, flat_below: float = 50.0, min_bytes: int = 1000) -> Column:
    bad = size.isNull() | (size < min_bytes) | ~F.coalesce(readable, F.lit(False)) | mean.isNull()
    return F.when(bad, "corrupted").when(mean < dark_below, "dark").when(F.coalesce(variance, F.lit(0.0)) < flat_below, "cloudy").otherwise("usable")


def anomaly_level(score: Column) -> Column:
    out = F
    for bound, text in ANOMALY_LEVELS[:-1]:
        out = out.when(score < bound, text)
    return out.when(score.isNotNull(), ANOMALY_LEVELS[-1][1])


def alert_ratio_level(ratio: Column) -> Column:
    return F.when(ratio > 1.5, "strong").when(ratio > 1.2, "medium").otherwise("normal")


def coverage_level(percent: Column) -> Column:
    return F.when(percent >= 90, "good").when(percent >= 50, "partial").otherwise("poor")


def label_from_flag(flag: Column) -> Column:
    return F.when(flag == "dark", 1).when(flag == "cloudy", 0)


#: The classes of activity.
CLASSES = ["pyroclastique", "lave", "nuage", "normal"]


def heuristic_class(has_features: bool = True) -> Column:
    """Ordered threshold rules over the feature columns; nulls count as 0."""
    if not has_features:
        return F.lit("normal")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    flow, patch, rough, change = z("optical_flow_mag"), z("patchcore_score"), z("texture_roughness"), z("temporal_change_score")
    bright, entropy, diff, night = z("bright_pixel_ratio"), z("lbp_entropy"), z("pixel_diff_mean"), F.coalesce(F.col("is_night"), F.lit(False))
    idle = (flow == 0) & (patch == 0) & (rough == 0) & (change == 0) & (bright == 0) & (entropy == 0) & (diff == 0)
    return (
        F.when(idle, "normal")
        .when((flow > 2.0) | (patch > 46.5) | ((patch > 44.0) & (rough > 0.00033)) | ((change > 0.12) & (patch > 40)), "pyroclastique")
        .when((night & (bright > 0.02)) | (~night & (bright > 0.92)), "lave")
        .when(F.coalesce(F.lower("weather_label").rlike("cloud|nuage|fog"), F.lit(False)), "nuage")
        .when(((entropy > 0) | (diff > 0)) & (patch < 30) & (entropy < 3.5) & (diff < 0.03), "nuage")
        .otherwise("normal")
    )


def mean_of_present(*columns: Column) -> Column:
    """Mean of the values that are there; 0 if none is."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(there) == 0, 0.0).otherwise(F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def activity_buckets(hour: Column, score: Column) -> dict[str, Column]:
    day = hour.between(6, 17)
    return {
        "brightness": F.when(day & (score > 0.3), "bright_with_incandescence").when(day, "daylight").when(score > 0.3, "incandescent_glow").when(score > 0.1, "dim_glow").otherwise("dark"),
        "lava_intensity": F.when(score > 0.5, "very_high").when(score > 0.3, "high").when(score > 0.15, "moderate").when(score > 0.05, "low").otherwise("none"),
        "viscosity": F.when(score > 0.3, "low").when(score > 0.1, "medium").otherwise("high"),
        "temperature": F.when(score > 0.5, "high").when(score > 0.1, "moderate").otherwise("low"),
        "eruption": F.when(score > 0.3, "effusive").otherwise("none"),
    }


def weather_bucket(flag: Column, hour: Column) -> Column:
    return F.when(flag == "cloudy", "overcast").when((flag == "dark") & ~hour.between(6, 17), "clear_night").when(flag == "dark", "hazy").otherwise("clear")


def slope(camera: Column) -> Column:
    return F.when(camera == "suki", "30deg_south").when(camera == "kalor", "25deg_west").when(camera == "kali", "35deg_east").otherwise("30deg_unknown")


def colour_gains(hour: Column, score: Column) -> dict[str, Column]:
    glow = F.least(score * 1.8, F.lit(1.0))
    night = F.when(score > 0.3, F.struct((0.3 + 0.7 * glow).alias("r"), (0.15 + 0.35 * glow).alias("g"), F.lit(0.1).alias("b")))
    fixed = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    night = night.when(score > 0.1, fixed(0.45, 0.3, 0.2)).otherwise(fixed(0.25, 0.3, 0.45))
    gains = F.when(hour.between(6, 9), fixed(1.08, 1.02, 0.88)).when(hour.between(10, 13), fixed(1.0, 1.0, 0.95)).when(hour.between(14, 17), fixed(1.05, 0.98, 0.88)).when(hour.between(18, 20), fixed(1.2, 0.82, 0.6)).otherwise(night)
    return {c: gains[c] for c in ("r", "g", "b")}
