"""Captions of images from activity buckets: dictionaries and one template.

Buckets that no image can have (extreme temperature, explosive and phreatic eruptions, plumes) and
further wordings of the template are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases of each bucket.
CAMERA = {
    "suki": "south face view from Suki monitoring station, looking up at the summit cone",
    "kalor": "west face view from Kalor station, lateral perspective showing the crater rim",
    "kali": "east face view from Kali station, showing the eastern slope and ravines",
}
TIME = {
    "early_morning": "early morning with soft warm golden light and long shadows across the slopes",
    "midday": "bright midday under harsh overhead sunlight, strong contrast",
    "afternoon": "warm afternoon light with slightly golden tone on the volcanic terrain",
    "dusk": "dramatic dusk with orange and purple sky, the volcano silhouetted against sunset colors",
    "night": "dark nighttime",
}
BRIGHTNESS = {
    "daylight": "well-lit in natural daylight, good visibility of terrain details",
    "bright_with_incandescence": "bright daylight with visible volcanic incandescence glowing through",
    "incandescent_glow": "volcanic incandescence illuminating the dark slopes with intense orange-red glow",
    "dim_glow": "faint dim volcanic glow barely visible against the dark mountain",
    "dark": "very dark with minimal visibility, only mountain silhouette barely discernible",
}
LAVA = {
    "none": "No visible lava or volcanic activity, calm dormant slopes",
    "low": "Faint traces of lava visible as small orange-red dots scattered on the upper slope",
    "moderate": "Moderate lava flow creating visible bright orange streams down the mountainside channels",
    "high": "Intense lava flow with bright orange-yellow streams cascading down multiple drainage channels",
    "very_high": "Massive incandescent lava flow covering large portions of the slope, extremely bright white-orange hot material streaming downhill",
}
WEATHER = {
    "clear": "clear sky with excellent visibility",
    "overcast": "thick cloud cover partially obscuring the summit, diffuse soft lighting",
    "hazy": "hazy atmospheric conditions with mist and reduced visibility",
    "clear_night": "clear dark night sky",
}
VISCOSITY = {
    "low": "thin fluid rapidly flowing lava streams",
    "medium": "moderately viscous flowing lava",
    "high": "thick slow-moving viscous lava with rough blocky texture",
}
TEMPERATURE = {
    "low": "dim dark red glow indicating cooling solidifying lava",
    "moderate": "steady bright orange glow from actively flowing lava",
    "high": "bright orange-yellow incandescence from very hot volcanic material",
}
ERUPTION = {
    "none": "",
    "effusive": "Effusive eruption with steady continuous lava outflow from the crater.",
}
TAIL = "Rocky volcanic terrain with gray andesitic rock. Realistic monitoring camera image, natural photographic quality."
DAY_NIGHT = {
    True: "daytime, gray volcanic terrain, lava flow deposits, smoke plume",
    False: "nighttime, incandescent lava flow, glowing volcanic activity, dark terrain",
}


def phrase(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def caption(camera: Column, time: Column, buckets: dict[str, Column], weather: Column, site: str) -> Column:
    """The long caption of an image of `site`."""
    flow = F.when(buckets["lava_intensity"] != "none", F.concat(phrase(VISCOSITY, buckets["viscosity"]), F.lit(" with "), phrase(TEMPERATURE, buckets["temperature"]), F.lit(". "))).otherwise("")
    eruption = F.when(buckets["eruption"] != "none", F.concat(phrase(ERUPTION, buckets["eruption"]), F.lit(" "))).otherwise("")
    where = F.coalesce(phrase(CAMERA, camera), F.concat(F.lit("view from "), camera, F.lit(" station")))
    return F.concat(F.lit(f"Surveillance camera photograph of {site}, "), where, F.lit(". "), phrase(TIME, time), F.lit(", "), phrase(WEATHER, weather), F.lit(". "), phrase(BRIGHTNESS, buckets["brightness"]), F.lit(". "), phrase(LAVA, buckets["lava_intensity"]), F.lit(". "), flow, eruption, F.lit(TAIL))


def short_caption(is_day: Column, site: str) -> Column:
    return F.concat(F.lit(f"surveillance camera photo of {site}, "), F.when(is_day, DAY_NIGHT[True]).otherwise(DAY_NIGHT[False]), F.lit(", Canon EOS 1100D, scientific monitoring"))
