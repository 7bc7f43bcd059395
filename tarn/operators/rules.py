"""Table-driven pixel classifiers: unions of half-plane polygons, and decision trees.

Rules are data. A polygon rule is a list of polygons, each a list of half-planes
``y < a x + b`` or ``y > a x + b`` over named bands; a tree is an array of threshold
tests and leaves. Both compile to one boolean or CASE Column, so classifying is a
projection inside whole-stage code generation.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.dims import TREE_LABELS
from tarn.functions import pixel
from tarn.operators import polygons as polygons_data


@dataclass(frozen=True)
class HalfPlane:
    y: str
    op: str
    x: str
    a: float
    b: float

    def column(self) -> Column:
        line = F.lit(self.a) * F.col(self.x) + F.lit(self.b)
        return F.coalesce(F.col(self.y) < line if self.op == "<" else F.col(self.y) > line, F.lit(False))


Polygons = list[list[HalfPlane]]


def _hue_ndvi(*polygons: tuple[tuple[str, float, float], ...]) -> Polygons:
    return [[HalfPlane("hue", op, "ndvi", a, b) for op, a, b in p] for p in polygons]


# Half-planes of the two water clusters, hue against NDVI, in the order of publication.
WATER1 = _hue_ndvi(
    (("<", -9.867784585617413, 238.26034242940045), (">", -12960.000000000335, -12714.048607819708), (">", 23.627546071775214, 255.53176874753507)),
    (("<", -54.685799109352004, 215.15052322834936), ("<", 23.627546071775214, 255.53176874753507), (">", -7.321079389910027, 224.6166270396205)),
    (("<", -172.0408163265306, 191.69646750224035), ("<", -7.321079389910027, 224.6166270396205), (">", -38.11764705882351, 193.8533786110101)),
    ((">", -52.06378986866776, 179.92232432949075), ("<", -879.6226415094455, 180.3004476242325), ("<", -38.11764705882351, 193.8533786110101)),
)
WATER2 = _hue_ndvi(
    (("<", -119.15098406819945, 180.0533162435398), (">", -994.2857142867327, 180.04805813312743), (">", -116.5000234173271, 179.9633248496054)),
    (("<", -2368.4258422651174, 256.40879883589054), ("<", -116.5000234173271, 179.9633248496054), (">", -267.6720052547653, 179.97791758964533)),
    (("<", -108.07947019867622, 179.67747476669464), (">", -2368.4258422651174, 256.40879883589054), (">", 58.99660016815455, 168.09286521078695)),
    (("<", -104.45621862799788, 179.4262481567021), ("<", 58.99660016815455, 168.09286521078695), (">", -52.1565190088889, 172.13690440390852)),
    (("<", -52.1565190088889, 172.13690440390852), (">", -204.2258047185466, 177.66958001421082), (">", 37.74894387447151, 159.60620482085795)),
)
# Brightness below which the clusters hold, hue above which confusion 2d holds, thermal range.
WATER_VAL, HUE2_2D, THERMAL = 0.62, 238, (264, 310)
#: Polygon rules of the confusion and cloud tests.
CONFUSIONS = tuple(rule for rule, *_ in polygons_data.USED)
#: Their polygons, and those of the rules that the mask does not use.
BUILT_IN, OPTIONAL = ({rule: [[HalfPlane(y, op, x, a, b) for op, a, b in p] for p in polygons] for rule, y, x, polygons in data} for data in (polygons_data.USED, polygons_data.OPTIONAL))


def load_polygons(source: str | list[dict]) -> dict[str, Polygons]:
    """Rule name to polygons from JSON lines or dicts with rule, polygon, y, op, x, a, b."""
    rows = [json.loads(x) for x in source.splitlines() if x.strip()] if isinstance(source, str) else source
    found: dict[str, dict[int, list[HalfPlane]]] = {}
    for r in rows:
        if r["op"] not in "<>" or not r["op"]:
            raise ValueError(f"unknown comparison {r['op']!r}")
        found.setdefault(r["rule"], {}).setdefault(int(r["polygon"]), []).append(HalfPlane(r["y"], r["op"], r["x"], float(r["a"]), float(r["b"])))
    return {k: [p for _, p in sorted(v.items())] for k, v in found.items()}


def inside(polygons: Polygons) -> Column:
    """Whether a pixel is in any of the polygons."""
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (h.column() for h in p)) for p in polygons), F.lit(False))


def water_bands(df: DataFrame, rescale: bool) -> DataFrame:
    """Bands that the rules use, from nir, red, green, blue, swir1, swir2 (and tirs1): both colour triples and NDVI, computed once."""
    names = ("nir", "red", "green", "blue", "swir1", "swir2")
    raw = df.withColumn("_invalid", F.coalesce(F.col("blue") == -1, F.lit(False)))
    if rescale:
        raw = raw.withColumns({n: pixel.unit_reflectance(F.col(n)) for n in names})
    raw = raw.withColumn("_hsv", pixel.hsv(F.col("swir2"), F.col("nir"), F.col("red"))).withColumn("_hsv2", pixel.hsv(F.col("nir"), F.col("green"), F.col("blue")))
    return raw.withColumns({"ndvi": pixel.ndvi(F.col("nir"), F.col("red")), "hue": F.col("_hsv.hue"), "sat": F.col("_hsv.sat"), "val": F.col("_hsv.val"), "hue2": F.col("_hsv2.hue"), "sat2": F.col("_hsv2.sat"), "val2": F.col("_hsv2.val")}).drop("_hsv", "_hsv2")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def predicates(polygons: dict[str, Polygons] | None = None, thermal: bool = False) -> dict[str, Column]:
    """Every rule as a boolean Column over ``water_bands``; polygon rules that are not given are left out."""
    dark = _yes(F.col("val") < WATER_VAL)
    out = {
        "water1": dark & inside(WATER1),
        "water2": dark & inside(WATER2),
        "water3": _yes(F.col("swir1") < 0) | _yes(F.col("swir2") < 0),
        "confusion2d": _yes(F.col("hue2") > HUE2_2D),
        "confusion6": _yes((F.col("tirs1") > THERMAL[0]) & (F.col("tirs1") < THERMAL[1])) if thermal else _yes(F.col("hue") > -100),
    }
    for name, p in (polygons or {}).items():
        out[name] = inside(p)
    return out


def water_mask(polygons: dict[str, Polygons] | None = None, thermal: bool = False, cloud: Column | None = None) -> Column:
    """1 water, 0 other, -1 invalid, -2 cloud.

    ((water1 or water2) xor water3) and one of each group of confusions, by the
    built-in polygons unless others are given. With ``{}``, the water clusters
    alone; some but not all rules are an error.
    """
    polygons = BUILT_IN if polygons is None else polygons
    p = predicates(polygons, thermal)
    mask = (p["water1"] | p["water2"]) != p["water3"]
    if polygons:
        missing = [c for c in CONFUSIONS if c not in p]
        if missing:
            raise ValueError(f"polygon rules missing: {', '.join(missing)}")
        for group in (("confusion1a", "confusion1b"), ("confusion2a", "confusion2b", "confusion2c", "confusion2d"), ("confusion3a", "confusion3b", "confusion4a", "confusion4b"), ("confusion6", "clouds")):
            mask = mask & reduce(lambda a, b: a | b, (p[g] for g in group))
    out = F.when(F.col("_invalid"), -1).when(mask, 1).otherwise(0)
    return F.when(_yes(cloud == 1), -2).otherwise(out).cast("byte") if cloud is not None else out.cast("byte")


def classify_water(df: DataFrame, constellation: str, polygons: dict[str, Polygons] | None = None, cloud: Column | None = None) -> DataFrame:
    """Add ``mask`` to a pixel table with one column for each band (common names; vv and vh for radar)."""
    if constellation == "sentinel-1":
        return df.withColumn("mask", pixel.sar_water(pixel.inverted(F.col("vv")), pixel.inverted(F.col("vh"))).cast("byte"))
    thermal = "tirs1" in df.columns
    b = water_bands(df, rescale="sentinel" in constellation)
    b = b.withColumn("mask", water_mask(polygons, thermal, cloud))
    return b.select(*(c for c in df.columns if c != "mask"), "mask")


# Decision trees as arrays. Node i goes to 2i+1 where its test is false and to 2i+2 where it is true.
# B(x): band, S(x, y): difference, R(x, y): ratio.
TREES: dict[str, list[str | None]] = {
    "tree1": ["B(B03)<0.325", "B(B11)<0.267", "B(B8A)<0.166", "B(B07)<1.544", "B(B04)<0.674", "B(B10)<0.011", "B(B8A)<0.039", "snow", "cloud", "snow", "cirrus", "cirrus", "clear", "shadow", "water"],
    "tree2": ["B(B8A)<0.156", "B(B03)<0.333", "S(B06,B03)<-0.025", "R(B06,B11)<4.292", "R(B10,B02)<0.065", "S(B12,B09)<0.084", "S(B12,B09)<-0.016", "snow", "cloud", "cirrus", "clear", "clear", "shadow", "water", "shadow"],
    "tree3": ["B(B8A)<0.181", "B(B01)<0.331", "B(B8A)<0.051", "B(B11)<0.239", "B(B10)<0.012", "B(B12)<0.097", "B(B09)<0.010", "B(B05)<1.393", "B(B02)<0.711", "cirrus", "B(B02)<0.271", "B(B10)<0.010", "B(B10)<0.011", "B(B03)<0.074", "B(B02)<0.073", "snow", "cloud", "snow", "cirrus", None, None, "cloud", "clear", "shadow", "clear", "cirrus", "shadow", "water", "shadow", "water", "shadow"],
    "tree4": ["B(B03)<0.319", "R(B05,B11)<4.330", "B(B8A)<0.166", "B(B03)<0.525", "S(B11,B10)<0.255", "R(B02,B10)<14.689", "S(B03,B07)<0.027", "snow", "R(B01,B05)<1.184", "B(B01)<0.300", "S(B06,B07)<-0.016", "clear", "R(B02,B09)<0.788", "S(B09,B11)<0.021", "S(B09,B11)<-0.097", None, None, "shadow", "clear", "cloud", "clear", "cirrus", "cloud", None, None, "cirrus", "clear", "shadow", "water", "shadow", "clear"],
    "landsat": ["B(B5)<0.181", "B(B1)<0.331", "B(B5)<0.051", "B(B6)<0.239", "B(B9)<0.012", "B(B7)<0.097", None, None, "B(B2)<0.711", "cirrus", "B(B2)<0.271", "B(B9)<0.010", "B(B9)<0.011", None, None, None, None, "snow", "cirrus", None, None, "cloud", "clear", "shadow", "clear", "cirrus", "shadow", None, None, None, None],
}
_TEST = re.compile(r"([BSR])\((\w+)(?:,(\w+))?\)<(-?[\d.]+)")


def tree_bands(tree: list[str | None]) -> list[str]:
    """Bands that a tree tests, by name."""
    return sorted({b for t in tree if t for m in [_TEST.fullmatch(t)] if m for b in (m[2], m[3]) if b})


def _test(rule: str) -> Column:
    m = _TEST.fullmatch(rule)
    if not m:
        raise ValueError(f"not a test: {rule!r}")
    kind, a, b, t = m.groups()
    v = {"B": lambda: F.col(a), "S": lambda: F.col(a) - F.col(b), "R": lambda: F.try_divide(F.col(a), F.col(b))}[kind]()
    return _yes(v < F.lit(float(t)))


def tree_class(tree: list[str | None], i: int = 0) -> Column:
    """Class code of the leaf that a pixel reaches; 0 where a branch is missing. A test on null is false."""
    node = tree[i] if i < len(tree) else None
    if node is None:
        return F.lit(0)
    if "<" not in node:
        return F.lit(TREE_LABELS[node])
    return F.when(_test(node), tree_class(tree, 2 * i + 2)).otherwise(tree_class(tree, 2 * i + 1))
