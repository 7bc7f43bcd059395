"""Pixel arithmetic as Columns: indices, reflectance, colour, quality bits, labels, normalisation.

Null is the only missing value: divisions that numpy would answer with NaN or
infinity give null, and predicates on null are false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean and standard deviation of each band of the segmentation input.
MEAN = {
    "landsat": {"nir08": 11588.495081787236, "red": 10308.54118698969, "green": 10106.44449546895, "blue": 9884.55775884742, "swir16": 12071.537784915748, "swir22": 10871.051386965786},
    "sentinel-2": {"nir": 3175.673410052767, "red": 2846.159579344525, "green": 2634.6308636582967, "blue": 2721.078732531038, "swir16": 2137.4177086230193, "swir22": 1777.2740551498377},
}
STD = {
    "landsat": {"nir08": 7612.821586091905, "red": 7076.499881683219, "green": 6663.153409784478, "blue": 6689.747109784984, "swir16": 3433.7471531465985, "swir22": 2461.9295023428126},
    "sentinel-2": {"nir": 1087.7698670480916, "red": 1081.0526680766202, "green": 976.0808202370134, "blue": 957.661892401617, "swir16": 756.0228427782063, "swir22": 633.4654474029353},
}


def ndvi(nir: Column, red: Column) -> Column:
    """(nir - red) / (nir + red); null where the sum is 0."""
    return F.try_divide(nir.cast("double") - red, nir + red)


def unit_reflectance(dn: Column, top: float = 10000.0) -> Column:
    """0..top to 0..1, clamped."""
    return F.least(F.greatest(dn / F.lit(top), F.lit(0.0)), F.lit(1.0))


def radiance(dn: Column, mult: Column, add: Column) -> Column:
    """mult * dn + add; the number itself where a constant is missing."""
    return F.coalesce(mult * dn + add, dn.cast("double"))


def reflectance(dn: Column, mult: Column, add: Column, sun_elevation: Column, legacy: bool = False) -> Column:
    """Top-of-atmosphere reflectance; ``legacy`` feeds degrees to the sine as they are."""
    return F.coalesce(F.try_divide(mult * dn + add, F.sin(sun_elevation if legacy else F.radians(sun_elevation))), dn.cast("double"))


def brightness_temperature(dn: Column, mult: Column, add: Column, k1: Column, k2: Column, legacy: bool = False) -> Column:
    """k2 / ln(k1 / radiance + 1); ``legacy`` uses k1 in both places."""
    rad = mult * dn + add
    t = F.try_divide(k1 if legacy else k2, F.ln(F.try_divide(k1, rad) + 1))
    return F.coalesce(t, dn.cast("double"))


def to_toa(dn: Column, thermal: Column, mult: Column, add: Column, sun_elevation: Column, k1: Column, k2: Column, legacy: bool = False) -> Column:
    """Top of the atmosphere by kind of band: brightness temperature of thermal bands, reflectance of the others."""
    return F.when(thermal, brightness_temperature(dn, mult, add, k1, k2, legacy)).otherwise(reflectance(dn, mult, add, sun_elevation, legacy))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(hue in degrees, sat, val) by the hexcone model. Grey has hue and saturation 0; where channels tie for the maximum, the later one sets the hue."""
    val = F.greatest(r, g, b)
    d = val - F.least(r, g, b)
    h = F.when(d == 0, F.lit(0.0)).when(b == val, 4 + F.try_divide(r - g, d)).when(g == val, 2 + F.try_divide(b - r, d)).otherwise(F.try_divide(g - b, d))
    h = h / 6
    h = h - F.floor(h)
    return F.struct((h * 360).alias("hue"), F.coalesce(F.try_divide(d, val), F.lit(0.0)).alias("sat"), val.alias("val"))


def bits(word: Column, first: int, n: int = 1) -> Column:
    """``n`` bits of an integer word from bit ``first``."""
    return F.shiftrightunsigned(word, first).bitwiseAND((1 << n) - 1)


def high_confidence(word: Column, first: int) -> Column:
    """Two-bit confidence equal to 3."""
    return F.coalesce(bits(word, first, 2) == 3, F.lit(False))


def sar_water(vv: Column, vh: Column, threshold: int = 15) -> Column:
    """1 where both inverted backscatter values exceed the threshold."""
    return F.when((vv > threshold) & (vh > threshold), 1).otherwise(0)


def inverted(v: Column) -> Column:
    return F.lit(1 << 16) - v


def dprvic(c11: Column, c22: Column, floor_db: float = -17.0) -> Column:
    """Dual-polarised vegetation index from mean vv and vh: q (q + 3) / (q + 1)^2, 0 where vh is not less or vv is too weak."""
    q = F.try_divide(c22, c11)
    value = F.try_divide(q * (q + 3), (q + 1) * (q + 1))
    ok = (c11 > c22) & (F.when(c11 > 0, F.log10(F.when(c11 > 0, c11))) * 10 >= floor_db)
    return value * F.when(F.coalesce(ok, F.lit(False)), 1.0).otherwise(0.0)


def argmax(scores: Column) -> Column:
    """Position from 0 of the first greatest entry."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def standardised(value: Column, constellation: str, band: str) -> Column:
    """(x - mean) / std of the constellation's family; an unknown band is an error."""
    from tarn.dims import family

    f = family(constellation)
    if band not in MEAN.get(f, {}):
        raise ValueError(f"no statistics for {constellation} {band}")
    return (value - F.lit(MEAN[f][band])) / F.lit(STD[f][band])


def min_max(value: Column, low: Column, high: Column, eps: float = 1e-6) -> Column:
    return (value - low) / (high - low + F.lit(eps))


def stretched(value: Column, low: Column, high: Column) -> Column:
    """Linear from low..high to 0..1, clipped."""
    return F.least(F.greatest(F.try_divide(value - low, high - low), F.lit(0.0)), F.lit(1.0))


def masks_to_label(masks: list[Column]) -> Column:
    """The first mask's value; where a later mask is 1, its place counted from 2. The last such mask wins."""
    out = F.when(F.lit(False), 0)
    for i in range(len(masks) - 1, 0, -1):
        out = out.when(masks[i] == 1, i + 1)
    return out.otherwise(masks[0]).cast("int")


def capped_label(label: Column, top: int = 2) -> Column:
    return F.when(label > top, 0).otherwise(label)


def surface_reflectance(dn: Column) -> Column:
    """Collection 2 scale and offset; 0 is no data."""
    return F.when(dn != 0, dn * F.lit(2.75e-5) - F.lit(0.2))


# The mixes of the two false colours.
def false_colour(vv: Column, vh: Column, dark: int = 80, top: float = 2000.0) -> Column:
    """struct(r, g, b) in 0..1 of a radar pixel: one linear mix of vv and vh for dark water, another for the rest, clipped at ``top``."""
    water = vv < dark
    mixes = {"r": (vv, 3 * vv), "g": (8 * vv, 1.1 * vv + 8.75 * vh), "b": (0.5 + 3 * vv + 2000 * vh, 1.75 * vh)}
    return F.struct(*(stretched(F.when(water, w).otherwise(r), F.lit(0.0), F.lit(top)).alias(c) for c, (w, r) in mixes.items()))


def finite(value: Column) -> Column:
    """The number, or null for infinities and NaN."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
