"""Colour maths as column expressions, all in DOUBLE."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear sRGB to cone response, cone response to Oklab, and both inverses (published Oklab matrices).
TO_CONE = [(0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)]
TO_LAB = [(0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660)]
FROM_LAB = [(1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480)]
FROM_CONE = [(4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010)]

LAB = ("ok_l", "ok_a", "ok_b")


def num(v: float) -> Column:
    return F.lit(float(v))


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded half away from zero, without a negative zero."""
    return F.round(c, places) + num(0)


def nanos(c: Column) -> Column:
    """A value in whole 10^-9, for comparisons that noise in the last digits must not decide; far cheaper than rounding a double."""
    return F.floor(c * 1e9 + 0.5)


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(num(lo), F.least(num(hi), c))


def to_byte(c: Column) -> Column:
    """A value in 0..1 as a byte, halves upwards."""
    return F.floor(clamp(c) * 255.0 + 0.5).cast("int")


def linearize(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, num(2.4)))


def delinearize(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, num(1 / 2.4)) - 0.055)


def dot(weights: tuple, columns: list[Column]) -> Column:
    total = num(weights[0]) * columns[0]
    for w, c in zip(weights[1:], columns[1:], strict=True):
        total = total + num(w) * c
    return total


def linear_rgb(r: Column, g: Column, b: Column) -> list[Column]:
    return [linearize(c / 255.0) for c in (r, g, b)]


def oklab_of_linear(linear: list[Column]) -> list[Column]:
    cone = [F.cbrt(dot(m, linear)) for m in TO_CONE]
    return [dot(m, cone) for m in TO_LAB]


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    return oklab_of_linear(linear_rgb(r, g, b))


def linear_of_oklab(lab: list[Column]) -> list[Column]:
    cone = [dot(m, lab) for m in FROM_LAB]
    return [dot(m, [c * c * c for c in cone]) for m in FROM_CONE]


def rgb_bytes(lab: list[Column]) -> list[Column]:
    return [to_byte(delinearize(clamp(c))) for c in linear_of_oklab(lab)]


def gray_value(r: Column, g: Column, b: Column, conversion: str = "luminance") -> Column:
    """Gray in 0..1 (gamma applied), from linear light."""
    lin = linear_rgb(r, g, b)
    if conversion == "luminance":
        mixed = dot((0.2126, 0.7152, 0.0722), lin)
    elif conversion == "average":
        mixed = (lin[0] + lin[1] + lin[2]) / 3.0
    elif conversion == "lightness":
        mixed = (F.greatest(*lin) + F.least(*lin)) / 2.0
    else:
        raise ValueError(f"unknown conversion {conversion!r}")
    return clamp(delinearize(mixed))


def thresholds(levels: int, bias: float = 0.0) -> list[float]:
    """Band edges (i / levels) ^ ((5/3) ^ bias)."""
    bias = max(-1.0, min(1.0, bias))
    return [(i / levels) ** ((5 / 3) ** bias) for i in range(1, levels)]


#: Distribution names with their bias.
DISTRIBUTIONS = {"even": 0.0, "shadows": 1.0, "lights": -1.0, "custom": 0.0}


def distribution_thresholds(name: str, levels: int, bias: float = 0.0) -> list[float]:
    """Band edges of a named distribution; "custom" takes a bias of its own."""
    return thresholds(levels, bias if name == "custom" and bias else DISTRIBUTIONS[name])


def abstraction_factor(strength: float, longest: int) -> float:
    """How much smaller an image is made before abstraction."""
    return max(1.0, (2 + 10 * strength) * longest / 1600)


def bias_name(bias: float) -> str:
    return "even" if abs(bias) < 0.04 else "shadows" if bias > 0 else "lights"


def exponent(bias: float) -> float:
    """The exponent that a luminance bias applies to L."""
    return (5 / 3) ** -bias


def band_of_byte(gray: Column, edges: list[float]) -> Column:
    """How many edges, as bytes, the gray byte has reached."""
    total = F.lit(0)
    for t in edges:
        total = total + (gray >= math.floor(t * 255 + 0.5)).cast("int")
    return total


def band_of_value(value: Column, edges: list[float]) -> Column:
    total = F.lit(0)
    for t in edges:
        total = total + (value >= num(t)).cast("int")
    return total


def band_gray(band: Column, levels: int) -> Column:
    return F.floor(band / float(max(1, levels - 1)) * 255.0 + 0.5).cast("int")


def distance2(p: list[Column], q: list[Column], l_weight: float = 1.0, inside: bool = True) -> Column:
    """Squared distance; the lightness weight stands inside the square, or outside."""
    dl, da, db = (x - y for x, y in zip(p, q, strict=True))
    light = (dl * l_weight) * (dl * l_weight) if inside else dl * dl * l_weight
    return light + da * da + db * db


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue_degrees(a: Column, b: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(b, a)), num(360))


def hue_distance(p: Column, q: Column) -> Column:
    """Circular distance of hues in radians."""
    d = F.abs(p - q)
    return F.least(d, 2 * math.pi - d)


def _classes(c: Column, steps: list[tuple[float, str]], last: str) -> Column:
    out = None
    for bound, name in steps:
        out = F.when(c < bound, name) if out is None else out.when(c < bound, name)
    return out.otherwise(last)


#: Class bounds and names of lightness, chroma and hue, and where a hue sector turns from its first temperature.
VALUE_CLASSES = ([(0.20, "Near-Black"), (0.35, "Dark"), (0.55, "Deep"), (0.72, "Mid"), (0.86, "Light")], "Pale")
CHROMA_CLASSES = ([(0.03, "Neutral"), (0.06, "Dull"), (0.10, "Muted"), (0.16, "Soft"), (0.24, "Clear")], "Bright")
HUE_CLASSES = (
    [(20, "Red"), (45, "Orange"), (70, "Gold"), (95, "Yellow"), (140, "Green"), (185, "Teal"), (255, "Blue"), (315, "Violet"), (350, "Rose")],
    "Red",
)
TEMPERATURE_CLASSES = (
    [(10, "Warm"), (20, "Cool"), (82.5, "Warm"), (95, "Cool"), (117.5, "Warm"), (140, "Cool"), (162.5, "Warm"), (220, "Cool"), (255, "Warm"), (285, "Cool"), (315, "Warm"), (332.5, "Cool"), (350, "Warm")],
    "Warm",
)


def value_name(light: Column) -> Column:
    return _classes(light, *VALUE_CLASSES)


def color_name(light: Column, a: Column, b: Column) -> Column:
    """Value, temperature, chroma and hue of a colour in words; neutral colours in short."""
    c, h = chroma(a, b), hue_degrees(a, b)
    warm = F.when(c >= 0.05, _classes(h, *TEMPERATURE_CLASSES))
    named = F.concat_ws(" ", value_name(light), warm, _classes(c, *CHROMA_CLASSES), _classes(h, *HUE_CLASSES))
    return F.when(c < 0.03, F.concat_ws(" ", value_name(light), F.lit("Neutral"))).otherwise(named)


def hex_color(r: Column, g: Column, b: Column, alpha: Column) -> Column:
    return F.format_string("#%02X%02X%02X%02X", r, g, b, alpha)


def smoothstep(lo: Column, hi: Column, x: Column) -> Column:
    t = clamp((x - lo) / (hi - lo))
    return t * t * (3.0 - 2.0 * t)


def mix(x: Column, y: Column, t: Column) -> Column:
    return x * (1.0 - t) + y * t
