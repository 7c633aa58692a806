"""Composition of layers with coverage, and blend modes that mix the channels, by their published formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .raster import BLENDS

#: Shares of source and destination that stay, from their coverages (alphas): the Porter-Duff operators.
COVERAGE = {
    "src_over": lambda a, b: (F.lit(1.0), 1 - a),
    "dst_over": lambda a, b: (1 - b, F.lit(1.0)),
    "src_in": lambda a, b: (b, F.lit(0.0)),
    "dst_in": lambda a, b: (F.lit(0.0), a),
    "src_out": lambda a, b: (1 - b, F.lit(0.0)),
    "dst_out": lambda a, b: (F.lit(0.0), 1 - a),
    "src_atop": lambda a, b: (b, 1 - a),
    "dst_atop": lambda a, b: (1 - b, a),
    "xor": lambda a, b: (1 - b, 1 - a),
}


def covered(mode: str, s: Column, a: Column, d: Column, b: Column) -> tuple[Column, Column]:
    """(value, alpha), the value multiplied by alpha, of source s with alpha a over destination d with alpha b; all in 0..1."""
    if mode == "modulate":
        return s * a * d * b, a * b
    if mode in COVERAGE:
        keep_s, keep_d = COVERAGE[mode](a, b)
        return s * a * keep_s + d * b * keep_d, a * keep_s + b * keep_d
    mixed = BLENDS[mode](s, d)
    return s * a * (1 - b) + d * b * (1 - a) + a * b * mixed, a + b - a * b


Color = tuple[Column, Column, Column]


def lightness(c: Color) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def _span(c: Color) -> Column:
    return F.greatest(*c) - F.least(*c)


def with_lightness(c: Color, light: Column) -> Color:
    """The colour moved to that lightness; channels that leave 0..1 are pulled back towards it."""
    moved = tuple(x + (light - lightness(c)) for x in c)
    low, high = F.least(*moved), F.greatest(*moved)
    up = tuple(F.when(low < 0, light + (x - light) * light / (light - low)).otherwise(x) for x in moved)
    return tuple(F.when(high > 1, light + (x - light) * (1 - light) / (high - light)).otherwise(x) for x in up)


def with_saturation(c: Color, span: Column) -> Color:
    low, own = F.least(*c), _span(c)
    return tuple(F.when(own > 0, (x - low) * span / own).otherwise(0.0) for x in c)


#: Modes of a source colour over a destination colour.
MIXES = {
    "hue": lambda s, d: with_lightness(with_saturation(s, _span(d)), lightness(d)),
    "saturation": lambda s, d: with_lightness(with_saturation(d, _span(s)), lightness(d)),
    "color": lambda s, d: with_lightness(s, lightness(d)),
    "luminosity": lambda s, d: with_lightness(d, lightness(s)),
}
