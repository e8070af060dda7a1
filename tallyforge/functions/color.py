"""Colour arithmetic on 0..255 channels: ramps, contrast, distance, luminance, conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def ramp(t: Column, stops: Sequence[tuple[float, tuple[int, int, int]]]) -> Column:
    """Piecewise linear RGB between ``stops`` (position, colour), flat beyond the ends; a struct of three BIGINTs."""

    def channel(k: int) -> Column:
        out = F.lit(float(stops[-1][1][k]))
        for (p, a), (q, b) in reversed(list(zip(stops, stops[1:]))):
            out = F.when(t <= q, a[k] + (b[k] - a[k]) * (t - p) / (q - p) if q > p else F.lit(float(b[k]))).otherwise(out)
        return F.round(F.when(t <= stops[0][0], F.lit(float(stops[0][1][k]))).otherwise(out)).cast("bigint")

    return F.struct(*[channel(k).alias(c) for k, c in enumerate("rgb")])


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    """WCAG relative luminance."""

    def linear(x: Column) -> Column:
        s = x / 255.0
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast_ratio(one: Column, two: Column) -> Column:
    """WCAG contrast of two relative luminances."""
    return (F.greatest(one, two) + 0.05) / (F.least(one, two) + 0.05)


def perceived_luminance(r: Column, g: Column, b: Column) -> Column:
    """BT.601 weights."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def rgb_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean distance, 1 between black and white."""
    return F.sqrt(sum((F.pow((x - y).cast("double"), F.lit(2.0)) for x, y in zip(a, b)), F.lit(0.0))) / (255.0 * 3.0**0.5)


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def hsl_to_rgb(h: Column, s: Column, lightness: Column) -> Column:
    """Hue in degrees, the others in 0..1; a struct of three BIGINTs."""
    c = (1 - F.abs(2 * lightness - 1)) * s
    sector = F.pmod(h, F.lit(360.0)) / 60.0
    x = c * (1 - F.abs(F.pmod(sector, F.lit(2.0)) - 1))
    m = lightness - c / 2
    order = [(c, x, 0), (x, c, 0), (0, c, x), (0, x, c), (x, 0, c), (c, 0, x)]

    def channel(k: int) -> Column:
        out = F.lit(order[5][k]) if isinstance(order[5][k], int) else order[5][k]
        for i in range(4, -1, -1):
            v = order[i][k]
            out = F.when(sector < i + 1, F.lit(float(v)) if isinstance(v, int) else v).otherwise(out)
        return F.round((out + m) * 255.0).cast("bigint")

    return F.struct(*[channel(k).alias(n) for k, n in enumerate("rgb")])


def contrast_violation(fg: Column, bg: Column, symbol: Column, least: float = 4.5) -> Column:
    """Whether a visible cell's contrast is below ``least``; colours are structs of r, g, b."""
    lum = lambda c: relative_luminance(*[c[x].cast("double") for x in "rgb"])
    return (F.trim(symbol) != "") & (contrast_ratio(lum(fg), lum(bg)) < least)


def osc_colour(reply: Column) -> Column:
    """The colour of a terminal's reply ``rgb:RRRR/GGGG/BBBB`` (one to four hex digits each), scaled to 0..255; NULL if there is none."""

    def channel(k: int) -> Column:
        digits = F.regexp_extract(reply, "rgb:([0-9A-Fa-f]{1,4})/([0-9A-Fa-f]{1,4})/([0-9A-Fa-f]{1,4})", k)
        return F.round(F.conv(digits, 16, 10).cast("double") * 255 / (F.pow(F.lit(16.0), F.length(digits)) - 1)).cast("bigint")

    found = reply.rlike("rgb:[0-9A-Fa-f]{1,4}/[0-9A-Fa-f]{1,4}/[0-9A-Fa-f]{1,4}")
    return F.when(found, F.struct(*[channel(k + 1).alias(c) for k, c in enumerate("rgb")]))
