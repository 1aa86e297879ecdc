"""Geometry of text boxes: normalized coordinates in 0…1 with the origin at the bottom left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PLAY_WIDTH, PLAY_HEIGHT = 1920, 1080
FONT_LEAST, FONT_MOST, FONT_SCALE = 34, 64, 0.85
FLOOR, LANE_STEP = 0.16, 0.04
NEAR = 0.05


def clamp(v: Column) -> Column:
    """v within 0…1; null stays null."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def font_size(height: Column, screen: int) -> Column:
    size = F.round(clamp(height) * max(1, screen) * FONT_SCALE)
    return F.least(F.greatest(size, F.lit(float(FONT_LEAST))), F.lit(float(FONT_MOST))).cast("bigint")


def lane_floor(lane: Column) -> Column:
    return clamp(F.lit(FLOOR) + F.lit(LANE_STEP) * F.greatest(lane, F.lit(0)))


def override_prefix(x: Column, y: Column, width: int, height: int, rtl: bool = False, size: Column | None = None, floor: Column | None = None) -> Column:
    """Position tag of a cue, or null without a position."""
    low = clamp(y) if floor is None else F.greatest(clamp(y), F.coalesce(clamp(floor), F.lit(0.0)))
    px = F.round(clamp(x) * max(1, width)).cast("bigint").cast("string")
    py = F.round((1.0 - low) * max(1, height)).cast("bigint").cast("string")
    font = F.lit("") if size is None else F.coalesce(F.concat(F.lit("\\fs"), size.cast("string")), F.lit(""))
    tag = F.concat(F.lit("{\\an6" if rtl else "{\\an4"), font, F.lit("\\pos("), px, F.lit(","), py, F.lit(")}"))
    return F.when(x.isNotNull() & y.isNotNull(), tag)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean; 0 if neither has a position, infinite if only one has."""
    one, two = x1.isNotNull() & y1.isNotNull(), x2.isNotNull() & y2.isNotNull()
    return F.when(~one & ~two, 0.0).when(one & two, F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))).otherwise(F.lit(float("inf")))


def near(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return distance(x1, y1, x2, y2) <= NEAR


def in_excluded_region(cx: Column, cy: Column, p) -> Column:
    """Whether a centre lies in one of the six excluded rectangles of a profile (low edges included, high ones not)."""
    top, low = 1 - p.top_band, p.bottom_band
    rects = (
        (p.top_corner_width, top, 1 - p.top_corner_width, 1.0),
        (0.0, 1 - p.top_corner_height, p.top_corner_width, 1.0),
        (1 - p.top_corner_width, 1 - p.top_corner_height, 1.0, 1.0),
        (0.0, 0.0, 1.0, low),
        (0.0, 0.0, p.bottom_corner_width, p.bottom_corner_height),
        (1 - p.bottom_corner_width, 0.0, 1.0, p.bottom_corner_height),
    )
    out = F.lit(False)
    for x0, y0, x1, y1 in rects:
        out = out | ((cx >= x0) & (cx < x1) & (cy >= y0) & (cy < y1))
    return out


def envelope(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """Aggregates x0, x1, y0, y1: the box around some boxes."""
    return [F.min(x).alias("x0"), F.max(x + w).alias("x1"), F.min(y).alias("y0"), F.max(y + h).alias("y1")]


def center(x0: Column, x1: Column, y0: Column, y1: Column) -> tuple[Column, Column]:
    """Middle of a box, within 0…1; null without a box."""
    return clamp((x0 + x1) / 2), clamp((y0 + y1) / 2)


def anchor(x0: Column, x1: Column, y0: Column, y1: Column, rtl: bool = False) -> tuple[Column, Column]:
    """Where a text begins: the middle of a box's left edge, or of its right edge."""
    return clamp(x1 if rtl else x0), clamp((y0 + y1) / 2)


def font_height(h: Column) -> Column:
    return clamp(h)


def encode_number(v: Column) -> Column:
    """A position or height as an attribute's value: six decimals."""
    return F.when(v.isNotNull(), F.format_string("%.6f", v))


def decode_number(attributes: Column, key: str) -> Column:
    """The value of an attribute as a number; null if it is absent or none."""
    return attribute(attributes, key).try_cast("double")


def tall_enough(h: Column, screen: int, p) -> Column:
    return h * screen >= F.lit(p.min_text_height).cast("float").cast("double") * screen


def wide_enough(w: Column, h: Column) -> Column:
    return ~(w * 1.05 < h)


def skew_angle(tlx, tly, trx, try_, blx, bly, brx, bry) -> Column:
    """Mean angle in degrees of the top and bottom edges; whichever exists, else null."""
    top = F.degrees(F.atan2(try_ - tly, trx - tlx))
    bottom = F.degrees(F.atan2(bry - bly, brx - blx))
    return F.coalesce((top + bottom) / 2, top, bottom)


def straight(skew: Column, most: float = 5.0) -> Column:
    return F.coalesce(~(F.abs(skew) > most), F.lit(True))


def display_text(text: Column, w: Column, h: Column, p) -> Column:
    return F.when(w * h < p.parenthesis_area, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def presentation(size: Column, natural: Column) -> Column:
    return F.when(F.abs(size) > 0, F.abs(size)).otherwise(F.abs(natural))


def attribute(attributes: Column, key: str) -> Column:
    """Value of the first attribute with a key."""
    return F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]
