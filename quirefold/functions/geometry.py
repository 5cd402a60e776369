"""Column functions on boxes and polygons. A box is four Columns: left, top, right, bottom."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control-point offset of a quarter circle as a cubic curve.
QUARTER = 0.55228475


class Box(NamedTuple):
    left: Column
    top: Column
    right: Column
    bottom: Column

    @classmethod
    def of(cls, prefix: str = "", names=("left_x", "top_y", "right_x", "bottom_y")) -> Box:
        return cls(*[F.col(f"{prefix}{n}") for n in names])

    @property
    def width(self) -> Column:
        return self.right - self.left

    @property
    def height(self) -> Column:
        return self.bottom - self.top

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for c, n in zip(self, ("left_x", "top_y", "right_x", "bottom_y"), strict=True)]

    def where(self, condition: Column, other: Box) -> Box:
        """This box where the condition holds, else the other."""
        return Box(*[F.when(condition, a).otherwise(b) for a, b in zip(self, other, strict=True)])


def lit(x: float) -> Column:
    return F.lit(float(x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row: as a lambda's variable it is not copied to wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp_range(c: Column, low, high) -> Column:
    """c between low and high; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high)))


def overlap(a: Box, b: Box) -> tuple[Column, Column]:
    """Width and height of the common rectangle; negative where there is none."""
    return F.least(a.right, b.right) - F.greatest(a.left, b.left), F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top)


def area(b: Box) -> Column:
    return F.greatest(lit(0), b.width) * F.greatest(lit(0), b.height)


def iou(a: Box, b: Box, guard: str = "nms") -> Column:
    """Intersection over union.

    nms: clipped areas over max(1e-9, union). match: each area floored at 1e-6. merge: 0 unless both
    overlaps are strictly positive.
    """
    w, h = overlap(a, b)
    common = F.greatest(lit(0), w) * F.greatest(lit(0), h)
    if guard == "nms":
        return common / F.greatest(lit(1e-9), area(a) + area(b) - common)
    if guard == "match":
        return common / (F.greatest(lit(1e-6), a.width * a.height) + F.greatest(lit(1e-6), b.width * b.height) - common)
    if guard == "merge":
        union = a.width * a.height + b.width * b.height - common
        return F.when((w > 0) & (h > 0) & (union > 0), common / union).otherwise(lit(0))
    raise ValueError(guard)


def scale_box(b: Box, factor) -> Box:
    """Scaled about the centre; sides count as 1 at least."""
    k = factor if isinstance(factor, Column) else lit(factor)
    cx, cy = (b.left + b.right) / 2, (b.top + b.bottom) / 2
    w, h = F.greatest(lit(1), b.width) * k, F.greatest(lit(1), b.height) * k
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def clamp_box(b: Box, to: Box) -> Box:
    """The part of b within ``to``; all of ``to`` if there is none."""
    c = Box(F.greatest(b.left, to.left), F.greatest(b.top, to.top), F.least(b.right, to.right), F.least(b.bottom, to.bottom))
    return c.where((c.right > c.left) & (c.bottom > c.top), to)


def mix_box(a: Box, b: Box, w: Column) -> Box:
    """a moved towards b by a weight, which counts as 0 below that and as 1 above."""
    return Box(*[F.when(w <= 0, x).when(w >= 1, y).otherwise(x * (1 - w) + y * w) for x, y in zip(a, b, strict=True)])


def blend_box(a: Box, b: Box, weight: Column) -> Box:
    """a moved towards b by a weight in [0, 1]; a if the result is empty."""
    w = F.least(F.greatest(weight, lit(0)), lit(1))
    mixed = mix_box(a, b, w)
    return mixed.where((w >= 1) | ((mixed.right > mixed.left) & (mixed.bottom > mixed.top)), a)


def inset_box(b: Box, dx: Column, dy: Column) -> Box:
    """Moved inwards, by no more than leaves two pixels; boxes of one pixel stay."""
    x = F.least(F.greatest(dx, lit(0)), F.greatest(lit(0), (b.width - 2) / 2))
    y = F.least(F.greatest(dy, lit(0)), F.greatest(lit(0), (b.height - 2) / 2))
    n = Box(b.left + x, b.top + y, b.right - x, b.bottom - y)
    return n.where((b.width > 1) & (b.height > 1) & (n.right > n.left) & (n.bottom > n.top), b)


def clip_box(b: Box, width: Column, height: Column, mode: str = "outer", pad: int = 2) -> Box:
    """Whole pixels within the page, one at least. outer: floor and ceil; padded: pad, then cut off decimals."""
    if mode == "outer":
        x0, y0, x1, y1 = F.floor(b.left), F.floor(b.top), F.ceil(b.right), F.ceil(b.bottom)
    else:
        x0, y0, x1, y1 = ((c + p).cast("long") for c, p in zip(b, (-pad, -pad, pad, pad), strict=True))
    x0 = F.greatest(F.lit(0), F.least(x0, width - 1)).cast("long")
    y0 = F.greatest(F.lit(0), F.least(y0, height - 1)).cast("long")
    return Box(x0, y0, F.greatest(x0 + 1, F.least(x1, width)).cast("long"), F.greatest(y0 + 1, F.least(y1, height)).cast("long"))


def poly_rect(poly: Column) -> Box:
    """Bounding rectangle of array<struct<x, y>>."""
    x, y = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return Box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def poly_centre(poly: Column) -> tuple[Column, Column]:
    """Mean of the vertices; null without any."""
    add = lambda c: F.aggregate(F.transform(poly, lambda p: p[c]), lit(0), lambda a, b: a + b) / F.nullif(F.size(poly), F.lit(0))
    return add("x"), add("y")


def poly_rel(poly: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """Vertices relative to a crop, clamped to it."""
    return F.transform(
        poly,
        lambda p: F.struct(
            F.least(F.greatest(p["x"] - left, lit(0)), width).alias("x"), F.least(F.greatest(p["y"] - top, lit(0)), height).alias("y")
        ),
    )


def oval_point(b: Box, i: Column, steps: int = 12) -> Column:
    """Point i of oval_poly, as struct<x, y>: by the quarter that it lies in."""
    cx, cy = (b.left + b.right) / 2, (b.top + b.bottom) / 2
    dx, dy = b.width / 2 * QUARTER, b.height / 2 * QUARTER
    quarter, t = F.floor(i / steps), (i % steps) / float(steps)
    u = 1 - t
    pick = lambda *c: F.when(quarter == 0, c[0]).when(quarter == 1, c[1]).when(quarter == 2, c[2]).otherwise(c[3])
    curve = lambda p, q, r, s: u * u * u * p + 3 * u * u * t * q + 3 * u * t * t * r + t * t * t * s
    x = curve(pick(cx, b.right, cx, b.left), pick(cx + dx, b.right, cx - dx, b.left), pick(b.right, cx + dx, b.left, cx - dx), pick(b.right, cx, b.left, cx))
    y = curve(pick(b.top, cy, b.bottom, cy), pick(b.top, cy + dy, b.bottom, cy - dy), pick(cy - dy, b.bottom, cy + dy, b.top), pick(cy, b.bottom, cy, b.top))
    return F.struct(x.alias("x"), y.alias("y"))


def oval_poly(b: Box, steps: int = 12) -> Column:
    """Four quarter arcs through the middles of the sides, each cut into ``steps`` points."""
    return F.transform(F.sequence(F.lit(0), F.lit(4 * steps - 1)), lambda i: oval_point(b, i, steps))


def ceil_modulo(x: Column, mod: int) -> Column:
    return (F.ceil(x / mod) * mod).cast("long")


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """8-bit Lab (L scaled to 255, a and b moved by 128) of 0-255 sRGB values, D65 white."""
    lin = lambda c: F.when(c / 255 > 0.04045, F.pow((c / 255 + 0.055) / 1.055, lit(2.4))).otherwise(c / 255 / 12.92)
    lr, lg, lb = lin(r), lin(g), lin(b)
    x = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116)
    light = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    return F.struct((light * 255 / 100).alias("L"), (500 * (f(x) - f(y)) + 128).alias("a"), (200 * (f(y) - f(z)) + 128).alias("b"))


def lab_distance(p: Column, q: Column) -> Column:
    return F.sqrt(sum((p[c] - q[c]) * (p[c] - q[c]) for c in ("L", "a", "b")))
