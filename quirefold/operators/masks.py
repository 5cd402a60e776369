"""Mask datasets: generators of rectangles, areas, overlaps, selection.

Randomness is a function of (seed, image, variant, draw): the md5 of them, so that reruns, retries and
other SQL engines agree. Masks are unions of rectangles (mask_id, y0, y1, x0, x1) with open ends.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.bins import linear_ramp

from .intervals import overlap_join
from .ordering import union_area

IMAGE = ("image_id", "w", "h")
#: Rows of an image in a bucket of the joins of rectangles.
BAND = 64


def unit(seed: int, draw: str | Column, *keys: Column) -> Column:
    """A number in [0, 1) from the md5 of seed, keys and the name of the draw."""
    parts = [F.lit(str(seed)), *[k.cast("string") for k in keys], draw.cast("string") if isinstance(draw, Column) else F.lit(draw)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / float(2**32)


def whole(u: Column, low: Column, high: Column) -> Column:
    """A whole number in [low, high) from a unit draw; low if the range is empty."""
    return (low + F.floor(u * F.greatest(F.lit(0), high - low))).cast("long")


def _n(x: int) -> Column:
    return F.lit(x).cast("long")


def gen_rectangles(images: DataFrame, seed: int, min_times=0, max_times=3, min_size=30, max_size=100, margin=10, ramp: Column | None = None) -> DataFrame:
    """Random rectangles: times in [min, max], sides in [min, max), starts inside the margin -> image_id, i, y0, y1, x0, x1.

    ramp, a Column in [0, 1], scales the upper limits (a curriculum).
    """
    img = F.col("image_id")
    most = _n(max_times) if ramp is None else (min_times + (max_times - min_times) * ramp).cast("long")
    side = _n(max_size) if ramp is None else (min_size + 1 + (max_size - min_size) * ramp).cast("long")
    side = F.least(side, (F.col("h") - 2 * margin).cast("long"), (F.col("w") - 2 * margin).cast("long"))
    times = whole(unit(seed, "times", img), _n(min_times), most + 1)
    rows = images.select(*IMAGE, side.alias("side"), F.explode(F.when(times > 0, F.sequence(_n(1), times))).alias("i"))
    draw = lambda name, low, high: whole(unit(seed, name, img, F.col("i")), low, high)
    rows = rows.withColumns({"bw": draw("bw", _n(min_size), F.col("side")), "bh": draw("bh", _n(min_size), F.col("side"))})
    rows = rows.withColumns({"x0": draw("x", _n(margin), F.col("w") - margin - F.col("bw") + 1), "y0": draw("y", _n(margin), F.col("h") - margin - F.col("bh") + 1)})
    return rows.select("image_id", "i", "y0", (F.col("y0") + F.col("bh")).alias("y1"), "x0", (F.col("x0") + F.col("bw")).alias("x1"))


def gen_stripes(images: DataFrame, seed: int, min_step=2, max_step=4, min_width=1, max_width=3) -> DataFrame:
    """A grid of stripes with random step, width and offset per axis -> image_id, axis, i, y0, y1, x0, x1."""
    img = F.col("image_id")

    def axis(name: str) -> tuple[Column, Column, Column]:
        step = whole(unit(seed, f"s{name}", img), _n(min_step), _n(max_step + 1))
        width = whole(unit(seed, f"w{name}", img), _n(min_width), F.least(step, _n(max_width + 1)))
        return step, width, whole(unit(seed, f"o{name}", img), _n(0), step)

    parts = []
    for name, length, other in (("y", "h", "w"), ("x", "w", "h")):
        step, width, offset = axis(name)
        rows = images.select(*IMAGE, step.alias("step"), width.alias("width"), offset.alias("offset"))
        rows = rows.withColumn("i", F.explode(F.when(F.col("offset") < F.col(length), F.sequence(F.col("offset"), F.col(length).cast("long") - 1, F.col("step")))))
        a, b = F.col("i"), F.least(F.col("i") + F.col("width"), F.col(length).cast("long"))
        full = F.col(other).cast("long")
        y, x = ((a, b), (_n(0), full)) if name == "y" else ((_n(0), full), (a, b))
        parts.append(rows.select("image_id", F.lit(name).alias("axis"), "i", y[0].alias("y0"), y[1].alias("y1"), x[0].alias("x0"), x[1].alias("x1")))
    return parts[0].unionByName(parts[1])


def gen_area(images: DataFrame, seed: int, training: bool, ratio=0.225, low=0.1, high=0.35) -> DataFrame:
    """A central square of an area share, or in training a random rectangle of side sqrt(share) -> one rectangle.

    The extent along the width is used for rows and that along the height for columns, as the masks are defined.
    """
    img = F.col("image_id")

    def span(size: str) -> tuple[Column, Column]:
        n = F.col(size)
        if not training:
            margin = math.sqrt(ratio) / 2 * n
            return F.bround(n / 2 - margin, 0).cast("long"), F.bround(n / 2 + margin, 0).cast("long")
        lo, hi = math.sqrt(low), math.sqrt(high)
        side = F.bround((unit(seed, f"side_{size}", img) * (hi - lo) + lo) * n, 0).cast("long")
        start = whole(unit(seed, f"start_{size}", img), _n(0), n - side)
        return start, start + side

    a, b = span("w"), span("h")
    return images.select("image_id", a[0].alias("y0"), a[1].alias("y1"), b[0].alias("x0"), b[1].alias("x1"))


def gen_border(images: DataFrame, seed: int, low=0.04, high=0.25, probs=(0.5, 0.5, 0.5, 0.5), content: Column | None = None) -> DataFrame:
    """Padding on random sides, one at least -> image_id, side, y0, y1, x0, x1.

    content: a hash of the image, if equal images are to get equal padding. Paddings of row extents are
    drawn from the height and applied to the width, and the other way round, as the masks are defined.
    """
    key = content if content is not None else F.col("image_id")
    pad = lambda side, size: whole(unit(seed, f"pad{side}", key), F.floor(low * F.col(size)).cast("long"), F.floor(high * F.col(size)).cast("long")) / F.col(size)
    h, w = F.col("h"), F.col("w")
    cut = lambda x: x.cast("long")
    zero = _n(0)
    rects = [
        (zero, cut(h), zero, cut(pad(0, "h") * w)), (zero, cut(pad(1, "w") * h), zero, cut(w)),
        (zero, cut(h), cut((1 - pad(2, "h")) * w), cut(w)), (cut((1 - pad(3, "w")) * h), cut(h), zero, cut(w)),
    ]
    drawn = [unit(seed, f"side{i}", key) < p for i, p in enumerate(probs)]
    none = ~(drawn[0] | drawn[1] | drawn[2] | drawn[3])
    u, total, lone, before = unit(seed, "lone", key), sum(probs), [], 0.0
    for p in probs:
        lone.append((u >= before / total) & (u < (before + p) / total))
        before += p
    made = [F.when(d | (none & o), F.struct(F.lit(i).alias("side"), *[c.alias(n) for c, n in zip(r, ("y0", "y1", "x0", "x1"), strict=True)])) for i, (d, o, r) in enumerate(zip(drawn, lone, rects, strict=True))]
    return images.select("image_id", F.explode(F.array_compact(F.array(*made))).alias("r")).select("image_id", "r.*")


def gen_strokes(images: DataFrame, seed: int, max_angle=4, max_len=60, max_width=20, min_times=0, max_times=10) -> DataFrame:
    """Random walks of one to five segments -> image_id, stroke, segment, x0, y0, x1, y1, width.

    The walk of a stroke is folded from its draws with built-in functions; squares_of, circles_of and lines_of paint it.
    """
    img = F.col("image_id")
    times = whole(unit(seed, "times", img), _n(min_times), _n(max_times + 1))
    # a few bytes an image become hundreds of rows, so images are dealt out by number, which is not coalesced for being small
    dealt = images.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    rows = dealt.select(*IMAGE, F.explode(F.when(times > 0, F.sequence(_n(0), times - 1))).alias("stroke"))
    s = F.col("stroke")
    draw = lambda name, low, high: whole(unit(seed, name, img, s), low, high)
    rows = rows.withColumns({"sx": draw("x", _n(0), F.col("w")), "sy": draw("y", _n(0), F.col("h")), "n": draw("n", _n(1), _n(6))})
    kind = "struct<x:bigint,y:bigint,out:array<struct<segment:bigint,x0:bigint,y0:bigint,x1:bigint,y1:bigint,width:bigint>>>"

    def step(acc: Column, j: Column) -> Column:
        angle = whole(unit(seed, F.concat(F.lit("a"), j.cast("string")), img, s), _n(0), _n(max_angle)) + 0.01
        angle = F.when(s % 2 == 0, 2 * 3.1415926 - angle).otherwise(angle)  # fixed value
        length = whole(unit(seed, F.concat(F.lit("l"), j.cast("string")), img, s), _n(10), _n(10 + max_len))
        width = whole(unit(seed, F.concat(F.lit("b"), j.cast("string")), img, s), _n(5), _n(5 + max_width))
        x = F.greatest(_n(0), F.least(F.col("w").cast("long"), (acc["x"] + length * F.sin(angle)).cast("long")))
        y = F.greatest(_n(0), F.least(F.col("h").cast("long"), (acc["y"] + length * F.cos(angle)).cast("long")))
        one = F.struct(j.alias("segment"), acc["x"].alias("x0"), acc["y"].alias("y0"), x.alias("x1"), y.alias("y1"), width.alias("width"))
        return F.struct(x.alias("x"), y.alias("y"), F.concat(acc["out"], F.array(one)).alias("out")).cast(kind)

    start = F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"), F.array().alias("out")).cast(kind)
    walk = F.aggregate(F.sequence(_n(0), F.col("n") - 1), start, step, lambda acc: acc["out"])
    return rows.select("image_id", "stroke", F.explode(walk).alias("p")).select("image_id", "stroke", "p.*")


def squares_of(strokes: DataFrame) -> DataFrame:
    """Strokes painted as squares around their starts -> image_id, y0, y1, x0, x1."""
    r = F.floor(F.col("width") / 2).cast("long")
    return strokes.select("image_id", (F.col("y0") - r).alias("y0"), (F.col("y0") + r).alias("y1"), (F.col("x0") - r).alias("x0"), (F.col("x0") + r).alias("x1"))


def circles_of(strokes: DataFrame) -> DataFrame:
    """Strokes painted as discs of radius ``width`` around their starts, a row of pixels each -> image_id, y0, y1, x0, x1."""
    rows = strokes.select("image_id", "x0", "width", "y0", F.explode(F.sequence(-F.col("width"), F.col("width"))).alias("d"))
    half = F.floor(F.sqrt((F.col("width") * F.col("width") - F.col("d") * F.col("d")).cast("double"))).cast("long")
    y = F.col("y0") + F.col("d")
    return rows.select("image_id", y.alias("y0"), (y + 1).alias("y1"), (F.col("x0") - half).alias("x0"), (F.col("x0") + half + 1).alias("x1"))


def lines_of(strokes: DataFrame) -> DataFrame:
    """Strokes painted as segments of thickness ``width`` with round ends, a row of pixels each -> image_id, y0, y1, x0, x1.

    A row's pixels are those between the outermost points that the end discs and the two long edges have in it.
    """
    s = strokes.select("image_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], (F.col("width") / 2.0).alias("r"))
    # all that is one number a segment stays below the rows, or every row would work it out again
    s = s.withColumns({"run": F.col("x1") - F.col("x0"), "rise": F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)), "rr": F.col("r") * F.col("r")})
    n = F.nullif(F.sqrt(F.col("run") * F.col("run") + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))), F.lit(0.0))
    s = s.withColumn("n", n)
    for k, side in enumerate((1.0, -1.0)):
        oy = side * F.col("r") * F.col("run") / F.col("n")
        s = s.withColumns({f"b{k}": F.col("x0") + -side * F.col("r") * (F.col("y1") - F.col("y0")) / F.col("n"), f"a{k}": F.col("y0") + oy, f"z{k}": F.col("y1") + oy})
        s = s.withColumns({f"l{k}": F.least(f"a{k}", f"z{k}"), f"h{k}": F.greatest(f"a{k}", f"z{k}")})
    s = s.withColumns({"low": F.floor(F.least("y0", "y1") - F.col("r")).cast("long"), "high": F.ceil(F.greatest("y0", "y1") + F.col("r")).cast("long")})
    used = ["image_id", "x0", "y0", "x1", "y1", "r", "rr", "run", "rise", *[f"{c}{k}" for k in (0, 1) for c in "balh"]]
    s = s.select(*used, F.explode(F.sequence("low", "high")).alias("y"))
    for k in (0, 1):
        d = F.col("y") - F.col(f"y{k}")
        on = (F.col("y") >= F.col(f"l{k}")) & (F.col("y") <= F.col(f"h{k}"))
        s = s.withColumns({f"reach{k}": F.when(F.abs(d) <= F.col("r"), F.sqrt(F.col("rr") - d * d)), f"edge{k}": F.when(on, F.col(f"b{k}") + (F.col("y") - F.col(f"a{k}")) / F.col("rise") * F.col("run"))})
    found = [f(F.col(f"x{k}"), F.col(f"reach{k}")) for k in (0, 1) for f in (operator.sub, operator.add)] + [F.col("edge0"), F.col("edge1")]
    rows = s.select("image_id", "y", F.least(*found).alias("lo"), F.greatest(*found).alias("hi"))
    rows = rows.select("image_id", F.col("y").alias("y0"), (F.col("y") + 1).alias("y1"), F.ceil("lo").cast("long").alias("x0"), (F.floor("hi") + 1).cast("long").alias("x1"))
    return rows.where("x1 > x0")


def choose_kind(seed: int, probabilities: dict[str, float], *keys: Column) -> Column:
    """A name drawn with normalised probabilities."""
    u, total, before = unit(seed, "kind", *keys), sum(probabilities.values()), 0.0
    out = None
    names = [k for k, p in probabilities.items() if p > 0]
    for k in names[:-1]:
        before += probabilities[k]
        out = F.when(u < before / total, k) if out is None else out.when(u < before / total, k)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


#: Generators by name: (images, seed) -> rectangles.
GENERATORS = {
    "box": lambda images, seed: gen_rectangles(images, seed).drop("i"),
    "superres": lambda images, seed: gen_stripes(images, seed).drop("axis", "i"),
    "dumb": lambda images, seed: gen_area(images, seed, True),
    "outpainting": lambda images, seed: gen_border(images, seed).drop("side"),
    "squares": lambda images, seed: squares_of(gen_strokes(images, seed)),
    "circles": lambda images, seed: circles_of(gen_strokes(images, seed)),
    "lines": lambda images, seed: lines_of(gen_strokes(images, seed)),
}


def mixed_masks(images: DataFrame, probabilities: dict[str, float], seed: int, invert: float = 0.0) -> DataFrame:
    """Each image's rectangles from one generator drawn by probability -> image_id, kind, inverted, y0, y1, x0, x1."""
    chosen = images.withColumn("kind", choose_kind(seed, probabilities, F.col("image_id"))).withColumn("inverted", unit(seed, "invert", F.col("image_id")) < invert)
    out = None
    for name, p in probabilities.items():
        if p > 0:
            part = GENERATORS[name](chosen.where(F.col("kind") == name), seed).join(chosen.select("image_id", "kind", "inverted"), "image_id")
            out = part if out is None else out.unionByName(part)
    return out.select("image_id", "kind", "inverted", "y0", "y1", "x0", "x1")


def debug_windows(images: DataFrame, size: int = 200, step: float = 0.5) -> DataFrame:
    """Sliding square windows -> image_id, y0, y1, x0, x1, cut at the image's edge."""
    by = int(size * step)
    starts = lambda n: F.when(F.col(n) - by > 0, F.sequence(_n(0), (F.col(n) - by - 1).cast("long"), _n(by)))
    rows = images.select(*IMAGE, F.explode(starts("h")).alias("y0")).select("*", F.explode(starts("w")).alias("x0"))
    end = lambda c, n: F.least(F.col(c) + size, F.col(n).cast("long"))
    return rows.select("image_id", "y0", end("y0", "h").alias("y1"), "x0", end("x0", "w").alias("x1"))


def border_mask(images: DataFrame, coef: float, expand: bool) -> DataFrame:
    """Outpainting border of int(size * coef / 2) on every side -> image_id, out_w, out_h, y0, y1, x0, x1 (four rectangles).

    expand: the canvas grows by the border; else the border lies inside. Without a border there are no rows.
    """
    ph, pw = (F.col("h") * coef / 2).cast("long"), (F.col("w") * coef / 2).cast("long")
    oh, ow = (F.col("h") + 2 * ph if expand else F.col("h")).cast("long"), (F.col("w") + 2 * pw if expand else F.col("w")).cast("long")
    zero = _n(0)
    rects = [(zero, ph, zero, ow), (oh - ph, oh, zero, ow), (zero, oh, zero, pw), (zero, oh, ow - pw, ow)]
    made = F.array(*[F.struct(*[c.alias(n) for c, n in zip(r, ("y0", "y1", "x0", "x1"), strict=True)]) for r in rects])
    return images.select("image_id", ow.alias("out_w"), oh.alias("out_h"), F.explode(made).alias("r")).select("image_id", "out_w", "out_h", "r.*").where("y1 > y0 and x1 > x0")


def mask_area(rects: DataFrame, dims: DataFrame) -> DataFrame:
    """rects(mask_id, ...), dims(mask_id, w, h) -> mask_id, area, share of the image."""
    area = union_area(rects, "mask_id")
    out = dims.join(area, "mask_id", "left").withColumn("area", F.coalesce("area", F.lit(0)).cast("long"))
    return out.select("mask_id", "area", (F.col("area") / (F.col("w") * F.col("h"))).alias("share"))


def rect_pairs(rects: DataFrame) -> DataFrame:
    """Masks of one image with a pixel in common: image_id, a, b with a < b."""
    r = ["y0", "y1", "x0", "x1"]
    a = rects.select("image_id", F.col("mask_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in r])
    b = rects.select("image_id", F.col("mask_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in r])
    both = overlap_join(a, b, (F.col("a_y0"), F.col("a_y1")), (F.col("b_y0"), F.col("b_y1")), ["image_id"], BAND)
    both = both.where((F.col("a") < F.col("b")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1")) & (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")))
    return both.select("image_id", "a", "b").distinct()


def overlap_pairs(rects: DataFrame, scores: DataFrame, cap: int = 2) -> DataFrame:
    """Pairs of overlapping masks, the first ``cap`` partners of each in order of id, with the difference of their scores."""
    pairs = rect_pairs(rects)
    rank = F.row_number().over(Window.partitionBy("image_id", "a").orderBy("b"))
    pairs = pairs.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")
    s = scores.select("mask_id", "score")
    out = pairs.join(s.withColumnsRenamed({"mask_id": "a", "score": "sa"}), "a").join(s.withColumnsRenamed({"mask_id": "b", "score": "sb"}), "b")
    return out.select("image_id", "a", "b", (F.col("sb") - F.col("sa")).alias("score_diff"))


def accept_masks(candidates: DataFrame, existing: DataFrame, limit_existing: float, limit_current: float) -> DataFrame:
    """candidates and existing (image_id, mask_id, y0, y1, x0, x1; a row per rectangle of the mask) -> mask_id, the largest shares of an
    existing mask and of the candidate that they have in common, accepted (both within their limits).

    Areas are those of the unions. A candidate whose image has no existing mask has shares of 0.
    """
    r = ["y0", "y1", "x0", "x1"]
    e = existing.select("image_id", F.col("mask_id").alias("e_id"), *[F.col(c).alias(f"e_{c}") for c in r])
    cut = [f(c, f"e_{c}").alias(c) for c, f in zip(r, (F.greatest, F.least) * 2, strict=True)]
    mine = candidates.select("image_id", "mask_id", *r)
    met = overlap_join(mine, e, (F.col("y0"), F.col("y1")), (F.col("e_y0"), F.col("e_y1")), ["image_id"], BAND)
    met = met.select("mask_id", "e_id", *cut).where("y0 < y1 and x0 < x1")
    common = union_area(met.withColumn("pair", F.struct("mask_id", "e_id")), "pair").select("pair.mask_id", "pair.e_id", F.col("area").alias("common"))
    own = union_area(candidates, "mask_id").withColumnRenamed("area", "own")
    other = union_area(existing, "mask_id").select(F.col("mask_id").alias("e_id"), F.col("area").alias("other"))
    most = common.join(own, "mask_id").join(other, "e_id").groupBy("mask_id").agg(F.max(F.col("common") / F.col("other")).alias("of_existing"), F.max(F.col("common") / F.col("own")).alias("of_current"))
    every = candidates.select("mask_id").distinct()
    g = every.join(most, "mask_id", "left").select("mask_id", *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (("of_existing", "max_inter_existing"), ("of_current", "max_inter_current"))])
    return g.withColumn("accepted", (F.col("max_inter_existing") <= limit_existing) & (F.col("max_inter_current") <= limit_current))


def candidates(segments: DataFrame, dims: DataFrame, max_share: float = 0.3) -> DataFrame:
    """(sample_id, seg_id, is_thing, n_px), dims(sample_id, w, h) -> things with less than max_share of the image."""
    g = segments.groupBy("sample_id", "seg_id").agg(F.bool_or("is_thing").alias("thing"), F.sum("n_px").alias("n_px"))
    out = g.where("thing").join(dims, "sample_id").withColumn("share", F.col("n_px") / (F.col("w") * F.col("h")))
    return out.where(F.col("share") < max_share).select("sample_id", "seg_id", "share")


def square_crop(masks: DataFrame, seed: int, min_overlap: float = 0.5) -> DataFrame:
    """masks (mask_id, w, h and bounding box y0, y1, x0, x1 with closed ends) -> a square crop with half the object in it: x0, y0, x1, y1."""
    wide = F.col("h") < F.col("w")
    size, full = F.least("w", "h"), F.greatest("w", "h")
    low, high = F.when(wide, F.col("x0")).otherwise(F.col("y0")), F.when(wide, F.col("x1")).otherwise(F.col("y1"))
    edge = low + (high - low) * min_overlap
    first = F.greatest(F.lit(0.0), F.least((full - size - 1).cast("double"), edge - size))
    last = F.greatest(first + 1, F.least((full - size).cast("double"), edge))
    start = whole(unit(seed, "crop", F.col("mask_id")), first.cast("long"), last.cast("long"))
    end = start + size
    zero = _n(0)
    return masks.select(
        "mask_id", F.when(wide, start).otherwise(zero).alias("cx0"), F.when(wide, zero).otherwise(start).alias("cy0"),
        F.when(wide, end).otherwise(F.col("w").cast("long")).alias("cx1"), F.when(wide, F.col("h").cast("long")).otherwise(end).alias("cy1"),
    )


def area_crop(images: DataFrame, seed: int, area: int = 256 * 256, mod: int = 16, min_size: int = 128, max_size: int = 512) -> DataFrame:
    """Crops of about constant area, sides rounded up to a multiple -> image_id, start_y, start_x, out_h, out_w."""
    img = F.col("image_id")
    lo, hi = F.least(F.col("h"), F.col("w"), F.lit(min_size)).cast("long"), F.least(F.col("h"), F.col("w"), F.lit(max_size)).cast("long")
    up = lambda x: (F.ceil(x / mod) * mod).cast("long")
    one = F.least(hi, up(whole(unit(seed, "side", img), lo, hi + 1)))
    two = F.least(hi, up(F.floor(F.lit(area) / one)))
    tall = unit(seed, "which", img) < 0.5
    oh, ow = F.when(tall, one).otherwise(two), F.when(tall, two).otherwise(one)
    rows = images.select(*IMAGE, oh.alias("out_h"), ow.alias("out_w"))
    return rows.select(
        "image_id", whole(unit(seed, "sy", img), _n(0), F.col("h") - F.col("out_h") + 1).alias("start_y"), whole(unit(seed, "sx", img), _n(0), F.col("w") - F.col("out_w") + 1).alias("start_x"), "out_h", "out_w",
    )


def curriculum(images: DataFrame, seed: int, iteration: Column, end: int) -> DataFrame:
    """Random rectangles whose limits grow linearly until iteration ``end``."""
    return gen_rectangles(images, seed, ramp=linear_ramp(iteration, 0.0, 1.0, 0, end))


def mask_dataset(images: DataFrame, probabilities: dict[str, float], variants: int, max_area: float, max_per_image: int, seed: int) -> DataFrame:
    """Masks of every image and variant, without those above max_area, at most max_per_image of each image, drawn by hash.

    -> image_id, variant, mask_id, kind, area, share.
    """
    fan = images.select(F.col("image_id").alias("base_id"), "w", "h", F.explode(F.sequence(_n(0), _n(variants - 1))).alias("variant"))
    fan = fan.withColumn("image_id", F.col("base_id") * variants + F.col("variant"))
    rects = mixed_masks(fan.select("image_id", "w", "h"), probabilities, seed).withColumnRenamed("image_id", "mask_id")
    sized = mask_area(rects, fan.select(F.col("image_id").alias("mask_id"), "w", "h")).where((F.col("area") > 0) & (F.col("share") <= max_area))
    sized = sized.withColumn("kind", choose_kind(seed, probabilities, F.col("mask_id")))  # drawn once more, not looked up among the rectangles
    sized = sized.withColumns({"image_id": F.floor(F.col("mask_id") / variants), "variant": F.col("mask_id") % variants})
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(unit(seed, "keep", F.col("mask_id")), "mask_id"))
    return sized.withColumn("rank_", rank).where(F.col("rank_") <= max_per_image).select("image_id", "variant", "mask_id", "kind", "area", "share")


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every i the numbers start[i] .. start[i] + count[i] - 1, and i beside each of them."""
    i = np.repeat(np.arange(len(count)), count)
    return i, start[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def _disjoint(strip: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of strips in order, cut so that they cover the same without covering anything twice."""
    o = np.lexsort((b, a, strip))
    strip, a, b = strip[o], a[o], b[o]
    if len(strip) > 1:
        ends, rank = np.unique(b, return_inverse=True)
        first = np.r_[True, strip[1:] != strip[:-1]]
        run = np.cumsum(first)
        far = np.maximum.accumulate(run * len(ends) + rank) - run * len(ends)
        a = np.where(first, a, np.maximum(a, ends[np.r_[0, far[:-1]]]))
    held = a < b
    return strip[held], a[held], b[held]


def _placed(c: dict[str, np.ndarray], counts: np.ndarray, tries: np.ndarray, limit: float, min_share: float) -> tuple[np.ndarray, ...]:
    """Moved rectangles of masks: their number in the batch and y0, y1, x0, x1.

    c has a value a mask, but for y0, y1, x0, x1 (counts of them a mask) and order (tries of them). All masks of a batch are worked on at once.
    """
    n, of = len(counts), np.repeat(np.arange(len(counts)), counts)
    kept = lambda x, most: np.clip(np.rint(x), 0, most).astype(np.int64)
    y = lambda e: kept(c["cy"][of] + (e - c["my"][of]) * c["factor"][of], c["h"][of])
    x = lambda e: (e - c["mx"][of]) * c["factor"][of]
    flip, y0, y1, left, right = c["flip"][of], y(c["y0"]), y(c["y1"]), x(c["x0"]), x(c["x1"])
    live = y0 < y1
    m, y0, y1 = of[live], y0[live], y1[live]
    a = (c["cx"][of] + np.where(flip, -right, left))[live]
    b = (c["cx"][of] + np.where(flip, -left, right))[live]
    # strips lie between neighbouring edges of a mask; a rectangle has those between its own edges
    low = min(int(c["y0"].min()), 0)
    size = max(int(c["y1"].max()), int(c["h"].max())) - low + 1
    edge = lambda mask, e: mask * size + (e - low)
    edges = np.unique(np.concatenate([edge(of, c["y0"]), edge(of, c["y1"]), edge(m, y0), edge(m, y1)]))
    tall, mask = np.diff(edges, append=edges[-1:]), edges // size

    def pieces(owner, top, bottom, left, right):
        i = np.searchsorted(edges, edge(owner, top))
        r, strip = _ranges(i, np.searchsorted(edges, edge(owner, bottom)) - i)
        return _disjoint(strip, left[r], right[r])

    theirs, t_a, t_b = pieces(of, c["y0"], c["y1"], c["x0"].astype(float), c["x1"].astype(float))
    mine, m_a, m_b = pieces(m, y0, y1, a, b)
    total = lambda at, value: np.bincount(mask[at], tall[at] * value, n)
    own = total(theirs, t_b - t_a)
    begin = np.searchsorted(theirs, mine)
    p, q = _ranges(begin, np.searchsorted(theirs, mine, side="right") - begin)
    shift, left_over, first = np.zeros(n, np.int64), np.ones(n, bool), np.cumsum(tries) - tries
    for k in range(int(tries.max())):
        left_over &= tries > k
        some = left_over[mask[mine]]
        if not some.any():
            break
        # from here on only the pieces of masks that have no place yet
        number = np.cumsum(some) - 1
        pairs = some[p]
        mine, m_a, m_b, p, q = mine[some], m_a[some], m_b[some], number[p[pairs]], q[pairs]
        d = c["order"][np.minimum(first + k, len(c["order"]) - 1)]
        at = mask[mine]
        to_a, to_b = kept(m_a + d[at], c["w"][at]), kept(m_b + d[at], c["w"][at])
        area = total(mine, to_b - to_a)
        both = total(mine[p], np.maximum(0, np.minimum(to_b[p], t_b[q]) - np.maximum(to_a[p], t_a[q])))
        fits = left_over & (area > 0) & (area >= min_share * c["w"] * c["h"]) & (both <= limit * np.minimum(own, area))
        shift[fits], left_over = d[fits], left_over & ~fits
        c["done"][fits] = True
    good = c["done"][m]
    m, y0, y1 = m[good], y0[good], y1[good]
    x0, x1 = (kept(e[good] + shift[m], c["w"][m]) for e in (a, b))
    seen = x0 < x1
    return m[seen], y0[seen], y1[seen], x0[seen], x1[seen]


def place(rects: DataFrame, dims: DataFrame, seed: int, variants: int = 2, limit: float = 0.5, min_share: float = 0.02, scale=0.2, shift=0.1) -> DataFrame:
    """Moved copies of masks (a row per rectangle): scaled, flipped and shifted as a whole by draws, cut at the image, and kept if they
    overlap the original by no more than ``limit`` and cover min_share of the image -> mask_id, variant, y0, y1, x0, x1, a row per rectangle.

    Between two neighbouring edges of y, mask and copy are spans of x. Those of the copy are made disjoint once and only moved for each of the
    horizontal shifts, so what a shift covers, and what it has in common with the mask, are sums over spans. Of the shifts that fit, the first in
    a drawn order is taken; they are tried in that order, in arrays over the masks of a batch that have no place yet. A mask is one row from its
    rectangles to its copies. Rectangles that a copy has no pixels of are left out; so are masks without a rectangle or size.
    """
    ends = ["y0", "y1", "x0", "x1"]
    w, h, own = F.col("w"), F.col("h"), F.col("mask_id")
    masks = rects.where("y1 > y0 and x1 > x0").groupBy("mask_id").agg(
        F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ends])).alias("rects"),
        *[f(c).cast("double").alias(n) for f, c, n in ((F.min, "y0", "top"), (F.max, "y1", "bottom"), (F.min, "x0", "left"), (F.max, "x1", "right"))],
    )
    rows = masks.join(dims.select("mask_id", w.cast("long").alias("w"), h.cast("long").alias("h")).where("w >= 2 and h is not null"), "mask_id")
    rows = rows.withColumn("variant", F.explode(F.sequence(_n(0), _n(variants - 1))))
    u = lambda name: unit(seed, name, own, F.col("variant"))
    rows = rows.withColumns({"factor": (1 - scale) + 2 * scale * u("scale"), "flip": u("flip") < 0.5, "my": (F.col("top") + F.col("bottom")) / 2, "mx": (F.col("left") + F.col("right")) / 2})
    rows = rows.withColumns({"cy": F.col("my") + (2 * shift * u("shift") - shift) * h, "cx": F.when(F.col("flip"), w - F.col("mx")).otherwise(F.col("mx"))})
    half = F.floor(w / 2)
    draw = lambda d: unit(seed, F.concat(F.lit("x"), d.cast("string")), own, F.col("variant"))
    drawn = F.array_sort(F.transform(F.sequence(-half, half - 1, F.greatest(_n(1), F.floor(w / 16))), lambda d: F.struct(draw(d).alias("u"), d.alias("d"))))
    one = ["mask_id", "variant", "w", "h", "factor", "flip", "my", "mx", "cy", "cx"]
    rows = rows.withColumn("drawn", drawn).select(*one, F.col("drawn.d").alias("order"), *[F.col(f"rects.{c}").alias(c) for c in ends])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in one} | {n: b.column(n).flatten().to_numpy() for n in ("order", *ends)}
            counts, tries = (b.column(n).value_lengths().to_numpy() for n in ("y0", "order"))
            m, *out = _placed(c | {"done": np.zeros(b.num_rows, bool)}, counts, tries, limit, min_share)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c["mask_id"][m], c["variant"][m], *out)], ["mask_id", "variant", *ends])

    return rows.mapInArrow(run, f"mask_id {dict(rects.dtypes)['mask_id']}, variant long, y0 long, y1 long, x0 long, x1 long")
