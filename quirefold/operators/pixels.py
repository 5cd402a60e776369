"""Pixel tables: down-sampling, thresholds, colours, composites, similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.geometry import lab_distance, lit, rgb_to_lab

# Guards of the fill colour.
MIN_MASK, MIN_GLYPH, MIN_BACKGROUND = 30, 20, 50


def mode_2x2(a: Column, b: Column, c: Column, d: Column, how: str = "mode") -> Column:
    """The most frequent of four values, d without a repeat. raw: a repeated 0 doesn't count. stippled: 0 is background."""
    if how == "mode":
        return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(d)
    twice = F.when((a == b) | (a == c), F.nullif(a, F.lit(0))).when(b == c, F.nullif(b, F.lit(0)))
    if how == "raw":
        return F.coalesce(twice, d)
    return F.coalesce(twice, F.nullif(d, F.lit(0)), F.nullif(a, F.lit(0)), F.nullif(b, F.lit(0)), c)


def downsample(pixels: DataFrame, how: str = "mode", factor: int = 2) -> DataFrame:
    """(page_id, y, x, v) -> the same at 1/factor of the size.

    mode, raw, stippled: mode_2x2 of each whole block of four. counting: the most frequent value, the one first in
    reading order among equals. average (cut to whole numbers), max, stride: of any factor.
    """
    y, x = F.floor(F.col("y") / factor).cast("long").alias("y"), F.floor(F.col("x") / factor).cast("long").alias("x")
    if how == "stride":
        return pixels.where((F.col("y") % factor == 0) & (F.col("x") % factor == 0)).select("page_id", y, x, "v")
    if how == "counting":
        n = pixels.groupBy("page_id", y, x, "v").agg(F.count("*").alias("n"), F.min(F.struct(F.col("y").alias("py"), F.col("x").alias("px"))).alias("at"))
        return n.groupBy("page_id", "y", "x").agg(F.min(F.struct((-F.col("n")).alias("n"), "at", "v"))["v"].alias("v"))
    g = pixels.groupBy("page_id", y, x)
    if how == "average":
        return g.agg(F.floor(F.avg("v")).cast("long").alias("v"))
    if how == "max":
        return g.agg(F.max("v").alias("v"))
    at = lambda i, j: F.max(F.when((F.col("y") % 2 == i) & (F.col("x") % 2 == j), F.col("v")))
    cells = g.agg(at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("c"), at(1, 1).alias("d")).where("a is not null and b is not null and c is not null and d is not null")
    return cells.select("page_id", "y", "x", mode_2x2(*[F.col(k) for k in "abcd"], how).alias("v"))


def downsample_blocks(voxels: DataFrame, factor: tuple[int, int, int] = (2, 2, 2)) -> DataFrame:
    """(vol_id, z, y, x, v) -> the same by blocks: the value with most copies (two at least), earliest first among equals, else the last cell."""
    dims = [F.floor(F.col(c) / f).cast("long").alias(c) for c, f in zip("zyx", factor, strict=True)]
    n = voxels.groupBy("vol_id", *dims, "v").agg(F.count("*").alias("n"), F.min(F.struct("z", "y", "x")).alias("first"), F.max(F.struct("z", "y", "x")).alias("last"))
    best = n.groupBy("vol_id", "z", "y", "x").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "v")).alias("m"), F.max(F.struct("last", "v")).alias("e"))
    return best.select("vol_id", "z", "y", "x", F.when(F.col("m.n") <= -2, F.col("m.v")).otherwise(F.col("e.v")).alias("v"))


def otsu(values: DataFrame) -> DataFrame:
    """(grp, v in 0..255) -> grp, threshold: the first maximum of the between-class variance; 128 where there is one class only."""
    hist = values.where("v is not null").groupBy("grp", F.col("v").cast("long").alias("v")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("grp").orderBy("v")
    group = Window.partitionBy("grp")
    h = hist.withColumns(
        {"wb": F.sum("n").over(up), "sb": F.sum(F.col("n") * F.col("v")).over(up), "total": F.sum("n").over(group), "sum": F.sum(F.col("n") * F.col("v")).over(group)}
    )
    wf = F.col("total") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("sum") - F.col("sb")) / F.when(wf > 0, wf)
    # values between two that occur have the lower one's classes, so the first maximum is one that occurs
    h = h.withColumn("var", F.when(wf > 0, F.col("wb") * wf * gap * gap))
    best = h.groupBy("grp").agg(F.min(F.when(F.col("var").isNotNull(), F.struct((-F.col("var")).alias("s"), "v"))).alias("m"))
    return best.select("grp", F.coalesce("m.v", F.lit(128)).cast("long").alias("threshold"))


def fill_color(pixels: DataFrame) -> DataFrame:
    """(bubble_id, r, g, b, in_mask) -> bubble_id, r, g, b: the median colour of the glyph pixels.

    Glyphs are the masked pixels that are further from the background's median colour (all pixels, if the
    background is small) than Otsu's threshold of those distances, scaled by their 98th percentile;
    all masked pixels if the threshold is under 3 or leaves too few or nearly all. Bubbles with few
    masked pixels have no row.
    """
    n = pixels.groupBy("bubble_id").agg(F.count_if("in_mask").alias("n_mask"), F.count_if(~F.col("in_mask")).alias("n_bg"))
    p = pixels.join(n.where(F.col("n_mask") >= MIN_MASK), "bubble_id")
    is_bg = ~F.col("in_mask") | (F.col("n_bg") < MIN_BACKGROUND)
    bg = p.where(is_bg).groupBy("bubble_id").agg(*[F.median(c).alias(f"bg_{c}") for c in "rgb"])
    p = p.join(bg, "bubble_id").where("in_mask")
    p = p.withColumn("d", lab_distance(rgb_to_lab(*[F.col(c).cast("double") for c in "rgb"]), rgb_to_lab(*[F.col(f"bg_{c}") for c in "rgb"])))
    top = p.groupBy("bubble_id").agg(F.percentile("d", 0.98).alias("top"))
    p = p.join(top, "bubble_id")
    level = F.least(lit(255), F.greatest(lit(0), F.col("d") / F.col("top") * 255)).cast("int")
    cut = otsu(p.where("top > 1e-3").select(F.col("bubble_id").alias("grp"), level.alias("v"))).withColumnRenamed("grp", "bubble_id")
    p = p.join(cut, "bubble_id", "left").withColumn("thr", F.col("threshold") / 255.0 * F.col("top"))
    p = p.withColumn("glyph", F.coalesce((F.col("thr") < 3.0) | (F.col("d") > F.col("thr")), F.lit(True)))
    count = F.sum(F.col("glyph").cast("long")).over(Window.partitionBy("bubble_id"))
    p = p.withColumn("n_glyph", count)
    use = F.col("glyph") | (F.col("n_glyph") < MIN_GLYPH) | (F.col("n_glyph") > 0.95 * F.col("n_mask"))
    return p.where(use).groupBy("bubble_id").agg(*[F.median(c).alias(c) for c in "rgb"])


def white_mask(pixels: DataFrame) -> DataFrame:
    """Pixels whose value is 255."""
    return pixels.where("v = 255").select("page_id", "y", "x")


def composite(image: DataFrame, mask: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """(page_id, y, x, v), mask(page_id, y, x, m) -> (1 - m) * image + m * predicted; the image shows through a soft mask without prediction."""
    out = image.join(mask, ["page_id", "y", "x"], "left").withColumn("m", F.coalesce("m", lit(0)))
    other = F.col("v")
    if predicted is not None:
        out = out.join(predicted.withColumnRenamed("v", "p"), ["page_id", "y", "x"], "left")
        other = F.coalesce("p", "v")
    return out.select("page_id", "y", "x", ((1 - F.col("m")) * F.col("v") + F.col("m") * other).alias("v"))


def class_counts(pred: DataFrame, target: DataFrame, mask: DataFrame) -> DataFrame:
    """(sample_id, y, x, cls) twice, mask(sample_id, y, x) -> sample_id, class_id, n_total, n_mask_target, n_mask_pred.

    n_total counts target pixels; the others those within the mask. Pixels without a prediction count as none.
    """
    at = ["sample_id", "y", "x"]
    both = target.select(*at, F.col("cls").alias("t")).join(pred.select(*at, F.col("cls").alias("p")), at, "left").join(mask.select(*at).distinct().withColumn("m", F.lit(1)), at, "left")
    inside = F.col("m").isNotNull().cast("long")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    row = lambda c, n, t, p: F.struct(F.col(c).alias("c"), n.alias("n"), t.alias("mt"), p.alias("mp"))
    long = both.select("sample_id", F.explode(F.array(row("t", one, inside, none), row("p", none, none, inside))).alias("r"))
    out = long.where("r.c is not null").groupBy("sample_id", F.col("r.c").alias("class_id")).agg(F.sum("r.n").alias("n_total"), F.sum("r.mt").alias("n_mask_target"), F.sum("r.mp").alias("n_mask_pred"))
    return out


def _gauss(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return g / g.sum()


def ssim_of(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity of two pages in 0..1: 11 x 11 Gaussian windows, zeros around the page."""
    g = _gauss()

    def blur(x):
        for axis in (0, 1):
            x = np.apply_along_axis(lambda v: np.convolve(v, g, mode="full")[5:-5], axis, x)
        return x

    ma, mb = blur(a), blur(b)
    va, vb, cab = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    return float((((2 * ma * mb + 1e-4) * (2 * cab + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4))).mean())


#: Weights of the window along an axis, and rows of a page that are handled together.
WEIGHTS = _gauss().tolist()
REACH = len(WEIGHTS) // 2
BLOCK = 512


def _across(values: Column) -> Column:
    """Weighted sums along a row, with zeros around it."""
    near = lambda x: sum((F.coalesce(F.try_element_at(values, (x + (k - REACH + 1)).cast("int")), lit(0)) if k > REACH else F.when(x >= REACH - k, F.get(values, x + (k - REACH))).otherwise(lit(0))) * g for k, g in enumerate(WEIGHTS))
    return F.transform(F.sequence(F.lit(0), F.size(values) - 1), near)


def ssim(pred: DataFrame, target: DataFrame, block: int = BLOCK) -> DataFrame:
    """page rows (page_id, y, px array) twice, values 0..255 -> page_id, ssim: the mean of the structural similarity in 11 x 11 Gaussian windows, zeros around the page.

    The window is two sums: along a row where it stands, then down the REACH rows above and below, in blocks of rows that overlap by as many.
    So no task needs a whole page. Pages of which a row is missing on one side, null, empty, or longer on one side give no row.
    """
    rows = pred.select("page_id", "y", F.col("px").alias("p")).join(target.select("page_id", "y", F.col("px").alias("t")), ["page_id", "y"], "full")
    good = F.coalesce((F.size("p") > 0) & (F.size("p") == F.size("t")), F.lit(False))
    unit = lambda c: F.transform(c, lambda v: v / lit(255.0))
    rows = rows.withColumn("good", good).withColumns({c: F.when(F.col("good"), unit(F.col(c))).otherwise(F.array().cast("array<double>")) for c in ("p", "t")})
    product = lambda x, y: F.zip_with(x, y, lambda a, b: a * b)
    moments = {"m_p": F.col("p"), "m_t": F.col("t"), "pp": product("p", "p"), "tt": product("t", "t"), "pt": product("p", "t")}
    rows = rows.select("page_id", "y", "good", *[c.alias(n) for n, c in moments.items()])
    rows = rows.select("page_id", "y", "good", *[F.when(F.size(n) > 0, _across(F.col(n))).otherwise(F.col(n)).alias(n) for n in moments])

    first, last = (F.floor((F.col("y") + d) / block) for d in (-REACH, REACH))
    dealt = rows.withColumn("block", F.explode(F.sequence(first, last)))
    frame = Window.partitionBy("page_id", "block").orderBy("y").rangeBetween(-REACH, REACH)
    dealt = dealt.withColumn("near", F.collect_list(F.struct("y", *moments)).over(frame)).where(F.floor(F.col("y") / block) == F.col("block"))
    weights = F.array(*[lit(g) for g in WEIGHTS])

    def down(name: str) -> Column:
        part = lambda x: F.aggregate("near", lit(0.0), lambda acc, r: acc + F.get(weights, (r["y"] - F.col("y") + REACH).cast("int")) * F.coalesce(F.get(r[name], x), lit(0.0)))
        return F.transform(F.sequence(F.lit(0), F.size(name) - 1), part)

    blurred = dealt.select("page_id", "good", *[F.when(F.size(n) > 0, down(n)).otherwise(F.col(n)).alias(n) for n in moments])

    def similarity(z: Column) -> Column:
        a, b = z["m_p"], z["m_t"]
        return ((2 * a * b + 1e-4) * (2 * (z["pt"] - a * b) + 9e-4)) / ((a * a + b * b + 1e-4) * ((z["pp"] - a * a) + (z["tt"] - b * b) + 9e-4))

    values = F.transform(F.arrays_zip(*moments), similarity)
    sums = blurred.select("page_id", "good", F.aggregate(values, lit(0.0), lambda acc, v: acc + v).alias("s"), F.size(values).alias("n"))
    out = sums.groupBy("page_id").agg(F.bool_and("good").alias("good"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return out.where("good").select("page_id", (F.col("s") / F.col("n")).alias("ssim"))

