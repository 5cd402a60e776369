"""Layout of bubbles: inputs, fit areas, presets, fonts, shape quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.geometry import Box, inset_box, let, lit, mix_box, scale_box
from quirefold.functions.text import STRIP, norm_token, words

# Presets of the layout profile.
PARAMETERS = ("alpha", "min_factor", "line_break_penalty", "shape_penalty", "center_peak_penalty", "hyphen_break_penalty")
PRESETS = (
    ("rect", 0.55, 0.80, 0.78, 1.8, 1.5, 5.5),
    ("mild", 0.75, 0.62, 0.55, 2.5, 2.0, 5.0),
    ("ellipse", 0.85, 0.55, 0.45, 2.8, 2.2, 5.0),
    ("tapered", 0.90, 0.50, 0.40, 3.0, 2.5, 4.8),
)
LIMITS = ((0.0, 0.95), (0.45, 1.0), (0.0, 4.0), (0.0, 8.0), (0.0, 8.0), (0.0, 12.0))
# Class labels of bubbles in order of their id.
LABELS = ("cloude", "elipse", "other", "rectangle", "sea_uchirin", "thorn")

#: Three characters or more between the first and the last that norm_token keeps.
_KEPT = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in STRIP) + "]"
LONG = f"(?s){_KEPT}.+{_KEPT}"

SIDES = ("left_x", "top_y", "right_x", "bottom_y")

#: Parts of an em in which advances are added.
EM_UNITS = 1_000_000


def ladder(value: Column, *steps: tuple[float, float], otherwise: float) -> Column:
    """The amount of the first step whose bound is above value; null takes none of them."""
    out = F.when(value.isNull(), lit(otherwise))
    for bound, amount in steps:
        out = out.when(value < bound, lit(amount))
    return out.otherwise(lit(otherwise))


def is_fallback(source: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    return (s == "") | s.startswith("bbox_fallback")


def top_class(scores: DataFrame, labels=LABELS, min_conf: float = 0.6) -> DataFrame:
    """(bubble_id, probs) -> bubble_id, class_id, class, confidence, definite: the first largest probability; its label, or its id if it has none."""
    best = F.array_max("probs")
    cid = (F.array_position("probs", best) - 1).cast("int")
    name = F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), cid), cid.cast("string"))
    out = scores.where(F.size("probs") > 0)
    return out.select("bubble_id", cid.alias("class_id"), name.alias("class"), best.alias("confidence"), (best >= min_conf).alias("definite"))


def layout_inputs(bubbles: DataFrame, texts: DataFrame, geometry: DataFrame, stats: DataFrame, classes: DataFrame) -> DataFrame:
    """bubbles joined with text, geometry, OCR statistics and class; defaults where a side is missing.

    Bubbles without text, or with blank text, are left out. Missing geometry falls back to the bubble's box.
    """
    b = bubbles.select("bubble_id", *Box.of().named())
    t = texts.select("bubble_id", "text").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    g = geometry.select("bubble_id", "source", *[F.col(f"core_{c}") for c in ("left_x", "top_y", "right_x", "bottom_y")])
    s = stats.select("bubble_id", "cov", "line_count", "font_est_px")
    c = classes.select("bubble_id", "class", "confidence", "definite")
    out = b.join(t, "bubble_id").join(g, "bubble_id", "left").join(s, "bubble_id", "left").join(c, "bubble_id", "left")
    core = [F.coalesce(f"core_{n}", n).alias(f"core_{n}") for n in ("left_x", "top_y", "right_x", "bottom_y")]
    return out.select(
        "bubble_id", "text", "left_x", "top_y", "right_x", "bottom_y", *core, F.coalesce("source", F.lit("bbox_fallback")).alias("source"), F.coalesce("cov", lit(0)).alias("cov"),
        F.coalesce("line_count", F.lit(0)).cast("long").alias("line_count"), "font_est_px", F.size(words(F.col("text"))).alias("n_words"), "class", "confidence", "definite",
    )


# Fixed values in the functions below: the steps of the shrink, the relaxation, the fit area and the penalties.


def _kept(df: DataFrame, **boxes: Box) -> DataFrame:
    """Boxes as columns, so that later steps don't compute them again and again, and no step's code is too long for the JIT compiler."""
    return df.withColumns({f"{name}_{n}": c for name, b in boxes.items() for n, c in zip(SIDES, b, strict=True)})


def comfort_clamp(df: DataFrame, name: str, core: str, base=0.07, least=0.03, most=0.14, bonus=0.06, min_px=3, max_px=40) -> DataFrame:
    """Adds the box ``name``: the core box, named by its prefix, with a margin that depends on OCR coverage (null: unknown), source, line count and size.

    Reads cov, source and line_count.
    """
    core, cov, source, line_count = Box.of(core), F.col("cov"), F.col("source"), F.col("line_count")
    w, h = F.greatest(lit(1), core.width), F.greatest(lit(1), core.height)
    frac = lit(base) + ladder(cov, (0.08, 0.06), (0.18, 0.04), (0.30, 0.02), otherwise=0.0)
    scaled = F.when(cov.isNull(), lit(bonus)).when(cov >= 0.30, lit(bonus) * 0.20).when(cov >= 0.20, lit(bonus) * 0.35).when(cov >= 0.12, lit(bonus) * 0.55).otherwise(lit(bonus) * 0.80)
    frac = frac + F.when(is_fallback(source), scaled).otherwise(lit(0))
    frac = frac - F.when(cov >= 0.18, lit(0.02)).otherwise(lit(0)) - F.when(cov >= 0.28, lit(0.01)).otherwise(lit(0)) - F.when(line_count >= 4, lit(0.02)).otherwise(lit(0))
    # let also ends the generated loop here: with all steps of fit_area in it, it would be too long for the JIT compiler
    frac = frac * let(F.least(w, h), lambda x: ladder(x, (120, 0.55), (200, 0.75), otherwise=1.0))
    df = df.withColumn("frac_", F.greatest(lit(least), F.least(lit(most), frac)))
    side = lambda x: F.greatest(lit(min_px), F.least(lit(max_px), x * F.col("frac_") / 2))
    df = df.withColumns({"dx_": side(w), "dy_": side(h)})
    return _kept(df, **{name: inset_box(core, F.col("dx_"), F.col("dy_"))}).drop("frac_", "dx_", "dy_")


def _blended(df: DataFrame, name: str, a: str, b: str, weight: Column) -> DataFrame:
    """``blend_box`` of two boxes named by their prefixes, in steps."""
    a, b, mixed, w = Box.of(a), Box.of(b), Box.of("mixed_"), F.col("weight_")
    df = _kept(df.withColumn("weight_", F.least(F.greatest(weight, lit(0)), lit(1))), mixed=mix_box(a, b, w))
    df = df.withColumn("good_", (w >= 1) | ((mixed.right > mixed.left) & (mixed.bottom > mixed.top)))
    return _kept(df, **{name: mixed.where(F.col("good_"), a)}).drop("weight_", "good_", *[f"mixed_{c}" for c in SIDES])


def _clamped(df: DataFrame, name: str, to: Box) -> DataFrame:
    """``clamp_box`` of the box of that name, in steps."""
    b = Box.of(f"{name}_")
    df = _kept(df, cut=Box(F.greatest(b.left, to.left), F.greatest(b.top, to.top), F.least(b.right, to.right), F.least(b.bottom, to.bottom)))
    cut = Box.of("cut_")
    df = df.withColumn("good_", (cut.right > cut.left) & (cut.bottom > cut.top))
    return _kept(df, **{name: cut.where(F.col("good_"), to)}).drop("good_", *[f"cut_{c}" for c in SIDES])


def short_text_relax(df: DataFrame, name: str, clamp: str, core: str) -> DataFrame:
    """Adds the box ``name``: with fallback geometry, short texts get the clamp box scaled up again, within the core.

    clamp and core are prefixes of boxes; reads source, line_count and n_words.
    """
    lines, n, clamp, core = F.col("line_count"), F.col("n_words"), Box.of(clamp), Box.of(core)
    k = F.when(~is_fallback(F.col("source")), lit(1)).when(lines <= 1, lit(1.14)).when(n <= 4, lit(1.10)).when(n <= 7, lit(1.06)).otherwise(lit(1))
    df = _kept(df.withColumn("k_", k), larger=scale_box(clamp, F.col("k_")))
    df = _clamped(df, "larger", core)
    return _kept(df, **{name: Box.of("larger_").where(F.col("k_") > 1, clamp)}).drop("k_", *[f"larger_{c}" for c in SIDES])


def fit_core(inputs: DataFrame) -> DataFrame:
    """Adds the fit box: with fallback geometry the core moves towards the bubble's box, further for low coverage, and grows for short texts."""
    bubble, core = Box.of(), Box.of("core_")
    low = is_fallback(F.col("source"))
    by = ladder(F.col("cov"), (0.15, 0.24), (0.30, 0.20), otherwise=0.16)
    df = _clamped(_blended(inputs, "moved", "core_", "", by), "moved", bubble)
    df = _kept(df, grown=scale_box(Box.of("moved_"), 1.10))
    df = _clamped(df, "grown", bubble)
    short = (F.col("line_count") <= 1) | (F.col("n_words") <= 3)
    return _kept(df, fit=Box.of("grown_").where(short, Box.of("moved_")).where(low, core))


def fit_area(inputs: DataFrame, core_scale: float = 1.03, influence: float = 0.30, influence_fallback: float = 0.16) -> DataFrame:
    """layout inputs (with nullable ocr box) -> bubble_id, clamp box, layout box.

    The layout box starts at the core, slightly scaled, and is drawn towards the scaled OCR box by an
    influence that is weaker for fallback geometry and short texts, and none without an OCR box.
    """
    cov, source, n = (F.col(c) for c in ("cov", "source", "n_words"))
    df = fit_core(inputs)
    df = comfort_clamp(df, "comfort", "fit_")
    df = short_text_relax(df, "clamp", "comfort_", "fit_")
    fit, clamp = Box.of("fit_"), Box.of("clamp_")
    has = F.col("ocr_left_x").isNotNull()
    ocr = Box.of("ocr_").where(has, fit)
    df = _kept(df, seed=scale_box(fit, core_scale), hint=scale_box(ocr, ladder(cov, (0.08, 1.85), (0.18, 1.55), otherwise=1.32)))
    df = _clamped(_clamped(df, "seed", clamp), "hint", clamp)
    pull = F.when(is_fallback(source), lit(influence_fallback)).otherwise(lit(influence)) * F.when(n <= 3, lit(0.55)).otherwise(lit(1))
    pull = F.when(has, F.greatest(lit(0), F.least(lit(0.5), pull))).otherwise(lit(0))
    df = _clamped(_blended(df, "layout", "seed_", "hint_", pull), "layout", clamp)
    return df.select("bubble_id", *[F.col(f"{k}_{c}") for k in ("clamp", "layout") for c in ("left_x", "top_y", "right_x", "bottom_y")])


def preset_name(label: Column, source: Column, shape: Column, aspect: Column) -> Column:
    by_shape = F.when((shape >= 0.62) | (aspect >= 1.40), "rect").when(shape <= 0.44, "tapered").otherwise("ellipse")
    name = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(name == "rectangle", "rect").when(name.isin("thorn", "cloude", "sea_uchirin"), "tapered").when(~is_fallback(source), by_shape).when(name == "elipse", "ellipse").otherwise("mild")


def layout_profile(inputs: DataFrame) -> DataFrame:
    """layout inputs -> bubble_id, preset and its parameters after adjustments and limits."""
    b, core = Box.of(), Box.of("core_")
    side = lambda x: F.greatest(lit(1), x)
    bw, bh = side(b.width), side(b.height)
    shape, aspect = side(core.width) * side(core.height) / (bw * bh), bw / bh
    named = inputs.withColumn("preset", preset_name(F.col("class"), F.col("source"), shape, aspect))
    table = inputs.sparkSession.createDataFrame(list(PRESETS), "preset string, " + ", ".join(f"p_{p} double" for p in PARAMETERS))
    df = named.join(F.broadcast(table), "preset")
    tall = (bh / bw >= 1.35) & F.col("preset").isin("ellipse", "tapered")
    low = is_fallback(F.col("source"))
    when = lambda c, x, y=0.0: F.when(c, lit(x)).otherwise(lit(y))
    a, m, br, sh, pk, hy = (F.col(f"p_{p}") for p in PARAMETERS)
    values = (
        (a + when(tall, 0.05)) * when(low, 0.96, 1.0),
        m - when(tall, 0.03) + when(low, 0.02),
        br + when(low, 0.06),
        sh * when(low, 0.92, 1.0),
        pk * when(low, 0.92, 1.0),
        (hy + when(low, 0.30)) * 0.58,
    )
    return df.select("bubble_id", "preset", *[F.greatest(lit(lo), F.least(lit(hi), x)).alias(p) for p, x, (lo, hi) in zip(PARAMETERS, values, LIMITS, strict=True)])


def font_cap(df: DataFrame, dpi: float = 72.0, factor: float = 1.25, min_pt: int = 16, max_pt: int = 52, step: int = 2) -> DataFrame:
    """(bubble_id, font_est_px, best_pt) -> bubble_id, font_pt: not above the OCR estimate times factor, on the grid of sizes.

    Rounded half to even. Without an estimate the size stays.
    """
    est = F.col("font_est_px") * 72.0 / dpi
    cap = F.greatest(F.lit(min_pt), F.least(F.lit(max_pt), F.bround(est * factor, 0).cast("int")))
    snapped = (F.lit(min_pt) + F.floor((cap - min_pt) / step) * step).cast("int")
    return df.select("bubble_id", F.when(est > 0, F.least("best_pt", snapped)).otherwise(F.col("best_pt")).cast("int").alias("font_pt"))


def max_font(layout: DataFrame, advance: DataFrame, min_pt: int = 16, max_pt: int = 52, step: int = 2, leading: float = 1.2, default_em: float = 0.6) -> DataFrame:
    """layout(bubble_id, text, box_w, box_h), advance(ch, em) -> bubble_id, font_pt: the largest size of the grid at which the text fits.

    The text's width at a size, over the box's width, rounded up, is its number of lines; they must fit
    the box's height. Glyphs without an advance count default_em. min_pt if nothing fits. Advances are added as
    whole millionths of an em, so that the sum is the same in any order.
    """
    units = lambda c: F.round(c * EM_UNITS).cast("long")
    chars = layout.select("bubble_id", F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("ch")).groupBy("bubble_id", "ch").agg(F.count("*").alias("n"))
    em = chars.join(F.broadcast(advance), "ch", "left").groupBy("bubble_id").agg((F.sum(F.col("n") * units(F.coalesce("em", lit(default_em)))) / lit(EM_UNITS)).alias("em"))
    rows = layout.select("bubble_id", "box_w", "box_h").join(em, "bubble_id", "left").withColumn("em", F.coalesce("em", lit(0)))
    sizes = rows.withColumn("pt", F.explode(F.sequence(F.lit(min_pt), F.lit(max_pt), F.lit(step))))
    lines = F.greatest(F.lit(1), F.ceil(F.col("em") * F.col("pt") / F.greatest(lit(1), F.col("box_w"))))
    fits = lines * F.col("pt") * leading <= F.col("box_h")
    return sizes.groupBy("bubble_id").agg(F.coalesce(F.max(F.when(fits, F.col("pt"))), F.lit(min_pt)).alias("font_pt"))


def choose_font(bubbles: DataFrame, by_id: DataFrame, class_map: DataFrame, base: str, threshold: float = 0.6) -> DataFrame:
    """bubbles(bubble_id, class, confidence, definite), by_id(bubble_id, font), class_map(class, font) -> bubble_id, font.

    A font for the id comes first; then the class's, if definite isn't false and, where it is missing, the confidence isn't under the threshold; else base.
    """
    sure = F.coalesce(F.col("definite"), F.coalesce(F.col("confidence") >= threshold, F.lit(True)))
    out = bubbles.join(by_id.withColumnRenamed("font", "own"), "bubble_id", "left").join(F.broadcast(class_map.withColumnRenamed("font", "of_class")), "class", "left")
    return out.select("bubble_id", F.coalesce("own", F.when(sure, F.col("of_class")), F.lit(base)).alias("font"))


# -- shape of a block of lines, from the widths of its lines


def _steps(w: Column, fold) -> Column:
    """Sum over neighbouring widths of fold(current, next, should grow)."""
    peak = (F.size(w) - 1) / 2.0
    at = F.sequence(F.lit(0), F.size(w) - 2)
    return F.aggregate(at, lit(0), lambda acc, i: acc + fold(F.get(w, i), F.get(w, i + 1), (i + 0.5) < peak).cast("double"))


def _first_peak(w: Column) -> Column:
    return (F.array_position(w, F.array_max(w)) - 1).cast("double")


def shape_stats(widths: Column, tolerance: float = 0.04) -> Column:
    """struct<hard, soft, edge_ratio, peak_shift>: how far widths are from growing to the middle and shrinking after it."""
    return let(F.transform(widths, lambda x: F.greatest(lit(0), x.cast("double"))), lambda w: _shape_stats(w, tolerance))


def _shape_stats(w: Column, tolerance: float) -> Column:
    n = F.size(w)
    slack = lambda a, b: F.greatest(lit(2), F.greatest(a, b) * tolerance)
    hard = _steps(w, lambda a, b, up: F.when(up, b - a < -slack(a, b)).otherwise(b - a > slack(a, b)).cast("int"))
    soft = _steps(w, lambda a, b, up: F.when(up & (b < a), (a - b) / F.greatest(lit(10), a)).when(~up & (b > a), (b - a) / F.greatest(lit(10), b)).otherwise(lit(0)))
    shift = F.abs(_first_peak(w) - (n - 1) / 2.0)
    edge = F.greatest(F.get(w, F.lit(0)), F.element_at(w, -1)) / F.greatest(lit(1), F.array_max(w))
    limit = F.when(n == 3, lit(1.01)).when(n == 4, lit(0.95)).otherwise(lit(0.92))

    def told(e: Column) -> Column:
        all_hard = hard + (e["edge"] > limit).cast("double")
        all_soft = soft + F.greatest(lit(0), e["edge"] - (limit - 0.10)) * 4.0 + e["shift"] * 0.60
        return F.struct(all_hard.alias("hard"), all_soft.alias("soft"), e["edge"].alias("edge_ratio"), e["shift"].alias("peak_shift"))

    plain = F.struct(lit(0).alias("hard"), lit(0).alias("soft"), lit(1).alias("edge_ratio"), lit(0).alias("peak_shift"))
    return F.when(n <= 2, plain).otherwise(let(F.struct(edge.alias("edge"), shift.alias("shift")), told))


def sequence_penalty(w: Column) -> Column:
    miss = _steps(w, lambda a, b, up: F.when(up & (b < a), (a - b) / F.greatest(lit(12), a) * 8.0).when(~up & (b > a), (b - a) / F.greatest(lit(12), b) * 8.0).otherwise(lit(0)))
    peak, edge = F.array_max(w), F.greatest(F.get(w, F.lit(0)), F.element_at(w, -1))
    return F.when(F.size(w) <= 2, lit(0)).otherwise(miss + F.when((peak > 0) & (edge > peak * 0.95), (edge / F.nullif(peak, lit(0)) - 0.95) * 12.0).otherwise(lit(0)))


def peak_penalty(w: Column) -> Column:
    n = F.size(w)
    first, last = F.get(w, F.lit(0)), F.element_at(w, -1)
    edge = F.greatest(first, last)
    half = F.floor(n / 2).cast("int")
    odd = n % 2 == 1
    middle = F.when(odd, F.get(w, half)).otherwise(F.greatest(F.get(w, half - 1), F.get(w, half)))
    flat = F.when((middle > 0) & (edge >= middle), (edge - middle) / F.greatest(lit(12), middle) * F.when(odd, lit(18)).otherwise(lit(14))).otherwise(lit(0))
    out = F.abs(_first_peak(w) - (n - 1) / 2.0) * 2.4 + flat + F.abs(first - last) / F.greatest(lit(12), edge) * 3.0
    return F.when(n <= 2, lit(0)).otherwise(out)


def badness(lines: Column) -> Column:
    """Penalty of a block of lines: hyphens at line ends, tiny lines, and the shape of its character widths.

    What several terms read is computed once: trimmed lines, then their features, then widths and words.
    """
    broken = lambda s: F.endswith(s, F.lit("-"))
    piece = lambda s: norm_token(F.element_at(F.split(F.regexp_replace(s, "-$", ""), " "), -1))
    # lower case has no fewer letters, so a line with three characters between what is stripped is not tiny
    tiny = lambda s: F.when(F.rlike(s, F.lit(LONG)), F.lit(False)).otherwise(F.length(norm_token(s)) <= 2)
    of_line = lambda s: let(F.trim(F.coalesce(s, F.lit(""))), lambda s: F.struct(s.alias("s"), broken(s).alias("broken"), tiny(s).alias("tiny")))

    def hyphenated(t: Column, stutter: Column, hyphens: Column) -> Column:
        n_words = F.size(words(F.array_join(F.transform(t, lambda x: x["s"]), " ")))
        short = F.size(F.filter(t, lambda s, i: s["broken"] & (F.length(piece(s["s"])) <= 3) & ~(stutter & (i == 0))))
        per = lambda k, few, some, many: F.when(k <= 2, lit(few)).when(k <= 4, lit(some)).otherwise(lit(many))
        return let(n_words, lambda k: hyphens * per(k, 0.6, 0.9, 1.2) + short * per(k, 2.2, 1.8, 2.4))

    def value(t: Column) -> Column:
        first = F.get(t, F.lit(0))["s"]
        stutter = F.coalesce((F.size(t) >= 2) & broken(first) & (F.length(norm_token(F.regexp_replace(first, "-+$", ""))) <= 2) & (norm_token(F.get(t, F.lit(1))["s"]) != ""), F.lit(False))
        widths = F.transform(t, lambda x: F.length(F.regexp_replace(x["s"], r"\s+", "")).cast("double"))
        return let(F.struct(t.alias("t"), stutter.alias("stutter"), widths.alias("widths"), F.size(F.filter(t, lambda x: x["broken"])).alias("hyphens")), total)

    def total(x: Column) -> Column:
        t, stutter, hyphens, n = x["t"], x["stutter"], x["hyphens"], F.size(x["t"])
        n_tiny = F.size(F.filter(t, lambda s, i: s["tiny"] & (i < n - 1) & ~(stutter & (i == 0))))
        # words are counted for blocks with a hyphen alone
        base = F.when(hyphens > 0, hyphenated(t, stutter, hyphens)).otherwise(lit(0)) + n_tiny * 2.0
        shaped = let(shape_stats(x["widths"], 0.07), lambda s: base + s["hard"] * 4.5 + s["soft"] * 1.8)
        return shaped + sequence_penalty(x["widths"]) * 0.55 + peak_penalty(x["widths"]) * 0.45

    return F.when(F.size(lines) > 0, let(F.transform(lines, of_line), value)).otherwise(lit(0))


def layout_quality(blocks: DataFrame) -> DataFrame:
    """(bubble_id, class, lines, widths) -> bubble_id, class, hard, soft, badness, hyphens."""
    hyphens = F.size(F.filter("lines", lambda s: F.endswith(F.trim(s), F.lit("-"))))
    rows = blocks.select("bubble_id", "class", shape_stats(F.col("widths")).alias("st"), badness(F.col("lines")).alias("badness"), hyphens.alias("hyphens"))
    return rows.select("bubble_id", "class", "st.hard", "st.soft", "badness", "hyphens")


def quality_by_class(quality: DataFrame) -> DataFrame:
    return quality.groupBy("class").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("hard", "soft", "badness", "hyphens")])
