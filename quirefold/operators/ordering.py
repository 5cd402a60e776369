"""Reading order, line grouping and the text of bubbles.

Four rules group boxes into rows; they differ in tolerance, in whether the first or the nearest row
takes a box, and in the order of rows, and are kept apart on purpose.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_sorted


def first_fit(y: np.ndarray, tolerance: float) -> tuple[np.ndarray, list[float]]:
    """The row of each y, taken in turn: the first whose running mean is within the tolerance, else a new one."""
    row, means, counts = np.empty(len(y), int), [], []
    for i, v in enumerate(y):
        for r, m in enumerate(means):
            if abs(v - m) <= tolerance:
                counts[r] += 1
                means[r] = (m * (counts[r] - 1) + v) / counts[r]
                row[i] = r
                break
        else:
            row[i] = len(means)
            means.append(float(v))
            counts.append(1)
    return row, means


def _centres(boxes: DataFrame) -> DataFrame:
    w, h = F.greatest(F.lit(0.0), F.col("right_x") - F.col("left_x")), F.greatest(F.lit(0.0), F.col("bottom_y") - F.col("top_y"))
    return boxes.select(
        "page_id", "box_id", F.col("top_y").alias("top"), F.col("left_x").alias("left"), h.alias("h"),
        (F.col("left_x") + w / 2).alias("x_mid"), (F.col("top_y") + h / 2).alias("y_mid"),
    )


def reading_order_rows(boxes: DataFrame, tol: float = 0.5) -> DataFrame:
    """(box_id, page_id, box) -> page_id, box_id, row_no, ordinal, label: rows by first fit within half the median height.

    Boxes come by centre y, then x; rows stand in order of their mean y, boxes in a row by x. Ties: smaller id.
    """

    def fold(g):
        row, means = first_fit(g["y_mid"], max(1.0, float(np.median(g["h"])) * tol))
        place = np.empty(len(means), int)
        place[np.argsort(means, kind="stable")] = np.arange(len(means))
        at = np.lexsort((np.arange(len(row)), g["x_mid"], place[row]))
        n = np.arange(1, len(at) + 1)
        return {"box_id": g["box_id"][at], "row_no": place[row][at], "ordinal": n, "label": np.array([f"AUTO_{i:04d}" for i in n])}

    return fold_sorted(_centres(boxes), "page_id", ["y_mid", "x_mid", "box_id"], fold, "page_id long, box_id long, row_no int, ordinal int, label string")


def reading_order_nearest(boxes: DataFrame, tol: float = 0.5, rtl: bool = False) -> DataFrame:
    """As reading_order_rows, but the nearest row takes a box, within tol of the smaller of its and the row's mean height.

    Rows stand in order of their topmost box, then mean y; from right to left with rtl. Labels are as wide as the count asks for, three digits at least.
    """
    sign = -1.0 if rtl else 1.0

    def fold(g):
        y, h, top = g["y_mid"], g["h"], g["top"]
        row, rows = np.empty(len(y), int), []
        for i in range(len(y)):
            best, at = None, -1
            for r, (m, mh, _, _) in enumerate(rows):
                d = abs(y[i] - m)
                if d <= max(1.0, min(h[i], mh) * tol) and (best is None or d < best):
                    best, at = d, r
            if at < 0:
                row[i] = len(rows)
                rows.append((y[i], h[i], top[i], 1))
            else:
                m, mh, t, n = rows[at]
                rows[at] = ((m * n + y[i]) / (n + 1), (mh * n + h[i]) / (n + 1), min(t, top[i]), n + 1)
                row[i] = at
        place = np.empty(len(rows), int)
        place[np.lexsort(([r[0] for r in rows], [r[2] for r in rows]))] = np.arange(len(rows))
        at = np.lexsort((np.arange(len(row)), top, y, sign * g["x_mid"], place[row]))
        n = np.arange(1, len(at) + 1)
        pad = max(3, len(str(len(at))))
        return {"box_id": g["box_id"][at], "row_no": place[row][at], "ordinal": n, "label": np.array([f"B{i:0{pad}d}" for i in n])}

    c = _centres(boxes).withColumn("x_by", sign * F.col("x_mid")).withColumn("left_by", sign * F.col("left"))
    return fold_sorted(c, "page_id", ["y_mid", "x_by", "top", "left_by", "box_id"], fold, "page_id long, box_id long, row_no int, ordinal int, label string")


def bubble_text(tokens: DataFrame, tol: float = 0.6, sep: str = " ") -> DataFrame:
    """(box_id, tok_id, x_mid, y_mid, h, txt) -> box_id, text: lines by first fit within tol of the median height (floored at 1).

    Lines stand in the order they were opened, tokens by x within them; empty tokens are left out.
    """

    def fold(g):
        row, means = first_fit(g["y_mid"], float(np.median(np.maximum(1.0, g["h"]))) * tol)
        lines = []
        for r in range(len(means)):
            at = np.flatnonzero(row == r)
            lines.append(sep.join(t for t in g["txt"][at[np.argsort(g["x_mid"][at], kind="stable")]] if t))
        return {"text": np.array(["\n".join(lines).strip()], dtype=object)}

    return fold_sorted(tokens.select("box_id", "tok_id", "x_mid", "y_mid", "h", "txt"), "box_id", ["y_mid", "x_mid", "tok_id"], fold, "box_id long, text string")


def line_counts(tokens: DataFrame) -> DataFrame:
    """(box_id, tok_id, y_mid, h) -> box_id, line_count: lines by first fit on y alone, 1 to 12."""

    def fold(g):
        tolerance = max(1.0, float(np.median(np.maximum(1.0, g["h"]))) * 0.6)
        _, means = first_fit(g["y_mid"], tolerance)
        return {"line_count": np.array([max(1, min(12, len(means)))])}

    return fold_sorted(tokens.select("box_id", "tok_id", "y_mid", "h"), "box_id", ["y_mid", "tok_id"], fold, "box_id long, line_count int")


def median_heights(boxes: DataFrame, key: str = "page_id") -> DataFrame:
    """Exact median height of each key's boxes; the middle two are averaged."""
    return boxes.groupBy(key).agg(F.median(F.col("bottom_y") - F.col("top_y")).alias("median_h"))


def ocr_stats(tokens: DataFrame, assigned: DataFrame, bubbles: DataFrame) -> DataFrame:
    """tokens, assign_tokens, bubbles(box_id, page_id, box) -> a row per bubble: n_polys, mask_area, bubble_area, cov, OCR box, line_count, font_est_px.

    mask_area is the number of whole pixels of the bubble that any of its tokens covers: token boxes are
    cut at each other's edges and every cell of that grid counts once. Bubbles without tokens have
    zeros and null boxes.
    """
    t = tokens.join(assigned.select("tok_id", "box_id"), "tok_id")
    mid = t.select("box_id", "tok_id", ((F.col("top_y") + F.col("bottom_y")) / 2).alias("y_mid"), F.greatest(F.lit(1.0), F.col("bottom_y") - F.col("top_y")).alias("h"))
    box = t.groupBy("box_id").agg(
        F.count("*").alias("n_polys"), F.min("left_x").alias("ocr_left"), F.min("top_y").alias("ocr_top"), F.max("right_x").alias("ocr_right"), F.max("bottom_y").alias("ocr_bottom")
    )
    b = bubbles.select("box_id", *[F.col(c).alias(f"b_{c}") for c in ("left_x", "top_y", "right_x", "bottom_y")])
    cut = lambda c, low, high: F.least(F.greatest(c, F.col(low)), F.col(high))
    inside = t.join(b, "box_id").select(
        "box_id", F.floor(cut(F.col("left_x"), "b_left_x", "b_right_x")).cast("long").alias("x0"), F.floor(cut(F.col("top_y"), "b_top_y", "b_bottom_y")).cast("long").alias("y0"),
        F.floor(cut(F.col("right_x"), "b_left_x", "b_right_x")).cast("long").alias("x1"), F.floor(cut(F.col("bottom_y"), "b_top_y", "b_bottom_y")).cast("long").alias("y1"),
    )
    areas = union_area(inside, "box_id").withColumnRenamed("area", "mask_area")
    out = b.join(box, "box_id", "left").join(areas, "box_id", "left").join(line_counts(mid), "box_id", "left")
    area = F.greatest(F.lit(1.0), (F.col("b_right_x") - F.col("b_left_x")) * (F.col("b_bottom_y") - F.col("b_top_y")))
    mask = F.coalesce("mask_area", F.lit(0)).cast("long")
    lines = F.coalesce("line_count", F.lit(0)).cast("int")
    height = F.col("ocr_bottom") - F.col("ocr_top")
    return out.select(
        "box_id", F.coalesce("n_polys", F.lit(0)).cast("long").alias("n_polys"), mask.alias("mask_area"), area.alias("bubble_area"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), mask / area)).alias("cov"), "ocr_left", "ocr_top", "ocr_right", "ocr_bottom", lines.alias("line_count"),
        F.when((height > 0) & (lines > 0), height / lines / 1.2).alias("font_est_px"),
    )


#: Rectangles of a key up to which they are joined where they stand, as one array.
FEW = 16


def union_area(rects: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, x1, y1) whole numbers, ends open -> key, area covered by any rectangle.

    The rectangles between two neighbouring x edges of the key are a strip, in which the y ranges are joined in order. Up to FEW rectangles
    are one array and stay in their row; of keys with more every rectangle is cut into its strips, which grow with the edges within it, not with its area.
    """
    from pyspark.sql import Window

    ends = ["y0", "y1", "x0", "x1"]
    kind = "double" if {"double", "float"} & {dict(rects.dtypes)[c] for c in ends} else "long"
    good = rects.where(F.col(key).isNotNull() & F.expr("x1 > x0 and y1 > y0")).select(key, *[F.col(c).cast(kind).alias(c) for c in ends])
    held = good.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*ends))).alias("rs"))
    held = held.select(key, "rs", F.sort_array(F.array_distinct(F.concat("rs.x0", "rs.x1"))).alias("xs"))
    zero = F.lit(0).cast(kind)

    def joined(sum_, r):
        gain = F.greatest(zero, r["y1"] - F.greatest(r["y0"], F.coalesce(sum_["top"], r["y0"])))
        return F.struct((sum_["n"] + gain).alias("n"), F.greatest(sum_["top"], r["y1"]).alias("top"))

    def strip(sum_, i):
        a, b = F.get("xs", i - 1), F.get("xs", i)
        own = F.filter("rs", lambda r: (r["x0"] <= a) & (r["x1"] >= b))
        return sum_ + (b - a) * F.aggregate(own, F.struct(zero.alias("n"), F.lit(None).cast(kind).alias("top")), joined, lambda s: s["n"])

    few = held.where(F.size("rs") <= FEW).select(key, F.aggregate(F.sequence(F.lit(1), F.size("xs") - 1), zero, strip).cast("long").alias("area"))
    cut = held.where(F.size("rs") > FEW).select(key, "xs", F.explode("rs").alias("r")).select(key, "xs", "r.*")
    own = F.filter("xs", lambda x: (x >= F.col("x0")) & (x <= F.col("x1")))
    pairs = F.zip_with(F.slice(own, 1, F.size(own) - 1), F.slice(own, 2, F.size(own)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    strips = cut.select(key, "y0", "y1", F.explode(pairs).alias("s")).select(key, "y0", "y1", "s.a", "s.b")
    order = Window.partitionBy(key, "a", "b").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    from_ = F.greatest(F.col("y0"), F.coalesce(F.max("y1").over(order), F.col("y0")))
    covered = strips.withColumn("gain", F.greatest(F.lit(0), F.col("y1") - from_) * (F.col("b") - F.col("a")))
    return few.unionByName(covered.groupBy(key).agg(F.sum("gain").cast("long").alias("area")))
