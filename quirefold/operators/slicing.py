"""Cost of page rows, forbidden rows, cut positions, slices and their merge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import tables

from .folds import fold_sorted

#: Rows of a page beyond which it is cut in blocks of so many.
TALL = 8192


def row_features(pixels: DataFrame) -> DataFrame:
    """(page_id, y, x, v) -> page_id, y, mean, var (population), grad (summed vertical change per pixel; 0 in row 0), white."""
    up = F.lag("v").over(Window.partitionBy("page_id", "x").orderBy("y"))
    rows = pixels.withColumn("step", F.coalesce(F.abs(F.col("v") - up), F.lit(0)))
    n, total = F.count("v"), F.sum("v")
    # from sums, which whole pixel values keep exact in any order of adding
    var = (n * F.sum(F.col("v") * F.col("v")) - total * total) / (n * n)
    g = rows.groupBy("page_id", "y").agg((total / n).alias("mean"), var.alias("var"), (F.sum("step") / F.count("*")).alias("grad"))
    return g.withColumn("white", F.col("mean") / 255.0 / (1.0 + F.col("var")))


def forbidden_rows(rows: DataFrame, boxes: DataFrame, margin: int) -> DataFrame:
    """rows(page_id, y), boxes -> page_id, y, forbidden: a box with its margin covers the row."""
    low, high = F.greatest(F.lit(0), F.col("top_y").cast("int") - margin), F.col("bottom_y").cast("int") + margin
    covered = boxes.select("page_id", F.explode(F.when(high > low, F.sequence(low, high - 1))).alias("y")).distinct().withColumn("hit", F.lit(True))
    out = rows.select("page_id", "y").join(covered, ["page_id", "y"], "left")
    return out.select("page_id", "y", F.coalesce("hit", F.lit(False)).alias("forbidden"))


def _scaled(c: str) -> Column:
    page = Window.partitionBy("page_id")
    low, high = F.min(c).over(page), F.max(c).over(page)
    return F.when(high - low < 1e-6, 0.0).otherwise((F.col(c) - low) / (high - low))


def row_cost(features: DataFrame, forbidden: DataFrame, weights=(1.0, 0.5, 0.5, 2.0)) -> DataFrame:
    """row_features (and edge, if there), forbidden_rows -> page_id, y, cost, safe.

    Features are scaled to 0-1 within the page (0 where they hardly vary). Forbidden rows keep their
    cost and are not safe, so that cuts can still compare them.
    """
    f = features if "edge" in features.columns else features.withColumn("edge", F.lit(0.0))
    we, wv, wg, ww = weights
    cost = we * _scaled("edge") + wv * _scaled("var") + wg * _scaled("grad") - ww * _scaled("white")
    out = f.withColumn("cost", cost).join(forbidden, ["page_id", "y"], "left")
    return out.select("page_id", "y", "cost", (~F.coalesce("forbidden", F.lit(False))).alias("safe"))


def best_cut(cost: DataFrame, cur: DataFrame, min_h: int, max_h: int, penalty: float) -> DataFrame:
    """cost rows, cur(page_id, cur) -> page_id, y: the next cut of each page.

    Among rows in [cur + min_h, cur + max_h): safe ones if there are any, by cost and distance from the
    preferred height, first minimum; without a safe row the first row. Past the end: the height.
    """
    height = cost.groupBy("page_id").agg((F.max("y") + 1).alias("height"))
    at = cur.join(height, "page_id")
    target = F.col("cur") + (min_h + max_h) // 2
    some = cost.join(at, "page_id").where((F.col("y") >= F.col("cur") + min_h) & (F.col("y") < F.least(F.col("cur") + max_h, F.col("height"))))
    by = F.when(F.col("safe"), F.col("cost") + penalty * F.abs(F.col("y") - target))
    best = some.groupBy("page_id").agg(F.min(F.struct((~F.col("safe")).alias("u"), by.alias("by"), "y")).alias("m"))
    return at.join(best, "page_id", "left").select("page_id", F.coalesce("m.y", F.least(F.col("cur") + min_h, "height")).cast("long").alias("y"))


class _Cutter:
    """The next cut below a cut, in rows of a page of n rows that begin at row ``base``."""

    def __init__(self, g: dict, base: int, n: int, min_h: int, max_h: int, penalty: float, tail: str):
        self.cost, self.safe, self.base, self.n = g["cost"].astype(float), g["safe"].astype(bool), base, n
        self.min_h, self.max_h, self.penalty, self.tail = min_h, max_h, penalty, tail

    def after(self, cur: int) -> int:
        """The cut below cur; cur itself if it is the last one."""
        n, wanted = self.n, (self.min_h + self.max_h) // 2
        if n - cur <= self.max_h:
            return cur
        a, b = cur + self.min_h, min(cur + self.max_h, n)
        if a >= n:
            y = n
        else:
            cost, safe = self.cost[a - self.base : b - self.base], self.safe[a - self.base : b - self.base]
            part = np.where(safe, cost + self.penalty * np.abs(np.arange(a, b) - cur - wanted), np.inf)
            y = a + (int(np.argmin(part)) if safe.any() else 0)
        if y <= cur:
            y = cur + self.min_h
        if self.tail == "absorb" and n - y < self.min_h:
            y = n
        return min(y, n if self.tail == "absorb" else n - 1)

    def walk(self, cur: int, end: int) -> tuple[list[int], list[int]]:
        """Tops and bottoms of the pieces that begin at cur and below it, before row ``end``."""
        tops, bottoms = [], []
        while cur < end:
            y = self.after(cur)
            if y == cur:
                if cur != self.n:
                    tops.append(cur)
                    bottoms.append(self.n)
                break
            tops.append(cur)
            bottoms.append(y)
            cur = y
        return tops, bottoms


def cuts(cost: DataFrame, min_h: int, max_h: int, penalty: float, tail: str = "absorb", block: int = TALL) -> DataFrame:
    """cost rows -> page_id, slice_no, top, bottom: cut after cut as best_cut says, page by page.

    absorb: a last piece under min_h joins the one before it. clamp: cuts stop at the last row instead. A page of up to ``block`` rows is
    walked from its top. Taller ones are dealt into blocks of so many rows and the max_h below them: each block finds for every row where a
    walk that enters there leaves it, a page then only jumps from block to block, and the blocks write the pieces of the walk that is theirs.
    """
    block = max(block, max_h + 1)
    rows = cost.select("page_id", "y", "cost", "safe")
    tall = rows.groupBy("page_id").agg((F.max("y") + 1).cast("long").alias("n")).where(F.col("n") > block)
    made = lambda tops, bottoms, first=0: {"slice_no": first + np.arange(len(tops)), "top": np.array(tops, np.int64), "bottom": np.array(bottoms, np.int64)}
    args = (min_h, max_h, penalty, tail)

    def whole(g):
        n = len(g["cost"])
        return made(*_Cutter(g, 0, n, *args).walk(0, max(n, 1)))

    short = fold_sorted(rows.join(tall, "page_id", "left_anti"), "page_id", ["y"], whole, "page_id long, slice_no long, top long, bottom long")

    blocks = F.sequence(F.greatest(F.lit(0), F.floor((F.col("y") - max_h) / block)), F.floor(F.col("y") / block))
    dealt = rows.join(tall, "page_id").withColumn("block", F.explode(blocks)).withColumn("part", F.concat_ws(":", "page_id", "block"))

    def through(g):
        first, n = int(g["block"][0]) * block, int(g["n"][0])
        end, c = min(first + block, n), _Cutter(g, first, n, *args)
        leaves, pieces = np.full(end - first, -1), np.zeros(end - first, np.int64)
        for cur in range(end - 1, first - 1, -1):
            y = c.after(cur)
            if y != cur:
                inside = y < end
                leaves[cur - first] = leaves[y - first] if inside else (y if y < n else -1)
                pieces[cur - first] = 1 + (pieces[y - first] if inside else 0)
        out = {"page_id": g["page_id"][:1], "block": g["block"][:1]}
        for name, x in (("leaves", leaves), ("pieces", pieces)):
            out[name] = np.empty(1, object)
            out[name][0] = x[:max_h].tolist()
        return out

    with tables(cost.sparkSession) as save:
        ways = save(fold_sorted(dealt, "part", ["y"], through, "part string, page_id long, block long, leaves array<long>, pieces array<long>").drop("part"))

        def jump(g):
            cur, number, entries, firsts = 0, 0, [], []
            for k, leaves, pieces in zip(g["block"], g["leaves"], g["pieces"], strict=True):
                entries.append(cur)
                firsts.append(number)
                if cur < 0:
                    continue
                at = cur - int(k) * block
                cur, number = int(leaves[at]), number + int(pieces[at])
            return {"block": g["block"], "entry": np.array(entries, np.int64), "number": np.array(firsts, np.int64)}

        entries = save(fold_sorted(ways, "page_id", ["block"], jump, "page_id long, block long, entry long, number long").where("entry >= 0"), keep=True)

    def own(g):
        first, n = int(g["block"][0]) * block, int(g["n"][0])
        out = made(*_Cutter(g, first, n, *args).walk(int(g["entry"][0]), min(first + block, n)), int(g["number"][0]))
        return out | {"page_id": np.repeat(g["page_id"][:1], len(out["top"]))}

    long = fold_sorted(dealt.join(entries, ["page_id", "block"]), "part", ["y"], own, "part string, page_id long, slice_no long, top long, bottom long")
    return short.unionByName(long.drop("part"))


def slice_rows(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """rows(page_id, y, ...), slices(page_id, slice_no, top, bottom) -> rows with slice_no and y within it; empty slices have none."""
    s = slices.where("bottom > top").select("page_id", "slice_no", "top", F.explode(F.sequence(F.col("top"), F.col("bottom") - 1)).alias("y"))
    return rows.join(s, ["page_id", "y"]).withColumn("y_local", F.col("y") - F.col("top")).drop("top")


def merge_slices(done: DataFrame, slices: DataFrame, originals: DataFrame) -> DataFrame:
    """done(page_id, slice_no, y_local, v), originals(page_id, y, v) -> page_id, y, v, from_original.

    Rows of slices that are missing fall back to the original ones.
    """
    placed = done.join(slices.select("page_id", "slice_no", "top"), ["page_id", "slice_no"]).select("page_id", (F.col("y_local") + F.col("top")).alias("y"), F.col("v").alias("new_v"))
    out = originals.join(placed, ["page_id", "y"], "left")
    return out.select("page_id", "y", F.coalesce("new_v", "v").alias("v"), F.col("new_v").isNull().alias("from_original"))


def check_heights(done: DataFrame, slices: DataFrame) -> DataFrame:
    """page_id, slice_no, expected, actual, ok: heights of the processed slices against their intervals."""
    have = done.groupBy("page_id", "slice_no").agg((F.max("y_local") + 1).alias("actual"))
    out = slices.join(have, ["page_id", "slice_no"], "left").withColumn("expected", F.col("bottom") - F.col("top"))
    actual = F.coalesce("actual", F.lit(0)).cast("long")
    return out.select("page_id", "slice_no", "expected", actual.alias("actual"), (actual == F.col("expected")).alias("ok"))


def write_slices(rows: DataFrame, path: str) -> None:
    """Rows of slices as a table partitioned by page and slice."""
    rows.write.mode("overwrite").partitionBy("page_id", "slice_no").parquet(path)
