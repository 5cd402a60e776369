"""Detector output: chunk plans, lifting to page coordinates, filters, suppression, union."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.geometry import Box, iou, lit, overlap
from quirefold.session import tables

from .folds import fold_sorted
from .intervals import overlap_join

MIN_SIDE = 20
#: Rounds of suppression before whole chains are decided at once.
PLAIN_ROUNDS = 3
#: Boxes of a page that come to its points as one array.
FEW = 64
#: Width of a cell in which the nearest centre is first looked for.
CELL = 128.0


def chunk_plan(page_dim: DataFrame, chunk: int, overlap_px: int) -> DataFrame:
    """(page_id, height) -> page_id, chunk_no, chunk_top, chunk_bottom: overlapping vertical chunks."""
    starts = F.when(F.col("height") > 0, F.sequence(F.lit(0), (F.col("height") - 1).cast("int"), F.lit(chunk)))
    rows = page_dim.select("page_id", "height", F.posexplode(starts).alias("chunk_no", "y"))
    return rows.select(
        "page_id",
        F.col("chunk_no").cast("long").alias("chunk_no"),
        F.greatest(F.lit(0), F.col("y") - overlap_px).cast("long").alias("chunk_top"),
        F.least(F.col("height"), F.col("y") + chunk + overlap_px).cast("long").alias("chunk_bottom"),
    )


def lift_boxes(local: DataFrame, page_dim: DataFrame, min_w: float = MIN_SIDE, min_h: float = MIN_SIDE) -> DataFrame:
    """Chunk-local boxes (page_id, chunk_top, box, ...) in page coordinates, clamped to the page.

    Sides are tested against the minimum before clamping; boxes that are empty after it go. A page
    without a size drops its boxes.
    """
    b = Box.of()
    big = local.where((b.width >= min_w) & (b.height >= min_h)).join(page_dim.select("page_id", "width", "height"), "page_id")
    limit = lambda c, most: F.least(F.greatest(c, lit(0)), most - lit(1))
    top = F.col("chunk_top")
    moved = Box(limit(b.left, F.col("width")), limit(b.top + top, F.col("height")), limit(b.right, F.col("width")), limit(b.bottom + top, F.col("height")))
    rest = [c for c in local.columns if c not in ("left_x", "top_y", "right_x", "bottom_y", "chunk_top")]
    return big.select(*rest, *moved.named()).where("right_x > left_x and bottom_y > top_y")


def filter_conf(df: DataFrame, threshold: float, relax: float = 0.0) -> DataFrame:
    """Rows with conf at or above max(0, threshold - relax); null conf goes."""
    return df.where(F.col("conf") >= F.greatest(lit(0), lit(threshold) - lit(relax)))


def union_boxes(**readers: DataFrame) -> DataFrame:
    """Rows of every reader with its name as ``reader``; columns are matched by name."""
    parts = [df.withColumn("reader", F.lit(name)) for name, df in readers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def iou_pairs(boxes: DataFrame, iou_thr: float, guard: str = "nms") -> DataFrame:
    """(box_id, page_id, box) -> a_id, b_id, page_id, iou: pairs of one page with iou >= threshold, a < b."""
    cols = ["page_id", "box_id", "left_x", "top_y", "right_x", "bottom_y"]
    a = boxes.select("page_id", *[F.col(c).alias(f"a_{c}") for c in cols[1:]])
    b = boxes.select("page_id", *[F.col(c).alias(f"b_{c}") for c in cols[1:]])
    both = overlap_join(a, b, (F.col("a_top_y"), F.col("a_bottom_y")), (F.col("b_top_y"), F.col("b_bottom_y")), ["page_id"])
    value = iou(Box.of("a_"), Box.of("b_"), guard)
    both = both.where(F.col("a_box_id") < F.col("b_box_id")).withColumn("iou", value).where(F.col("iou") >= iou_thr)
    return both.select(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), "page_id", "iou")


def conflicts(boxes: DataFrame, iou_thr: float) -> DataFrame:
    """winner, loser of every pair of a page that overlaps by >= threshold: the higher conf wins, ties go to the smaller id, null is lowest."""
    pairs = iou_pairs(boxes, iou_thr)
    conf = boxes.select(F.col("box_id").alias("id"), F.coalesce("conf", lit(float("-inf"))).alias("conf"))
    scored = (
        pairs.join(conf.withColumnsRenamed({"id": "a_id", "conf": "a_conf"}), "a_id")
        .join(conf.withColumnsRenamed({"id": "b_id", "conf": "b_conf"}), "b_id")
    )
    first = (F.col("a_conf") > F.col("b_conf")) | ((F.col("a_conf") == F.col("b_conf")) & (F.col("a_id") < F.col("b_id")))
    return scored.select(F.when(first, F.col("a_id")).otherwise(F.col("b_id")).alias("winner"), F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("loser"))


def _chained(live: DataFrame, save) -> DataFrame:
    """id, up, odd of every box with a single winner: the first one up its chain that hasn't just one, and whether the way there has odd length.

    Such a box stays exactly if its winner goes, so ways add up: each step doubles how far they reach.
    """
    hung = live.groupBy("loser").agg(F.min("winner").alias("up"), F.count("*").alias("n")).where("n = 1")
    hung = save(hung.select(F.col("loser").alias("id"), "up", F.lit(True).alias("odd")))
    while True:
        above = hung.select(F.col("id").alias("up"), F.col("up").alias("up_up"), F.col("odd").alias("up_odd"))
        further = hung.join(above, "up", "left")
        further = save(further.select("id", F.coalesce("up_up", "up").alias("up"), (F.col("odd") != F.coalesce("up_odd", F.lit(False))).alias("odd"), F.col("up_up").isNotNull().alias("moved")))
        hung = further.drop("moved")
        if further.where("moved").isEmpty():
            return hung


def suppressed(edges: DataFrame, plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    """winner, loser (without cycles) -> box_id of the losers of some box that stays.

    A fixed point over edges: whoever has no winner left stays, and its losers go with all their edges. Edges shrink
    each round. Chains, which would take a round for every second box, are decided as a whole once ``plain_rounds`` haven't been enough.
    """
    spark = edges.sparkSession
    with tables(spark) as save:
        live, gone, rounds = save(edges), [], 0
        while not live.isEmpty():
            winners = live.select(F.col("winner").alias("id")).distinct()
            losers = live.select(F.col("loser").alias("id")).distinct()
            stay = winners.join(losers, "id", "left_anti")
            if rounds >= plain_rounds:
                hung = _chained(live, save).join(losers.withColumnRenamed("id", "up"), "up", "left_anti")
                stay = save(stay.unionByName(hung.where("not odd").select("id")))
            go = save(live.join(stay, live["winner"] == stay["id"], "left_semi").select(F.col("loser").alias("box_id")).distinct(), keep=True)
            gone.append(go)
            live = live.join(go, live["winner"] == go["box_id"], "left_anti")
            live = save(live.join(go, live["loser"] == go["box_id"], "left_anti"))
            rounds += 1
    out = gone[0] if gone else spark.createDataFrame([], "box_id long")
    for more in gone[1:]:
        out = out.unionByName(more)
    return out


def nms(boxes: DataFrame, iou_thr: float) -> DataFrame:
    """Greedy suppression within a page: a box goes if one that stays and has a higher score overlaps it by >= threshold.

    Ties in score go to the smaller id, null scores come last. Only ids of overlapping pairs move from round to round.
    """
    return boxes.join(suppressed(conflicts(boxes, iou_thr)), "box_id", "left_anti")


def nearest_centre(points: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """(pt_id, page_id, px, py), boxes -> pt_id, box_id of the box of the page with the nearest centre; ties: higher conf, then smaller id.

    Both lie in a grid. A point looks at its cell and the eight around it; if the best centre there is no further away than a cell is
    wide, no other can be nearer. The points left do the same with cells twice as wide, until a cell holds everything. Points of
    pages without boxes and those without coordinates give no row.
    """
    spark = points.sparkSession
    b = Box.of()
    held = boxes.select("page_id", "box_id", (-F.col("conf")).alias("c"), ((b.left + b.right) / 2).alias("cx"), ((b.top + b.bottom) / 2).alias("cy")).where("cx is not null and cy is not null")
    with tables(spark) as save:
        left = save(points.select("pt_id", "page_id", "px", "py").where("px is not null and py is not null"))
        held, found = save(held), []
        far = lambda df, *c: df.agg(F.max(F.greatest(*[F.abs(x) for x in c]))).first()[0] or 0.0
        widest = 2 * max(far(left, "px", "py"), far(held, "cx", "cy"))
        while True:
            at = lambda c, w=cell: F.floor(F.col(c) / w).cast("long")
            around = lambda c: F.explode(F.sequence(at(c) - 1, at(c) + 1))  # noqa: E731, B023
            near = left.withColumn("gx", around("px")).withColumn("gy", around("py")).join(held.withColumns({"gx": at("cx"), "gy": at("cy")}), ["page_id", "gx", "gy"])
            dx, dy = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
            best = save(near.groupBy("pt_id").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "c", F.col("box_id").alias("id"))).alias("m")), keep=True)
            last = cell > widest
            sure = best if last else best.where(F.col("m.d") <= cell * cell)
            found.append(sure.select("pt_id", F.col("m.id").alias("box_id")))
            left = None if last else save(left.join(sure.select("pt_id"), "pt_id", "left_anti"))
            if last or left.isEmpty():
                break
            cell *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _pick_dense(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """pick_box where pages have many boxes: a bucketed join for the boxes around a point, then the grid."""
    b = Box.of()
    near = overlap_join(points, boxes, (F.col("py"), F.col("py")), (b.top, b.bottom), ["page_id"])
    near = near.where((F.col("px") >= b.left) & (F.col("px") <= b.right) & (F.col("py") >= b.top) & (F.col("py") <= b.bottom))
    rank = F.min(F.struct((b.width * b.height).alias("by"), (-F.col("conf")).alias("c"), F.col("box_id").alias("id"))).alias("m")
    with tables(points.sparkSession) as save:
        inside = save(near.groupBy("pt_id").agg(rank).select("pt_id", F.col("m.id").alias("box_id")), keep=True)
        outside = nearest_centre(points.join(inside.select("pt_id"), "pt_id", "left_anti"), boxes)
    return inside.withColumn("inside", F.lit(True)).unionByName(outside.withColumn("inside", F.lit(False)))


def pick_box(points: DataFrame, boxes: DataFrame, few: int = FEW) -> DataFrame:
    """(pt_id, page_id, px, py), boxes -> pt_id, box_id, inside: the smallest box around a point, else the nearest centre.

    Ties: higher conf, then smaller id. Pages without boxes give no row. The boxes of a page that has up to ``few`` come to its points as one
    array, so that points move once and their pairs never; pages with more go through buckets and a grid.
    """
    b = Box.of()
    at = points.select("pt_id", "page_id", "px", "py").where("px is not null and py is not null")
    cx, cy = (b.left + b.right) / 2, (b.top + b.bottom) / 2
    held = boxes.select("page_id", "box_id", *b, "conf").where(cx.isNotNull() & cy.isNotNull())
    with tables(points.sparkSession) as save:
        dense = save(held.groupBy("page_id").count().where(F.col("count") > few).select("page_id"), keep=True)
        any_dense = not dense.isEmpty()
    sparse = held.join(dense, "page_id", "left_anti") if any_dense else held
    arrays = sparse.groupBy("page_id").agg(F.collect_list(F.struct("left_x", "top_y", "right_x", "bottom_y", "conf", "box_id")).alias("held"))

    def rank(e):
        x = Box(e["left_x"], e["top_y"], e["right_x"], e["bottom_y"])
        inside = (F.col("px") >= x.left) & (F.col("px") <= x.right) & (F.col("py") >= x.top) & (F.col("py") <= x.bottom)
        dx, dy = F.col("px") - (x.left + x.right) / 2, F.col("py") - (x.top + x.bottom) / 2
        return F.struct((~inside).alias("out"), F.when(inside, x.width * x.height).otherwise(dx * dx + dy * dy).alias("by"), (-e["conf"]).alias("c"), e["box_id"].alias("id"))

    best = at.join(arrays, "page_id").select("pt_id", F.array_min(F.transform("held", rank)).alias("m"))
    out = best.select("pt_id", F.col("m.id").alias("box_id"), (~F.col("m.out")).alias("inside"))
    if any_dense:
        out = out.unionByName(_pick_dense(at.join(dense, "page_id", "left_semi"), held.join(dense, "page_id", "left_semi")))
    return out


def slice_boxes(slices: DataFrame, boxes: DataFrame) -> DataFrame:
    """Slices (page_id, slice_no, top, bottom) x boxes -> the boxes' parts in each slice, in its coordinates."""
    both = overlap_join(slices, boxes, (F.col("top").cast("double"), F.col("bottom").cast("double")), (F.col("top_y"), F.col("bottom_y")), ["page_id"])
    both = both.where((F.col("bottom_y") > F.col("top")) & (F.col("top_y") < F.col("bottom")))
    return both.select(
        "page_id", "slice_no", "box_id", F.col("left_x").alias("left"),
        (F.greatest(F.col("top_y"), F.col("top").cast("double")) - F.col("top")).alias("rel_top"), F.col("right_x").alias("right"),
        (F.least(F.col("bottom_y"), F.col("bottom").cast("double")) - F.col("top")).alias("rel_bottom"),
    )


def assign_tokens(tokens: DataFrame, boxes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """tokens(tok_id, page_id, box), boxes -> tok_id, box_id, how, and the tokens' columns that ``keep`` names.

    A token goes to the smallest box that holds its centre, edges included (``inside``), areas counted
    as 1 at least; else to the box that it overlaps most, ties to the smaller box (``overlap``); last
    ties to the smaller id. Tokens that touch no box have no row.
    """
    sides = ("left_x", "top_y", "right_x", "bottom_y")
    t = tokens.select("page_id", "tok_id", *[F.col(c).alias(f"t_{c}") for c in sides], *[F.col(c).alias(f"k_{c}") for c in keep])
    both = overlap_join(t, boxes.select("page_id", "box_id", *sides), (F.col("t_top_y"), F.col("t_bottom_y")), (F.col("top_y"), F.col("bottom_y")), ["page_id"])
    tb, b = Box.of("t_"), Box.of()
    cx, cy = (tb.left + tb.right) / 2, (tb.top + tb.bottom) / 2
    inside = (cx >= b.left) & (cx <= b.right) & (cy >= b.top) & (cy <= b.bottom)
    w, h = overlap(tb, b)
    common = F.greatest(lit(0), w) * F.greatest(lit(0), h)
    size = F.greatest(lit(1), b.width * b.height)
    both = both.where(inside | (common > 0))
    # centre inside first; there only the area counts, else the overlap comes before it
    rank = F.struct((~inside).alias("out"), F.when(inside, lit(0)).otherwise(-common).alias("c"), size.alias("a"), F.col("box_id").alias("id"))
    best = both.groupBy("tok_id").agg(F.min(rank).alias("m"), *[F.any_value(f"k_{c}").alias(c) for c in keep])
    return best.select("tok_id", F.col("m.id").alias("box_id"), F.when(F.col("m.out"), "overlap").otherwise("inside").alias("how"), *keep)


def centre_inside(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """tokens(tok_id, page_id, cx, cy) -> tok_id, inside: whether any box of the page holds the point."""
    t = tokens.select("page_id", "tok_id", "cx", "cy")
    both = overlap_join(t, boxes.select("page_id", "left_x", "top_y", "right_x", "bottom_y"), (F.col("cy"), F.col("cy")), (F.col("top_y"), F.col("bottom_y")), ["page_id"])
    held = both.where("cx >= left_x and cx <= right_x and cy >= top_y and cy <= bottom_y").select("tok_id").distinct().withColumn("hit", F.lit(True))
    return tokens.select("tok_id").join(held, "tok_id", "left").select("tok_id", F.coalesce("hit", F.lit(False)).alias("inside"))


def decide(tokens: DataFrame, first: float, second: float) -> DataFrame:
    """tokens(tok_id, conf, upgraded, inside) -> tok_id, accepted, reason. Upgraded tokens use the second threshold."""
    threshold = F.when(F.col("upgraded"), lit(second)).otherwise(lit(first))
    reason = F.when(F.col("conf") < threshold, "below_threshold").when(~F.col("inside"), "outside_bubble").otherwise("ok")
    return tokens.select("tok_id", (reason == "ok").alias("accepted"), reason.alias("reason"))


def match_geometry(bubbles: DataFrame, segments: DataFrame, iou_thr: float = 0.30) -> DataFrame:
    """bubbles(box_id, page_id, box), segments(seg_id, page_id, box) -> box_id, seg_id, best_iou, source.

    The segment with the largest IoU counts if it reaches the threshold (ties: smaller id); otherwise
    the bubble keeps its best IoU (0 without overlap), no segment, and the fallback source.
    """
    s = segments.select("page_id", "seg_id", *[F.col(c).alias(f"s_{c}") for c in ("left_x", "top_y", "right_x", "bottom_y")])
    both = overlap_join(bubbles.select("page_id", "box_id", "left_x", "top_y", "right_x", "bottom_y"), s, (F.col("top_y"), F.col("bottom_y")), (F.col("s_top_y"), F.col("s_bottom_y")), ["page_id"])
    value = iou(Box.of(), Box.of("s_"), "match")
    best = both.withColumn("iou", value).where("iou > 0").groupBy("box_id").agg(F.min(F.struct((-F.col("iou")).alias("v"), F.col("seg_id").alias("id"))).alias("m"))
    out = bubbles.select("box_id").join(best, "box_id", "left")
    value = F.coalesce(-F.col("m.v"), lit(0))
    good = value >= iou_thr
    return out.select("box_id", F.when(good, F.col("m.id")).alias("seg_id"), value.alias("best_iou"), F.when(good, "segmentation").otherwise("bbox_fallback").alias("source"))


def merge_passes(primary: DataFrame, secondary: DataFrame, iou_thr: float = 0.5) -> DataFrame:
    """Two OCR passes (tok_id, page_id, box, text, conf): a secondary result may only upgrade a primary one.

    Secondaries come in order of id; each looks for the primary that it overlaps most (IoU above the
    threshold, ties to the smaller id), as upgraded so far, and replaces its box, text and conf if its
    own conf is strictly higher. Pages are independent. A primary has either its own box or that of a
    secondary before, so the pairs of boxes that can ever meet come from two bucketed joins; only they
    reach Python, as ids, IoUs and confs.
    """
    box = ["left_x", "top_y", "right_x", "bottom_y"]
    s = secondary.select("page_id", *[F.col(c).alias(f"s_{c}") for c in ("tok_id", *box, "conf")])

    def pairs(of: DataFrame, kind: int) -> DataFrame:
        p = of.select("page_id", *[F.col(c).alias(f"p_{c}") for c in ("tok_id", *box, "conf")])
        both = overlap_join(p, s, (F.col("p_top_y"), F.col("p_bottom_y")), (F.col("s_top_y"), F.col("s_bottom_y")), ["page_id"])
        both = both.withColumn("iou", iou(Box.of("p_"), Box.of("s_"), "merge")).where(F.col("iou") > iou_thr)
        both = both if kind == 1 else both.where("p_tok_id < s_tok_id")
        return both.select("page_id", F.lit(kind).alias("kind"), F.col("p_tok_id").alias("p"), F.col("s_tok_id").alias("s"), "iou", F.col("p_conf").alias("pc"), F.col("s_conf").alias("sc"))

    def fold(page: dict) -> dict:
        at: dict = {}  # primary -> the secondary that it has become
        holders: dict = {}  # secondary -> the primaries that have its box
        conf = dict(zip(page["s"], page["sc"], strict=True)) | {(1, p): c for k, p, c in zip(page["kind"], page["p"], page["pc"], strict=True) if k == 1}
        starts = np.r_[0, np.flatnonzero(page["s"][1:] != page["s"][:-1]) + 1, len(page["s"])]
        for b, e in zip(starts[:-1], starts[1:], strict=True):
            met = [(-v, p) for k, p, v in zip(page["kind"][b:e], page["p"][b:e], page["iou"][b:e], strict=True) if k == 1 and p not in at]
            met += [(-v, q) for k, p, v in zip(page["kind"][b:e], page["p"][b:e], page["iou"][b:e], strict=True) if k == 2 for q in holders.get(p, ())]
            if met:
                now, s_id = min(met)[1], page["s"][b]
                if conf[s_id] > (conf[at[now]] if now in at else conf[1, now]):
                    if now in at:
                        holders[at[now]].discard(now)
                    at[now] = s_id
                    holders.setdefault(s_id, set()).add(now)
        return {"tok_id": np.array([*at], np.int64), "by": np.array([*at.values()], np.int64)}

    met = pairs(primary, 1).unionByName(pairs(secondary, 2))
    done = fold_sorted(met, "page_id", ["s", "kind", "p"], fold, "page_id long, tok_id long, by long").drop("page_id")
    new = secondary.select(F.col("tok_id").alias("by"), *[F.col(c).alias(f"s_{c}") for c in (*box, "text", "conf")])
    out = primary.join(done, "tok_id", "left").join(new, "by", "left")
    up = F.col("by").isNotNull()
    return out.select("tok_id", "page_id", *[F.when(up, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in (*box, "text", "conf")], up.alias("upgraded"))


def upgrade_pairs(primary: DataFrame, secondary: DataFrame, iou_thr: float = 0.5) -> DataFrame:
    """The candidates of merge_passes, without its order: p_id, s_id, iou, better (higher conf)."""
    p = primary.select("page_id", *[F.col(c).alias(f"p_{c}") for c in ("tok_id", "left_x", "top_y", "right_x", "bottom_y", "conf")])
    s = secondary.select("page_id", *[F.col(c).alias(f"s_{c}") for c in ("tok_id", "left_x", "top_y", "right_x", "bottom_y", "conf")])
    both = overlap_join(p, s, (F.col("p_top_y"), F.col("p_bottom_y")), (F.col("s_top_y"), F.col("s_bottom_y")), ["page_id"])
    both = both.withColumn("iou", iou(Box.of("p_"), Box.of("s_"), "merge")).where(F.col("iou") > iou_thr)
    return both.select(F.col("p_tok_id").alias("p_id"), F.col("s_tok_id").alias("s_id"), "iou", (F.col("s_conf") > F.col("p_conf")).alias("better"))


def reconcile(expected: DataFrame, received: DataFrame) -> DataFrame:
    """(doc_id, id) twice -> doc_id, missing, extra (sorted arrays), ok; a document of either side has a row."""
    e, r = expected.select("doc_id", "id").distinct(), received.select("doc_id", "id").distinct()
    missing = e.join(r, ["doc_id", "id"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list("id")).alias("missing"))
    extra = r.join(e, ["doc_id", "id"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list("id")).alias("extra"))
    docs = e.select("doc_id").union(r.select("doc_id")).distinct()
    kind = dict(e.dtypes)["id"]
    empty = F.array().cast(f"array<{kind}>")
    out = docs.join(missing, "doc_id", "left").join(extra, "doc_id", "left")
    return out.select("doc_id", F.coalesce("missing", empty).alias("missing"), F.coalesce("extra", empty).alias("extra"), (F.col("missing").isNull() & F.col("extra").isNull()).alias("ok"))
