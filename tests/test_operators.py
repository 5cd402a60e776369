"""Literal cases, properties, and small readings of the operators that SQL cannot express."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.functions import bins, geometry
from quirefold.operators import detections, evalset, layout, masks, metrics, ordering, pixels, scoring, scripts, slicing
from quirefold.operators.folds import fold_sorted


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


BOX = "box_id long, page_id long, left_x double, top_y double, right_x double, bottom_y double, conf double"


@pytest.mark.parametrize(
    ("values", "how", "want"),
    [
        ((1, 2, 3, 4), "mode", 4), ((1, 1, 2, 3), "mode", 1), ((0, 0, 2, 3), "mode", 0), ((0, 1, 2, 3), "mode", 3), ((1, 1, 2, 2), "mode", 1), ((1, 2, 2, 2), "mode", 2),
        ((255, 255, 1, 2), "mode", 255), ((0, 2, 3, 4), "stippled", 4), ((1, 2, 3, 0), "stippled", 1), ((0, 0, 0, 0), "stippled", 0), ((0, 0, 2, 3), "raw", 3),
    ],
)
def test_mode_2x2(spark, values, how, want):
    assert one(spark, pixels.mode_2x2(*[F.lit(v) for v in values], how)) == want


@pytest.mark.parametrize(("cells", "want"), [((1, 2, 3, 4, 5, 6, 7, 8), 8), ((1, 2, 2, 4, 5, 6, 7, 8), 2), ((1, 3, 3, 3, 5, 6, 7, 8), 3), ((4, 4, 4, 4, 5, 6, 7, 8), 4)])
def test_mode_blocks(spark, cells, want):
    rows = [(0, i // 4, i // 2 % 2, i % 2, v) for i, v in enumerate(cells)]
    df = spark.createDataFrame(rows, "vol_id long, z long, y long, x long, v long")
    assert pixels.downsample_blocks(df).first()["v"] == want


def test_bin_edges(spark):
    got = spark.createDataFrame([(0.1,), (0.3,), (0.7,), (1.0,), (0.0,), (None,)], "s double").select(
        bins.bin_index(F.col("s")).alias("r"), bins.bin_index(F.col("s"), side="left").alias("l")
    )
    assert [tuple(r) for r in got.collect()] == [(1, 0), (2, 2), (6, 6), (9, 9), (0, 0), (None, None)]


def test_nms_ties_and_survivors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        x, y = rng.integers(0, 200, 2)
        rows.append((i, int(i % 3), float(x), float(y), float(x + rng.integers(20, 90)), float(y + rng.integers(20, 90)), float(rng.integers(1, 5)) / 5))
    kept = {r["box_id"] for r in detections.nms(spark.createDataFrame(rows, BOX), 0.3).collect()}

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        c = max(0, w) * max(0, h)
        return c / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - c)

    want = set()
    for r in sorted(rows, key=lambda r: (-r[6], r[0])):
        if all(rows[k][1] != r[1] or iou(rows[k], r) < 0.3 for k in want):
            want.add(r[0])
    assert kept == want


def test_tokens_on_edges_and_outside(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 100.0, 1.0), (2, 0, 0.0, 0.0, 100.0, 100.0, 1.0), (3, 0, 50.0, 600.0, 90.0, 700.0, 1.0)], BOX)
    tokens = spark.createDataFrame([(1, 0, 90.0, 40.0, 110.0, 60.0), (2, 0, 500.0, 500.0, 510.0, 510.0), (3, 0, 85.0, 690.0, 200.0, 900.0)], "tok_id long, page_id long, left_x double, top_y double, right_x double, bottom_y double")
    got = {r["tok_id"]: (r["box_id"], r["how"]) for r in detections.assign_tokens(tokens, boxes).collect()}
    assert got == {1: (1, "inside"), 3: (3, "overlap")}


def test_merge_upgrades_in_order(spark):
    kind = "tok_id long, page_id long, left_x double, top_y double, right_x double, bottom_y double, text string, conf double"
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, "a", 0.5), (2, 0, 50.0, 0.0, 60.0, 10.0, "b", 0.5)], kind)
    s = spark.createDataFrame([(1, 0, 1.0, 0.0, 11.0, 10.0, "A", 0.7), (2, 0, 1.0, 0.0, 11.0, 10.0, "AA", 0.6), (3, 0, 200.0, 0.0, 210.0, 10.0, "new", 0.9)], kind)
    got = [(r["tok_id"], r["text"], r["upgraded"]) for r in detections.merge_passes(p, s).orderBy("tok_id").collect()]
    assert got == [(1, "A", True), (2, "b", False)]


def test_leave_one_out_brute_force(spark):
    """Every pair's replacement against the distance of the changed set from scratch."""
    rng = np.random.default_rng(7)
    pred, target = rng.normal(size=(40, 5)), rng.normal(0.3, 1.4, size=(40, 5))
    rows = [(i, s, x[i].tolist()) for i in range(40) for s, x in (("pred", pred), ("target", target))]
    df = spark.createDataFrame(rows, "pair_id long, side string, embedding array<double>")
    moments = lambda x: (x.mean(0), np.cov(x.T))
    full = metrics.frechet_distance(*moments(pred), *moments(target))
    for r in metrics.frechet_loo(df).collect():
        changed = pred.copy()
        changed[r["pair_id"]] = target[r["pair_id"]]
        assert r["delta"] == pytest.approx(metrics.frechet_distance(*moments(changed), *moments(target)) - full, abs=1e-8)


def loo_by_eigenvalues(pred, target, eps=0.0):
    """The change for every pair, from the eigenvalues of each changed set."""
    extra = eps * np.eye(pred.shape[1])
    values, vectors = np.linalg.eigh(np.cov(target.T) + extra)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T

    def distance(x):
        cov = np.cov(x.T) + extra
        return ((x.mean(0) - target.mean(0)) ** 2).sum() + np.trace(cov) - 2 * np.sqrt(np.maximum(np.linalg.eigvalsh(root @ cov @ root), 0)).sum()

    full = distance(pred)
    for i in range(len(pred)):
        changed = pred.copy()
        changed[i] = target[i]
        yield distance(changed) - full


def of(x):
    return len(x), x.sum(0), x.T @ x


@pytest.mark.parametrize(("n", "d", "spread"), [(60, 20, 1.0), (30, 40, 1.0), (200, 6, 1e3), (50, 10, 1e-4)])
def test_replacements_by_the_secular_determinant(n, d, spread):
    """Plain, singular, wide and narrow sets."""
    rng = np.random.default_rng(n)
    scales = np.geomspace(1, spread, d)
    pred, target = rng.normal(size=(n, d)) * scales, rng.normal(0.2, 1.3, size=(n, d)) * scales
    pred[3] = target[3]
    singular = np.linalg.eigvalsh(metrics._cov(*of(pred))[1]).min() <= 0
    got = metrics._Replaced(of(pred), of(target)).deltas(pred, target)
    want = np.array([*loo_by_eigenvalues(pred, target, metrics.EPS_COV if singular else 0.0)])
    assert np.abs(got - want).max() <= 1e-6 * max(1.0, np.abs(want).max())
    assert abs(got[3]) < 1e-9 * max(1.0, spread**2)


def test_replacements_are_ten_times_as_fast_in_many_dims():
    rng = np.random.default_rng(3)
    pred, target = rng.normal(size=(1500, 512)), rng.normal(0.1, 1.2, size=(1500, 512))
    ready = metrics._Replaced(of(pred), of(target))
    began = time.process_time()
    got = ready.deltas(pred[:12], target[:12])
    mine, began = time.process_time() - began, time.process_time()
    want = [x for x, _ in zip(loo_by_eigenvalues(pred, target), range(12), strict=False)]
    assert np.abs(got - want).max() < 1e-6
    assert mine < 0.1 * (time.process_time() - began)


def test_moments_in_tiles_of_many_partitions(spark):
    """Tiles hold a bounded block, and of many partitions no heap has more than its share of partials."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 150))
    df = spark.createDataFrame([(i % 2, r.tolist()) for i, r in enumerate(x)], "k long, embedding array<double>").select(F.when(F.col("k") == 0, "pred").otherwise("target").alias("side"), "embedding").repartition(320)
    tiles = metrics.moment_tiles(df, []).toPandas()
    assert sorted(zip(tiles["side"], tiles["i"], tiles["j"], strict=True)) == [(s, i, j) for s in ("pred", "target") for i, j in ((0, 0), (0, 1), (1, 1))]
    assert max(len(p) for p in tiles["products"]) == metrics.TILE**2
    for k, side in enumerate(("pred", "target")):
        n, sums, products = metrics.assembled(tiles[tiles["side"] == side])
        own = x[k::2]
        assert n == 500 and np.allclose(sums, own.sum(0)) and np.allclose(products, own.T @ own)
    parts, _ = metrics._tile_parts(df, [])
    heaps = parts.groupBy("side", "i", "j", "heap").count().agg(F.max("count"), F.countDistinct("heap")).first()
    assert heaps[0] <= 320 // metrics.HEAPS + 1 and heaps[1] == metrics.HEAPS


def test_folds_of_long_and_short_groups(spark):
    """Groups over many Arrow batches, of one row, and none; strings come back as they were."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).cast("long").alias("k"), "id", F.concat(F.lit("t"), "id").alias("t"))
        got = fold_sorted(df, "k", ["id"], lambda g: {"n": np.array([len(g["id"])]), "t": np.array([g["t"][-1]], dtype=object)} if g["k"][0] != 250 else {"n": np.empty(0, int), "t": np.empty(0, object)}, "k long, n long, t string").collect()
        assert {(r["k"], r["n"], r["t"]) for r in got} == {(0, 200, "t199")} | {(i, 1, f"t{i}") for i in range(200, 300) if i != 250}
        assert fold_sorted(df.limit(0), "k", ["id"], lambda g: {"n": np.array([1]), "t": g["t"][:1]}, "k long, n long, t string").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cuts_reach_the_end(spark):
    rng = np.random.default_rng(2)
    rows = [(p, y, float(rng.random()), bool(rng.random() > (0.95 if p == 2 else 0.4))) for p in range(4) for y in range(60 + 17 * p)]
    df = spark.createDataFrame(rows, "page_id long, y long, cost double, safe boolean")
    for tail in ("absorb", "clamp"):
        for p in range(4):
            parts = [(r["top"], r["bottom"]) for r in slicing.cuts(df, 8, 20, 0.01, tail).where(F.col("page_id") == p).orderBy("slice_no").collect()]
            assert parts[0][0] == 0 and parts[-1][1] == 60 + 17 * p
            assert all(a[1] == b[0] and b[1] > b[0] for a, b in zip(parts, parts[1:], strict=False))
            first = slicing.best_cut(df, spark.createDataFrame([(p, 0)], "page_id long, cur long"), 8, 20, 0.01).first()["y"]
            assert parts[0][1] == first
            if tail == "absorb":
                assert all(b - a >= 8 for a, b in parts)


def test_no_safe_row_takes_the_first(spark):
    df = spark.createDataFrame([(0, y, -float(y), False) for y in range(100)], "page_id long, y long, cost double, safe boolean")
    assert slicing.best_cut(df, spark.createDataFrame([(0, 0)], "page_id long, cur long"), 10, 30, 0.1).first()["y"] == 10


def test_reading_orders_are_permutations(spark):
    rows = [(i, 0, float(10 * (i % 3)), float(30 * (i // 3) + i % 2), float(10 * (i % 3) + 8), float(30 * (i // 3) + 20), 1.0) for i in range(9)]
    boxes = spark.createDataFrame(rows, BOX)
    for f, label in ((ordering.reading_order_rows, "AUTO_0001"), (ordering.reading_order_nearest, "B001")):
        got = f(boxes).orderBy("ordinal").collect()
        assert [r["box_id"] for r in got] == list(range(9))
        assert got[0]["label"] == label
    right = [r["box_id"] for r in ordering.reading_order_nearest(boxes, rtl=True).orderBy("ordinal").collect()]
    assert right == [2, 1, 0, 5, 4, 3, 8, 7, 6]


def test_bubble_text(spark):
    kind = "box_id long, tok_id long, x_mid double, y_mid double, h double, txt string"
    df = spark.createDataFrame([(1, 1, 50.0, 10.0, 10.0, "world"), (1, 2, 10.0, 12.0, 10.0, "hello"), (1, 3, 10.0, 30.0, 10.0, "again"), (1, 4, 20.0, 30.0, 10.0, ""), (2, 5, 1.0, 1.0, 0.0, "x")], kind)
    assert {r["box_id"]: r["text"] for r in ordering.bubble_text(df).collect()} == {1: "hello world\nagain", 2: "x"}


def test_fold_sorted_spans_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(500).select((F.col("id") % 9).alias("k"), F.col("id").alias("v"))
        got = fold_sorted(df, "k", ["v"], lambda g: {"n": np.array([len(g["v"])]), "ok": np.array([bool((np.diff(g["v"]) > 0).all())])}, "k long, n long, ok boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["k"] for r in got) == list(range(9))
    assert sum(r["n"] for r in got) == 500 and all(r["ok"] for r in got)


def test_union_area(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(5):
        grid = np.zeros((60, 60), bool)
        for _ in range(6):
            y, x = (int(v) for v in rng.integers(0, 40, 2))
            h, w = (int(v) for v in rng.integers(0, 20, 2))
            grid[y : y + h, x : x + w] = True
            rows.append((k, x, y, x + w, y + h))
        want[k] = int(grid.sum())
    got = {r["k"]: r["area"] for r in ordering.union_area(spark.createDataFrame(rows, "k long, x0 long, y0 long, x1 long, y1 long"), "k").collect()}
    assert got == want


def test_frechet(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(80, 5)), rng.normal(0.5, 2, size=(80, 5))
    rows = [(i, s, x.tolist()) for s, m in (("pred", a), ("target", b)) for i, x in enumerate(m)]
    df = spark.createDataFrame(rows, "pair_id long, side string, embedding array<double>")

    def distance(p, t):
        c1, c2 = np.cov(p.T), np.cov(t.T)
        cross = np.sqrt(np.linalg.eigvals(c1 @ c2).astype(complex)).real.sum()
        return ((p.mean(0) - t.mean(0)) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross

    full = metrics.frechet(df).first()["value"]
    assert full == pytest.approx(distance(a, b), rel=1e-6)
    loo = {r["pair_id"]: r["delta"] for r in metrics.frechet_loo(df).collect()}
    moved = a.copy()
    moved[3] = b[3]
    assert loo[3] == pytest.approx(distance(moved, b) - distance(a, b), abs=1e-6)
    same = spark.createDataFrame([(i, s, x.tolist()) for s in ("pred", "target") for i, x in enumerate(a)], df.schema)
    assert abs(metrics.frechet(same).first()["value"]) < 1e-5
    lone = spark.createDataFrame([(0, "pred", [1.0]), (0, "target", [1.0])], df.schema)
    assert np.isnan(metrics.frechet(lone).first()["value"])


def test_ssim_of_itself_is_one():
    page = np.random.default_rng(0).random((30, 20))
    assert pixels.ssim_of(page, page) == pytest.approx(1.0)
    assert pixels.ssim_of(page, 1 - page) < 0.2


def test_shape_statistics(spark):
    w = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert tuple(one(spark, layout.shape_stats(w(5, 9)))) == (0.0, 0.0, 1.0, 0.0)
    good = one(spark, layout.shape_stats(w(40, 80, 100, 80, 40)))
    assert good["hard"] == 0 and good["soft"] == 0 and good["edge_ratio"] == pytest.approx(0.4)
    bad = one(spark, layout.shape_stats(w(100, 40, 100)))
    assert bad["hard"] == 2 and bad["soft"] > 1
    assert one(spark, layout.sequence_penalty(w(10, 20, 10))) == 0
    assert one(spark, layout.peak_penalty(w(30, 20, 10))) > 2.4
    assert one(spark, layout.badness(F.array(F.lit("won-"), F.lit("der")))) == pytest.approx(0.6 + 2.2)


def test_oval(spark):
    b = geometry.Box(*[F.lit(float(v)) for v in (0, 0, 20, 10)])
    pts = one(spark, geometry.oval_poly(b))
    assert len(pts) == 48
    assert (pts[0]["x"], pts[0]["y"]) == (10.0, 0.0) and (pts[12]["x"], pts[12]["y"]) == (20.0, 5.0)
    assert max(p["x"] for p in pts) <= 20.0001 and min(p["y"] for p in pts) >= -0.0001


def test_parse_script_last_header_counts(spark):
    rows = [(1, 0, "lost"), (1, 1, "[B1]"), (1, 2, " one "), (1, 3, "[B2]"), (1, 4, "two"), (1, 5, " [B1] "), (1, 6, "«new»"), (1, 7, None)]
    got = {r["bubble_id"]: r["text"] for r in scripts.parse_script(spark.createDataFrame(rows, "doc_id long, line_no long, raw string")).collect()}
    assert got == {"B1": '"new"', "B2": "two"}


def test_last_flag_and_style_carry(spark):
    rows = [(0, i, t) for i, t in enumerate(["S: a", "// b", "## x", "Page 2", "//: c", "plain", "page 3"])]
    prefixes = spark.createDataFrame([("S:", "s", None, 1)], "prefix string, style_id string, folder string, ord int")
    got = scripts.parse_lines(spark.createDataFrame(rows, "page_id long, line_no long, raw_text string"), prefixes, ["##"], []).orderBy("line_no").collect()
    assert [r["style_id"] for r in got] == ["s", "s", None, None, "s", None, None]
    assert [r["index"] for r in got] == [1, 2, 0, 0, 3, 4, 0]
    assert [r["last"] for r in got] == [False, True, False, False, False, True, False]


def test_sets_must_agree(spark):
    df = spark.range(3).select(F.col("id").alias("sample_id"), F.lit(1.0).alias("value"))
    with pytest.raises(ValueError, match="differ"):
        evalset.compare_models({"a": df, "b": df.limit(2)})


def test_empty_tables(spark):
    boxes = spark.createDataFrame([], BOX)
    tokens = boxes.withColumnRenamed("box_id", "tok_id")
    assert detections.nms(boxes, 0.5).count() == 0
    assert detections.assign_tokens(tokens, boxes).count() == 0
    assert ordering.reading_order_rows(boxes).count() == 0
    assert metrics.evaluate(spark.createDataFrame([], "hole_frac double, ssim double"), ["ssim"]).count() == 0


def test_quality_reads_every_word(spark):
    from types import SimpleNamespace

    from quirefold.plans import q_masks

    texts = [" ".join(f"w{i}-" for i in range(n)) for n in (1, 11, 12, 13, 24, 40)] + ["", "a-  b- ", " ".join(["c-"] * 12) + " ", "d-\ne- f-\n", None]
    docs = spark.createDataFrame([(4 * i + 3, "x", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    got = q_masks._quality(SimpleNamespace(documents=docs)).collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in got if r["bubble_id"].split(":")[0] == str(4 * i + 3)), key=lambda r: int((r["bubble_id"].split(":") + ["0"])[1]))
        words = None if t is None else t.split(" ")
        # lines of five words, blocks of twelve
        want = [None] if words is None else [sum(" ".join(b[k : k + 5]).strip(" ").endswith("-") for k in range(0, len(b), 5)) for b in (words[j : j + 12] for j in range(0, len(words), 12))]
        assert [r["hyphens"] for r in mine] == want, (i, t)


def test_masks_are_whole_unions(spark):
    from quirefold.operators import masks

    kind = "image_id long, mask_id long, y0 long, y1 long, x0 long, x1 long"
    cand = spark.createDataFrame([(1, 2, 0, 10, 0, 10), (1, 2, 0, 10, 5, 15), (1, 2, 40, 50, 0, 5), (9, 4, 0, 4, 0, 4)], kind)
    old = spark.createDataFrame([(1, 3, 90, 99, 90, 99), (1, 3, 45, 55, 0, 5), (1, 3, 0, 2, 8, 12)], kind)
    got = {r["mask_id"]: (r["max_inter_existing"], r["max_inter_current"], r["accepted"]) for r in masks.accept_masks(cand, old, 0.2, 0.3).collect()}
    # 25 and 8 pixels of 81 + 50 + 8, and of 150 + 50
    assert got == {2: (33 / 139, 33 / 200, False), 4: (0.0, 0.0, True)}
    dims = spark.createDataFrame([(2, 64, 64), (4, 64, 64)], "mask_id long, w long, h long")
    moved = masks.place(cand, dims, 7, variants=3, scale=0.0, shift=0.0, min_share=0.0).collect()
    original = {(y, x) for a, b, c, d in ((0, 10, 0, 15), (40, 50, 0, 5)) for y in range(a, b) for x in range(c, d)}
    for k in range(3):
        mine = [r for r in moved if (r["mask_id"], r["variant"]) == (2, k)]
        cells = {(y, x) for r in mine for y in range(r["y0"], r["y1"]) for x in range(r["x0"], r["x1"])}
        rows = {y for y, _ in cells}
        assert cells and len(cells & original) <= 0.5 * min(len(cells), 200) and rows <= {*range(10), *range(40, 50)}
    assert any(len({r["y0"] for r in moved if (r["mask_id"], r["variant"]) == (2, k)}) == 2 for k in range(3))


def greedy(rows, threshold):
    """Boxes from the highest score down, each kept unless one that is kept overlaps it."""
    kept = []
    for r in sorted(rows, key=lambda r: (-(r[6] if r[6] is not None else -math.inf), r[0])):
        def near(k, r=r):
            w, h = min(k[4], r[4]) - max(k[2], r[2]), min(k[5], r[5]) - max(k[3], r[3])
            common = max(0.0, w) * max(0.0, h)
            size = lambda b: (b[4] - b[2]) * (b[5] - b[3])
            return k[1] == r[1] and common / max(1e-9, size(k) + size(r) - common) >= threshold
        if not any(near(k) for k in kept):
            kept.append(r)
    return sorted(k[0] for k in kept)


def test_suppression_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), float(x), float(y), float(x + rng.randint(20, 60)), float(y + rng.randint(20, 60)), rng.choice([0.1, 0.5, 0.9, None])) for i in range(250) for x, y in [(rng.randrange(250), rng.randrange(250))]]
    df = spark.createDataFrame(rows, BOX)
    assert sorted(r["box_id"] for r in detections.nms(df, 0.15).collect()) == greedy(rows, 0.15)
    edges = detections.conflicts(df, 0.15)
    want = {r[0] for r in rows} - {*greedy(rows, 0.15)}
    # chains from the first round on, and never
    for plain in (0, 100):
        assert {r["box_id"] for r in detections.suppressed(edges, plain).collect()} == want
    assert detections.nms(df.limit(0), 0.5).collect() == []


def test_suppression_along_a_chain(spark):
    """Ten thousand boxes of one page, each over the next: every second one stays, without a round for each."""
    n = 10_000
    at = F.col("id") * 6
    boxes = spark.range(n).select(F.col("id").alias("box_id"), F.lit(1).alias("page_id"), F.lit(0.0).alias("left_x"), at.cast("double").alias("top_y"), F.lit(10.0).alias("right_x"), (at + 10).cast("double").alias("bottom_y"), (1 - F.col("id") / n).alias("conf"))
    kept = detections.nms(boxes, 0.2)
    assert sorted(r["box_id"] for r in kept.select("box_id").collect()) == list(range(0, n, 2))
    assert "Python" not in kept._jdf.queryExecution().toString() and "Pandas" not in kept._jdf.queryExecution().toString()


def test_nearest_centres(spark):
    rng = random.Random(6)
    boxes = [(i, i % 3, float(x), float(y), float(x + 10), float(y + 10), rng.choice([0.2, 0.7])) for i in range(60) for x, y in [(rng.choice([rng.randrange(-50, 4000), 100]), rng.choice([rng.randrange(9000), 100]))]]
    points = [(i, i % 4, float(rng.randrange(-3000, 9000)), float(rng.randrange(9000))) for i in range(150)] + [(900, 1, None, 5.0), (901, 0, 105.0, 105.0)]
    frame = spark.createDataFrame(points, "pt_id long, page_id long, px double, py double")
    got = {r["pt_id"]: r["box_id"] for r in detections.nearest_centre(frame, spark.createDataFrame(boxes, BOX), cell=64.0).collect()}
    want = {}
    for p, page, x, y in points:
        mine = [((b[2] + b[4]) / 2, (b[3] + b[5]) / 2, -b[6], b[0]) for b in boxes if b[1] == page]
        if mine and x is not None:
            want[p] = min(((x - cx) ** 2 + (y - cy) ** 2, c, i) for cx, cy, c, i in mine)[2]
    assert got == want


@pytest.mark.parametrize("few", [0, 12, 64])
def test_picked_boxes(spark, few):
    """Pages of 1, 8, 16 and 32 boxes; ties in area and distance, null conf, points without coordinates and without boxes."""
    rng = random.Random(8)
    pages = [p for p, n in enumerate((1, 8, 16, 32)) for _ in range(n)]
    boxes = [(i, p, float(x), float(y), float(x + 40), float(y + rng.choice([30, 60])), rng.choice([0.2, 0.7, None])) for i, p in enumerate(pages) for x, y in [(10 * rng.randrange(30), 10 * rng.randrange(40))]]
    points = [(i, i % 5, 5.0 * rng.randrange(80), 5.0 * rng.randrange(100)) for i in range(400)] + [(900, 1, None, 5.0), (901, 1, 5.0, None)]
    found = detections.pick_box(spark.createDataFrame(points, "pt_id long, page_id long, px double, py double"), spark.createDataFrame(boxes, BOX), few)
    want = set()
    for p, page, x, y in points:
        ranks = []
        for b, at, left, top, right, bottom, conf in boxes:
            if at == page and x is not None and y is not None:
                inside = left <= x <= right and top <= y <= bottom
                by = (right - left) * (bottom - top) if inside else (x - (left + right) / 2) ** 2 + (y - (top + bottom) / 2) ** 2
                ranks.append((not inside, by, (0, 0) if conf is None else (1, -conf), b))
        if ranks:
            want.add((p, min(ranks)[3], not min(ranks)[0]))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_points_of_small_pages_move_once(spark):
    """No explode and no grouping by point where pages have few boxes."""
    boxes = spark.createDataFrame([(i, i // 8, 1.0 * i, 1.0 * i, i + 9.0, i + 9.0, 0.5) for i in range(64)], BOX)
    points = spark.range(100).selectExpr("id as pt_id", "id % 8 as page_id", "double(id) as px", "double(id) as py")
    plan = detections.pick_box(points, boxes)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "keys=[pt_id" not in plan and "scratch" not in plan


def test_placed_copies_fit(spark):
    """Every copy against its cells: within the image, over enough of it, and no more over the mask than allowed."""
    from quirefold.operators import masks

    rng = random.Random(8)
    rects = [(m, y, y + rng.randint(2, 20), x, x + rng.randint(2, 20)) for m in range(30) for _ in range(rng.randint(1, 5)) for y, x in [(rng.randrange(40), rng.randrange(40))]]
    kind = "mask_id long, y0 long, y1 long, x0 long, x1 long"
    dims = spark.createDataFrame([(m, 64, 48) for m in range(29)], "mask_id long, w long, h long")
    moved = masks.place(spark.createDataFrame(rects, kind), dims, 7, limit=0.3, min_share=0.01).collect()
    cells = lambda rows: {(y, x) for _, a, b, c, d in rows for y in range(a, b) for x in range(c, d)}
    found = {(r["mask_id"], r["variant"]) for r in moved}
    assert len(found) > 20 and {m for m, _ in found} <= {*range(29)}
    for m, k in found:
        mask = cells(r for r in rects if r[0] == m)
        copy = cells((m, r["y0"], r["y1"], r["x0"], r["x1"]) for r in moved if (r["mask_id"], r["variant"]) == (m, k))
        assert all(0 <= y < 48 and 0 <= x < 64 for y, x in copy)
        assert len(copy) >= 0.01 * 48 * 64 and len(copy & mask) <= 0.3 * min(len(mask), len(copy))


def test_parts_of_shards_brute_force(spark):
    """Both bounds, records larger than a part, nulls, ties with the bounds, and shards over many Arrow batches."""
    from quirefold.sources import files

    rng = random.Random(9)
    rows = [(s, i, rng.choice([None, 0, 5, 10, 40, 100, 300])) for s in range(4) for i in range(60 if s else 400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame(rows, "shard long, id long, size long")
        got = {(r["shard"], r["id"]): r["part"] for r in files.numbered(df.repartition(5), "shard", ["id"], "size", 6, 100).collect()}
        assert files.numbered(df.limit(0), "shard", ["id"], "size", 6, 100).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = {}, None
    for s, i, size in rows:
        if s != last:
            part, n, held, last = 0, 0, 0, s
        if n and (n == 6 or held + (size or 0) > 100):
            part, n, held = part + 1, 0, 0
        want[s, i], n, held = part, n + 1, held + (size or 0)
    assert got == want


def test_ssim_of_blocks_of_rows(spark):
    """Pages over several blocks, of one row and column, and pairs that don't match, against the whole page at once."""
    rng = np.random.default_rng(11)
    pages = {1: (70, 9), 2: (1, 1), 3: (16, 30), 4: (5, 4), 5: (6, 6)}
    a = {p: rng.integers(0, 256, shape) for p, shape in pages.items()}
    b = {p: np.clip(x + rng.integers(-40, 40, x.shape), 0, 255) for p, x in a.items()}
    rows = lambda x, skip: [(p, y, r.tolist()) for p, m in x.items() for y, r in enumerate(m) if (p, y) != skip]
    frame = lambda x, skip=None: spark.createDataFrame(rows(x, skip), "page_id long, y long, px array<long>")
    got = {r["page_id"]: r["ssim"] for r in pixels.ssim(frame(a), frame(b, (5, 3)), block=16).collect()}
    assert got == {p: pytest.approx(pixels.ssim_of(a[p] / 255, b[p] / 255), abs=1e-9) for p in (1, 2, 3, 4)}
    assert pixels.ssim(frame(a).limit(0), frame(b).limit(0)).collect() == []


@pytest.mark.parametrize("apart", [0.3, 6.0])
def test_separating_scores(spark, apart):
    """Scores are linear, at the minimum (its gradient is zero), the same for any partitions, and put the sides apart."""
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(80, 6)), np.repeat([1.0, -1.0], 40)
    x[:40, 0] += apart
    rows = [(i, "target" if s > 0 else "pred", v.tolist()) for i, (v, s) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "pair_id long, side string, embedding array<double>")
    one, many = ({r["pair_id"]: r["score"] for r in metrics.separability(df.repartition(k)).collect()} for k in (1, 8))
    scores = np.array([one[i] for i in range(80)])
    assert np.allclose(scores, [many[i] for i in range(80)], atol=1e-9)
    whole = np.c_[x, np.ones(80)]
    w, *_ = np.linalg.lstsq(whole, scores, rcond=None)
    assert np.allclose(whole @ w, scores)
    assert np.abs(w - 2 * whole.T @ (y * np.maximum(0, 1 - y * scores))).max() < 1e-6
    assert ((scores > 0) == (y > 0)).mean() > (0.95 if apart > 1 else 0.5)
    assert metrics.separability(df.limit(0)).collect() == []


@pytest.mark.parametrize("tail", ["absorb", "clamp"])
def test_tall_pages_are_cut_block_by_block(spark, tail):
    """A page of a million rows and shorter ones around the size of a block, against a walk from the top."""
    n = {0: 1_000_000, 1: 1, 2: 64, 3: 65, 4: 200, 5: 128, 6: 143}
    rows = None
    for p, tall in n.items():
        some = spark.range(tall).select(F.lit(p).cast("long").alias("page_id"), F.col("id").alias("y"), (F.pmod(F.xxhash64("id", F.lit(p)), F.lit(1000)) / 1000.0).alias("cost"), (F.pmod(F.xxhash64(F.lit(p), "id"), F.lit(10)) > 5).alias("safe"))
        rows = some if rows is None else rows.unionByName(some)
    block = lambda size: slicing.cuts(rows.where("page_id > 0") if size < 1000 else rows, 8, 20, 0.01, tail, size)
    found = {size: sorted(map(tuple, block(size).collect())) for size in (64, 100_000, 10_000_000)}
    assert found[100_000] == found[10_000_000]
    assert found[64] == [r for r in found[10_000_000] if r[0] > 0]
    assert len([r for r in found[100_000] if r[0] == 0]) > 50_000


def test_block_quality_counts_lines_once(spark):
    """The plan of a block's quality stays small: what several terms read is not copied into each of them."""
    lines = ["a-", "b c", "...", "(İx)", "won-", "\t o  ", ""]
    df = spark.createDataFrame([("1:0", "de", lines, [7.5 * len(x) for x in lines]), ("2:0", "de", ["x"], [7.5]), ("3:0", None, [], [])], "bubble_id string, class string, lines array<string>, widths array<double>")
    q = layout.layout_quality(df)
    assert q._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 10
    got = {r["bubble_id"]: r for r in q.collect()}
    assert got["1:0"]["hyphens"] == 2 and got["2:0"]["badness"] == 0.0 and got["3:0"]["badness"] == 0.0


def test_max_font_adds_advances_exactly(spark):
    """0.1 + 0.2 is 0.3 of an em: at 20 points one line of a box that is 6 wide."""
    advance = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "ch string, em double")
    box = spark.createDataFrame([(1, "ab", 6.0, 25.0)], "bubble_id long, text string, box_w double, box_h double")
    assert layout.max_font(box, advance).first()["font_pt"] == 20


def test_shifts_of_masks_are_no_rows(spark):
    """A mask and its copy are one row until the copy's place is known: the one explode is that of variants."""
    rects = spark.createDataFrame([(1, 10, 40, 10, 40), (1, 20, 60, 30, 50), (2, 0, 9, 0, 9)], "mask_id long, y0 long, y1 long, x0 long, x1 long")
    dims = spark.createDataFrame([(1, 128, 128), (2, 128, 1)], "mask_id long, w long, h long")
    out = masks.place(rects, dims, 7, min_share=0.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert {r["mask_id"] for r in out.collect()} <= {1, 2}


def test_chapters_are_streamed(spark):
    """No Python call a chapter from the JVM, and chapters that go over several batches are whole, the one without a name too."""
    rows = spark.range(1000).selectExpr("case when id % 3 < 2 then concat('c', id % 3) end as folder", "id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = scoring.run_chapters(rows, lambda r: len(r) if r.index[-1] == len(r) - 1 else 1 // 0)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        assert sorted((r["folder"] or "", r["status"], r["n"]) for r in out.collect()) == [("", "done", 333), ("c0", "done", 334), ("c1", "done", 333)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_lines_work_out_a_segment_once(spark):
    """What is one number a segment stands below its rows in the plan, not in every term above them."""
    s = spark.createDataFrame([(1, 3, 4, 30, 44, 7), (1, 5, 5, 5, 5, 6), (1, 0, 9, 20, 9, 5)], "image_id long, x0 long, y0 long, x1 long, y1 long, width long")
    plan = masks.lines_of(s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("Generate explode")].upper().count("SQRT") <= 12


def test_oval_points_by_number(spark):
    """The query numbers the points of a box first, so that no array of them is built."""
    from quirefold.plans import registered

    plan = registered()[0]["p16_oval_poly"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "lambdafunction" not in plan
    b = geometry.Box(*[F.lit(float(x)) for x in (3, 5, 40, 90)])
    poly, points = spark.range(1).select(geometry.oval_poly(b, 5), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: geometry.oval_point(b, i, 5))).first()
    assert poly == points and len(poly) == 20 and tuple(poly[0]) == (21.5, 5.0) and tuple(poly[5]) == (40.0, 47.5)


def test_oval_points_of_one_outline_lie_together(spark):
    """Within a task boxes come by their sides, all 48 points of each in a row, so that files hold equal numbers side by side."""
    from quirefold.plans import registered

    out = registered()[0]["p16_oval_poly"](spark, "/root/testdata/sf0.01").withColumn("part", F.spark_partition_id())
    points = [tuple(r) for r in out.where("part = 0").select("box_id", "i", "x").collect()]
    assert len(points) > 48 * 1000 and all(r[1] == k % 48 for k, r in enumerate(points)) and all(len({r[0] for r in points[k : k + 48]}) == 1 for k in range(0, len(points), 48))
    # point 12 is in the middle of the right side, point 36 of the left one
    sides = [(points[k + 36][2], points[k + 12][2]) for k in range(0, len(points), 48)]
    assert sides == sorted(sides)


def test_outlines_are_boxes(spark, sf, tmp_path):
    """Lines that agree in their place but not in being a box are numbered by the other columns; the usual ones move without those."""
    from quirefold.plans.fixtures import frame

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    some = lines.where("l_orderkey % 3 = 0")
    twins = some.withColumns({"l_linestatus": F.expr("case when l_linestatus = 'O' then 'F' when l_partkey % 2 = 0 then null else 'O' end"), "l_extendedprice": F.col("l_extendedprice") + F.col("l_partkey") % 3 - 1})
    odd = lines.limit(3).withColumns({"l_orderkey": F.lit(None).cast("long")})
    lines.unionAll(twins).unionAll(lines.where("l_orderkey % 3 = 1")).unionAll(odd).unionAll(twins.limit(50)).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    for at in (sf, str(tmp_path)):
        got, want = frame(spark, at, "outlines"), frame(spark, at, "boxes").select("box_id", "left_x", "top_y", "right_x", "bottom_y")
        assert want.count() == got.count() > 1000 and got.exceptAll(want).isEmpty()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = frame(spark, sf, "outlines")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len([x for x in plan if "REPARTITION_BY_COL" in x and "ReusedExchange" not in x]) == 1
    assert ["l_tax" in x for x in plan if " Sort [l_orderkey" in x] == [False, True]
