"""Evaluation of predictions: grouped metrics, class tables, score comparisons, distribution distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.bins import bin_index, bin_label
from quirefold.session import tables

EPS = 1e-3


def evaluate(samples: DataFrame, metrics: list[str], bins: int = 10, rule: str = "right") -> DataFrame:
    """samples(hole_frac, metric columns) -> score, grp, mean, std, n: over all samples (grp null) and by area bin.

    One scan: metrics become rows, and grouping sets give both levels. std is that of the population.
    Null metric values don't count; a null hole_frac counts in the total only.
    """
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    long = samples.select(bin_index(F.col("hole_frac"), bins, rule).alias("grp"), F.expr(f"stack({len(metrics)}, {pairs}) as (score, value)"))
    out = long.groupingSets([["score"], ["score", "grp"]], "score", "grp").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"), F.grouping("grp").alias("total")
    )
    return out.where("total = 1 or grp is not null").select("score", F.when(F.col("total") == 0, bin_label(F.col("grp"), bins)).alias("grp"), "mean", "std", "n")


def composite_f1(similarity: Column, fid: Column) -> Column:
    """Harmonic mean of a similarity and the distance turned into one, with EPS in the denominator."""
    closeness = F.greatest(F.lit(0.0), 100.0 - fid) / 100.0
    return 2 * similarity * closeness / (similarity + closeness + EPS)


def class_stats(freq: DataFrame, by: list[str] | None = None) -> DataFrame:
    """class_freq -> class_id, total_freq, mask_freq, mask_freq_diff, optionally within further columns.

    Frequencies are shares of all pixels and of all masked target pixels; the difference compares
    predicted with target pixels, relative to the target with EPS added. Classes without any target
    pixel in the mask are left out.
    """
    by = by or []
    sums = freq.groupBy(*by, "class_id").agg(*[F.sum(c).alias(c) for c in ("n_total", "n_mask_target", "n_mask_pred")])
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = lambda c: F.col(c) / F.sum(c).over(everything)
    out = sums.withColumns({"total_freq": share("n_total"), "mask_freq": share("n_mask_target"), "pred_freq": share("n_mask_pred")})
    diff = (F.col("pred_freq") - F.col("mask_freq")) / (F.col("mask_freq") + EPS)
    return out.where("n_mask_target > 0").select(*by, "class_id", "total_freq", "mask_freq", diff.alias("mask_freq_diff"))


def class_scores(freq: DataFrame, scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """An image's score dealt to its classes by masked target pixels: class_id, value."""
    by = by or []
    both = freq.join(scores, "sample_id")
    n = F.col("n_mask_target")
    return both.groupBy(*by, "class_id").agg((F.sum(n * F.col("value")) / (F.sum(n) + EPS)).alias("value"))


def score_table(fake: DataFrame, real: DataFrame) -> DataFrame:
    """fake(mask_id, fake_id, real_id, fake_score), real(real_id, real_score) joined, with the mean and sample
    deviation of the fake scores of each real image. Of repeated (fake, real) pairs the smallest mask counts."""
    one = fake.groupBy("fake_id", "real_id").agg(F.min(F.struct("mask_id", "fake_score")).alias("m"))
    one = one.select(F.col("m.mask_id").alias("mask_id"), "fake_id", "real_id", F.col("m.fake_score").alias("fake_score"))
    per = Window.partitionBy("real_id")
    return one.join(real, "real_id", "left").withColumns(
        {"mean_fake_by_real": F.avg("fake_score").over(per), "std_fake_by_real": F.stddev_samp("fake_score").over(per)}
    )


def worst_best(scores: DataFrame) -> DataFrame:
    """score table -> a row per real image: its worst and best mask (ties: smaller id) and three differences."""
    low, high = F.struct("fake_score", "mask_id"), F.struct((-F.col("fake_score")).alias("s"), F.col("mask_id").alias("mask_id"))
    g = scores.groupBy("real_id").agg(F.min(low).alias("w"), F.min(high).alias("b"), F.min("real_score").alias("real_score"))
    worst, best = F.col("w.fake_score"), -F.col("b.s")
    return g.select(
        "real_id", "real_score", F.col("w.mask_id").alias("worst_mask"), worst.alias("worst_score"), F.col("b.mask_id").alias("best_mask"), best.alias("best_score"),
        (best - worst).alias("best_minus_worst"), (F.col("real_score") - best).alias("real_minus_best"), (F.col("real_score") - worst).alias("real_minus_worst"),
    )


#: Rankings of images: name and what is ordered.
RANKINGS = {
    "best_worst": "-best_minus_worst", "real_best": "-real_minus_best", "real_worst": "-real_minus_worst",
    "real_best_asc": "real_minus_best", "min_score": "worst_score", "max_score": "-best_score",
}


def rankings(table: DataFrame, n: int) -> DataFrame:
    """worst_best -> ranking, rank, real_id: the first n images of each of six orders, ties to the smaller id."""
    pairs = ", ".join(f"'{k}', {e}" for k, e in RANKINGS.items())
    long = table.select("real_id", F.expr(f"stack({len(RANKINGS)}, {pairs}) as (ranking, by)"))
    rank = F.row_number().over(Window.partitionBy("ranking").orderBy("by", "real_id"))
    return long.withColumn("rank", rank).where(F.col("rank") <= n).select("ranking", "rank", "real_id")


def extreme_scores(scores: DataFrame, n: int, worst: bool = True) -> DataFrame:
    """The n rows with the lowest (or highest) fake score, ties to the smaller mask id."""
    return scores.orderBy(F.col("fake_score") if worst else F.desc("fake_score"), "mask_id").limit(n)


def histogram(df: DataFrame, value: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Equal bins between the least and the largest value of each group, the last one closed: bin, lo, hi, n.

    Only bins with values have rows; a group with a single value has them all in bin 0 of width 0.
    """
    by = by or []
    ends = df.groupBy(*by).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    both = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi_") - F.col("lo_")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo_")) / width))).otherwise(0).cast("int")
    out = both.where(F.col(value).isNotNull()).groupBy(*by, "lo_", "hi_", at.alias("bin")).agg(F.count("*").alias("n"))
    return out.select(*by, "bin", (F.col("lo_") + F.col("bin") * width).alias("lo"), (F.col("lo_") + (F.col("bin") + 1) * width).alias("hi"), "n")


def run_summary(results: DataFrame) -> DataFrame:
    """(item, status, n_found, n_removed, seconds) -> one row of counters."""
    count = lambda s: F.count_if(F.col("status") == s)
    done = F.col("status") == "done"
    return results.agg(
        F.count("*").alias("total"), count("done").alias("done"), count("failed").alias("failed"), count("skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(done, F.col("n_found"))), F.lit(0)).alias("found"), F.coalesce(F.sum(F.when(done, F.col("n_removed"))), F.lit(0)).alias("removed"),
        F.avg(F.when(done, F.col("seconds"))).alias("mean_seconds"),
    )


def failed_items(results: DataFrame) -> DataFrame:
    """(item, status, ...) -> item of every run that failed."""
    return results.where(F.col("status") == "failed").select("item")


def mean_logs(logs: DataFrame) -> DataFrame:
    """(step, key, value) -> key, value: the sum over steps / (number of steps + EPS); absent keys count as 0."""
    steps = logs.agg(F.count_distinct("step").alias("n"))
    return logs.groupBy("key").agg(F.sum("value").alias("s")).crossJoin(F.broadcast(steps)).select("key", (F.col("s") / (F.col("n") + EPS)).alias("value"))


def best_checkpoint(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """rows(run, line, epoch, step, f1), runs(run) -> the first row of the largest positive f1 per run; zeros without one."""
    best = rows.where("f1 > 0").groupBy("run").agg(F.min(F.struct((-F.col("f1")).alias("f"), "line", "epoch", "step")).alias("m"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind))
    return runs.join(best, "run", "left").select("run", zero("m.epoch", "long").alias("epoch"), zero("m.step", "long").alias("step"), F.coalesce(-F.col("m.f"), F.lit(0.0)).alias("f1"))


def metric_rows(lines: DataFrame, ahead: int = 5) -> DataFrame:
    """lines(run, line, text): the metrics row stands ``ahead`` lines below its header line -> run, line, epoch, step, f1."""
    order = Window.partitionBy("run").orderBy("line")
    header = r"epoch (\d+) step (\d+)"
    with_next = lines.withColumn("below", F.lead("text", ahead).over(order)).where(F.rlike("text", F.lit(header)))
    number = lambda i: F.regexp_extract("text", header, i).cast("long")
    f1 = F.try_to_number(F.element_at(F.split(F.trim("below"), r"\s+"), -1), F.lit("9.999999")).cast("double")
    return with_next.select("run", "line", number(1).alias("epoch"), number(2).alias("step"), f1.alias("f1")).where("f1 is not null")


# -- distribution distance


#: Rows and columns of a tile of a matrix of products.
TILE = 128
#: Partials of a tile are added in so many heaps first.
HEAPS = 32
_TILE = "i long, j long, n long, sums array<double>, products array<double>"


def _tile_parts(acts: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """A row for each group, side, tile on or above the diagonal and partition, and the heap that it goes to."""

    def partial(batches):
        held: dict[tuple, list] = {}
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["embedding"].to_numpy()).astype(float)
            groups = b.groupby([*keys, "side"], dropna=False, sort=False).indices
            for key, at in groups.items():
                part = x[at]
                have = held.setdefault(key if isinstance(key, tuple) else (key,), [0, 0.0, 0.0])
                have[0] += len(part)
                have[1] = have[1] + part.sum(0)
                have[2] = have[2] + part.T @ part
        for k, (n, s, p) in held.items():
            for i in range(0, len(s), TILE):
                rows = [(*k, i // TILE, j // TILE, int(n), (s[i : i + TILE] if i == j else s[:0]).tolist(), p[i : i + TILE, j : j + TILE].ravel().tolist()) for j in range(i, len(s), TILE)]
                yield pd.DataFrame(rows, columns=[*keys, "side", "i", "j", "n", "sums", "products"])

    kinds = ", ".join([*(f"{c} {acts.schema[c].dataType.simpleString()}" for c in [*keys, "side"]), _TILE])
    parts = acts.select(*keys, "side", "embedding").mapInPandas(partial, kinds)
    return parts.withColumn("heap", (F.spark_partition_id() % HEAPS).cast("long")), kinds


def moment_tiles(acts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, embedding) -> keys, side, i, j, n, sums, products: Gram matrices in tiles of TILE x TILE numbers, i <= j.

    ``sums`` stands with the tiles of the diagonal. A task sends its tiles for every group that it saw (groups are few: bins,
    classes); they are added in heaps by partition and then the heaps, so a task holds a few tiles, whatever the dims and partitions are.
    """

    def add(group: pd.DataFrame) -> pd.DataFrame:
        out = group.iloc[:1].copy()
        out["n"] = int(group["n"].sum())
        for c in ("sums", "products"):
            out[c] = [np.sum(np.stack(group[c].to_numpy()), axis=0).tolist()]
        return out

    parts, kinds = _tile_parts(acts, keys)
    by = [*keys, "side", "i", "j"]
    return parts.groupBy(*by, "heap").applyInPandas(add, f"{kinds}, heap long").drop("heap").groupBy(*by).applyInPandas(add, kinds)


def assembled(tiles: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and the whole matrix of products of one side's tiles."""
    diagonal = tiles[tiles["i"] == tiles["j"]].sort_values("i")
    sums = np.concatenate([np.asarray(x, float) for x in diagonal["sums"]])
    out = np.empty((len(sums), len(sums)))
    for i, j, p in zip(tiles["i"] * TILE, tiles["j"] * TILE, tiles["products"], strict=True):
        block = np.asarray(p, float).reshape(min(TILE, len(sums) - i), -1)
        out[i : i + block.shape[0], j : j + block.shape[1]] = block
        out[j : j + block.shape[1], i : i + block.shape[0]] = block.T
    return int(tiles["n"].iloc[0]), sums, out


def _cov(n: int, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = s / n
    return mean, (p - n * np.outer(mean, mean)) / (n - 1)


#: Added to the diagonals of singular covariances.
EPS_COV = 1e-6
#: Rows whose changes are found at once.
LOO_ROWS = 1024
#: Step and reach of the integral over the logarithm of the shift, about that of the largest root.
LOO_STEP, LOO_REACH = 0.3, 32.0


def frechet_distance(m1, c1, m2, c2, eps: float = EPS_COV) -> float:
    """|m1 - m2|^2 + Tr(c1 + c2 - 2 sqrt(c1 c2)); eps goes on the diagonals where c1 is singular."""
    values, vectors = np.linalg.eigh(c1)
    if values.min() <= 0:
        c1, c2 = c1 + eps * np.eye(len(c1)), c2 + eps * np.eye(len(c2))
        values, vectors = np.linalg.eigh(c1)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ c2 @ root), 0)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross)


def frechet(acts: DataFrame, grp: str | None = None) -> DataFrame:
    """(side pred/target, embedding, optional group) -> grp, value; NaN for a group with fewer than two of a side."""
    keyed = acts.withColumn("grp_", F.col(grp).cast("string") if grp else F.lit("all")).select(F.col("grp_").alias("grp"), "side", "embedding")

    def finish(g: pd.DataFrame) -> pd.DataFrame:
        sides = {side: assembled(tiles) for side, tiles in g.groupby("side")}
        value = float("nan")
        if {"pred", "target"} <= set(sides) and min(n for n, _, _ in sides.values()) > 1:
            value = frechet_distance(*_cov(*sides["pred"]), *_cov(*sides["target"]))
        return pd.DataFrame({"grp": [g["grp"].iloc[0]], "value": [value]})

    out = moment_tiles(keyed, ["grp"]).groupBy("grp").applyInPandas(finish, "grp string, value double")
    return out.select("grp", F.coalesce("value", F.lit(float("nan"))).alias("value"))  # Arrow sends NaN as null


class _Replaced:
    """What a replaced prediction changes in the distance, from the eigenvalues of the whole sets.

    With the target's root R, the distance needs the sum of the roots of the eigenvalues of R C R. Replacing a row adds v d' + d v' to C, d being
    the target less the prediction. Its secular determinant at a shift s is that of two rows and columns, and a sum of roots is the integral
    of log(s + eigenvalue) / sqrt(s) / 2 pi; so the change of the sum is the integral of the logarithm of that determinant. In log(s) it is smooth
    and falls off exponentially on both sides, so equal steps give it to almost the last digit, with a few products of matrices for many rows.
    """

    def __init__(self, pred: tuple[int, np.ndarray, np.ndarray], target: tuple[int, np.ndarray, np.ndarray]):
        self.n, sums, _ = pred
        self.mean, cov = _cov(*pred)
        self.target_mean, other = _cov(*target)
        extra = EPS_COV * np.eye(len(sums)) if np.linalg.eigvalsh(cov).min() <= 0 else 0.0
        values, vectors = np.linalg.eigh(other + extra)
        root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
        values, vectors = np.linalg.eigh(root @ (cov + extra) @ root)
        values = np.maximum(values, 0)
        self.basis = root @ vectors / np.sqrt(self.n - 1)
        width = np.sqrt(max(values.max(), np.finfo(float).tiny))
        y = np.arange(-LOO_REACH, LOO_REACH, LOO_STEP)
        self.weights = LOO_STEP * width * np.exp(y) / np.pi
        self.inverse = 1 / (values[:, None] + (width * np.exp(y)) ** 2)

    def deltas(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        d = t - p
        v = p - self.mean + (1 - 1 / self.n) / 2 * d
        mean = self.mean + d / self.n
        squares = ((mean - self.target_mean) ** 2).sum(1) - ((self.mean - self.target_mean) ** 2).sum()
        trace = 2 * (v * d).sum(1) / (self.n - 1)
        a, b = v @ self.basis, d @ self.basis
        aa, ab, bb = ((x * y) @ self.inverse for x, y in ((a, a), (a, b), (b, b)))
        return squares + trace - 2 * np.log1p(np.maximum(2 * ab + ab * ab - aa * bb, -1 + 1e-300)) @ self.weights


def frechet_loo(acts: DataFrame) -> DataFrame:
    """(pair_id, side, embedding) -> pair_id, delta: the distance's change if a pair's prediction were its target.

    The eigenvalues of the whole sets are taken once, and they and their basis (dims squared numbers) are broadcast; a pair costs a few
    times dims. A singular covariance of all predictions gets EPS_COV on both diagonals. NaN with fewer than two rows of a side.
    """
    tiles = moment_tiles(acts.select("side", "embedding"), []).toPandas()  # dims squared numbers
    m = {side: assembled(own) for side, own in tiles.groupby("side")}
    if not {"pred", "target"} <= set(m) or min(n for n, _, _ in m.values()) < 2:
        return acts.select("pair_id", F.lit(float("nan")).alias("delta")).distinct()
    held = acts.sparkSession.sparkContext.broadcast(_Replaced(m["pred"], m["target"]))
    pairs = acts.where("side = 'pred'").select("pair_id", F.col("embedding").alias("p")).join(acts.where("side = 'target'").select("pair_id", F.col("embedding").alias("t")), "pair_id")

    def run(batches):
        for b in batches:
            for start in range(0, len(b), LOO_ROWS):
                some = b.iloc[start : start + LOO_ROWS]
                p, t = (np.stack(some[c].to_numpy()).astype(float) for c in ("p", "t"))
                yield pd.DataFrame({"pair_id": some["pair_id"], "delta": held.value.deltas(p, t)})

    return pairs.mapInPandas(run, "pair_id long, delta double")


#: Newton steps at most, and shares of a step that are tried together.
STEPS, SHARES = 50, 0.5 ** np.arange(12)


def _summed(parts: DataFrame, kinds: str) -> list[np.ndarray]:
    """The sums of rows of arrays, added in heaps by partition first, so that the driver gets one row."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({c: [np.sum(np.stack(rows[c].to_numpy()), axis=0)] for c in rows.columns if c != "heap"})

    heaps = parts.withColumn("heap", F.spark_partition_id() % HEAPS).groupBy("heap").applyInPandas(add, kinds)
    rows = heaps.groupBy().applyInPandas(add, kinds).collect()
    return [np.asarray(x, float) for x in rows[0]] if rows else []


def _signed_rows(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a 1 behind them, and +1 for targets, -1 for predictions."""
    x = np.stack(b["embedding"].to_numpy()).astype(float)
    return np.c_[x, np.ones(len(x))], np.where(b["side"] == "target", 1.0, -1.0)


def fit_separator(data: DataFrame, cost: float = 1.0) -> np.ndarray:
    """(side, embedding) -> weights and, last, the intercept that minimise |w|^2 / 2 + cost * sum of max(0, 1 - sign * score)^2, the intercept counted in.

    Newton steps from zero. A pass sums gradients and Hessians (dims squared numbers a task), another tries shares of the step all at once; the
    function is convex and made of quadratic pieces, so a few steps end at its minimum, whatever the partitions are. Empty: no weights.
    """
    width = data.select(F.size("embedding")).first()
    if width is None:
        return np.empty(0)
    w = np.zeros(width[0] + 1)

    def slopes(w):
        def run(batches):
            g, h, loss = np.zeros(len(w)), np.zeros((len(w), len(w))), 0.0
            for b in batches:
                if len(b):
                    x, y = _signed_rows(b)
                    short = np.maximum(0, 1 - y * (x @ w))
                    near = x[short > 0]
                    g -= 2 * cost * (x.T @ (y * short))
                    h += 2 * cost * (near.T @ near)
                    loss += cost * (short @ short)
            yield pd.DataFrame({"g": [g], "h": [h.ravel()], "loss": [[loss]]})

        kinds = "g array<double>, h array<double>, loss array<double>"
        g, h, loss = _summed(data.mapInPandas(run, kinds), kinds)
        return g + w, h.reshape(len(w), -1) + np.eye(len(w)), float(loss[0]) + w @ w / 2

    def losses(points):
        def run(batches):
            sums = np.zeros(len(points))
            for b in batches:
                if len(b):
                    x, y = _signed_rows(b)
                    sums += cost * (np.maximum(0, 1 - y[:, None] * (x @ points.T)) ** 2).sum(0)
            yield pd.DataFrame({"loss": [sums]})

        return _summed(data.mapInPandas(run, "loss array<double>"), "loss array<double>")[0] + (points**2).sum(1) / 2

    for _ in range(STEPS):
        g, h, loss = slopes(w)
        step = -np.linalg.solve(h, g)
        if -(g @ step) <= 1e-14 * (1 + loss):
            break
        points = w + SHARES[:, None] * step
        enough = losses(points) <= loss + 1e-4 * SHARES * (g @ step)
        if not enough.any():
            break
        w = points[int(np.argmax(enough))]
    return w


def separability(acts: DataFrame) -> DataFrame:
    """Decision scores of a linear support-vector machine with squared hinge that tells targets (above 0) from predictions: pair_id, side, score.

    The rows are written once, as the fit reads them again and again. Empty table: no rows.
    """
    with tables(acts.sparkSession) as save:
        data = save(acts.select("pair_id", "side", "embedding"), keep=True)
        w = fit_separator(data)

    def score(batches):
        for b in batches:
            if len(b):
                yield b[["pair_id", "side"]].assign(score=_signed_rows(b)[0] @ w)

    return data.mapInPandas(score, f"pair_id {acts.schema['pair_id'].dataType.simpleString()}, side string, score double")
