"""Queries on evaluation metrics and score comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import bins as B
from quirefold.operators import metrics as M

from .registry import query

EDGES = B.bin_edges(10)


def bin_sql(c: str, side: str) -> str:
    op = ">=" if side == "right" else ">"
    return "case " + " ".join(f"when {c} {op} {EDGES[i]!r}::double then {i}" for i in range(9, 0, -1)) + " else 0 end"


LABEL = "(b * 10)::varchar || '-' || (b * 10 + 10)::varchar || '%'"
LONG = f"""with s as (select {bin_sql('hole_frac', 'right')} as b, ssim, lpips, fake_score from eval_samples),
  l as (select 'ssim' as score, b, ssim as value from s union all select 'lpips', b, lpips from s union all select 'fake_score', b, fake_score from s)"""


@query("a8_evaluate", f"{LONG} select score, case when grouping(b) = 0 then {LABEL} end as grp, avg(value) as mean, stddev_pop(value) as std, count(value) as n from l group by grouping sets ((score), (score, b))")
def evaluate(v):
    return M.evaluate(v.eval_samples, ["ssim", "lpips", "fake_score"])


@query("st3_online_bins", f"""with s as (select {bin_sql('hole_frac', 'left')} as b, ssim from eval_samples)
    select 'ssim' as score, case when grouping(b) = 0 then {LABEL} end as grp, avg(ssim) as mean, stddev_pop(ssim) as std, count(ssim) as n from s group by grouping sets ((), (b))""")
def _(v):
    return M.evaluate(v.eval_samples, ["ssim"], rule="left")


@query("f10_bins", f"select sample_id, {bin_sql('hole_frac', 'right')} as right_bin, {bin_sql('hole_frac', 'left')} as left_bin, {LABEL.replace('b *', '(' + bin_sql('hole_frac', 'right') + ') *')} as label from eval_samples")
def _(v):
    r = B.bin_index(F.col("hole_frac"))
    return v.eval_samples.select("sample_id", r.alias("right_bin"), B.bin_index(F.col("hole_frac"), side="left").alias("left_bin"), B.bin_label(r).alias("label"))


@query("a14_composite_f1", f"""with s as (select {bin_sql('hole_frac', 'right')} as b, avg(ssim) as sim, avg(lpips) * 100 as fid, 1 - avg(lpips) as sim2 from eval_samples group by 1),
    c as (select *, greatest(0.0, 100.0 - fid) / 100.0 as cl from s)
    select b as grp, 2 * sim * cl / (sim + cl + 1e-3::double) as ssim_f1, 2 * sim2 * cl / (sim2 + cl + 1e-3::double) as lpips_f1 from c""")
def _(v):
    g = v.eval_samples.groupBy(B.bin_index(F.col("hole_frac")).alias("grp")).agg(F.avg("ssim").alias("sim"), F.avg("lpips").alias("lp"))
    return g.select("grp", M.composite_f1(F.col("sim"), F.col("lp") * 100).alias("ssim_f1"), M.composite_f1(1 - F.col("lp"), F.col("lp") * 100).alias("lpips_f1"))


CLASS = """with s as (select class_id, sum(n_total) as t, sum(n_mask_target) as m, sum(n_mask_pred) as p from class_freq group by 1),
  f as (select class_id, m as raw, t / sum(t) over () as total_freq, m / sum(m) over () as mask_freq, p / sum(p) over () as pred_freq from s)"""


@query("a12_class_stats", f"{CLASS} select class_id, total_freq, mask_freq, (pred_freq - mask_freq) / (mask_freq + 1e-3::double) as mask_freq_diff from f where raw > 0")
def _(v):
    return M.class_stats(v.class_freq)


@query("a12_class_stats_by_bin", f"""with e as (select sample_id, {bin_sql('hole_frac', 'right')} as grp from eval_samples),
    s as (select grp, class_id, sum(n_total) as t, sum(n_mask_target) as m, sum(n_mask_pred) as p from class_freq join e using (sample_id) group by 1, 2),
    f as (select grp, class_id, m as raw, t / sum(t) over (partition by grp) as total_freq, m / sum(m) over (partition by grp) as mask_freq, p / sum(p) over (partition by grp) as pred_freq from s)
    select grp, class_id, total_freq, mask_freq, (pred_freq - mask_freq) / (mask_freq + 1e-3::double) as mask_freq_diff from f where raw > 0""")
def _(v):
    bins = v.eval_samples.select("sample_id", B.bin_index(F.col("hole_frac")).alias("grp"))
    return M.class_stats(v.class_freq.join(bins, "sample_id"), ["grp"])


@query("a13_class_scores", "select class_id, sum(n_mask_target * ssim) / (sum(n_mask_target) + 1e-3::double) as value from class_freq join eval_samples using (sample_id) group by 1")
def class_scores(v):
    return M.class_scores(v.class_freq, v.eval_samples.select("sample_id", F.col("ssim").alias("value")))


@query("t4_class_report", f"{CLASS} select class_id, mask_freq, row_number() over (order by mask_freq desc, class_id)::int as pos from f where raw > 0")
def _(v):
    from pyspark.sql import Window

    # one row per class
    return M.class_stats(v.class_freq).select("class_id", "mask_freq", F.row_number().over(Window.orderBy(F.desc("mask_freq"), "class_id")).alias("pos"))


def _scores(v):
    fake = v.eval_samples.select(F.col("sample_id").alias("mask_id"), F.floor(F.col("sample_id") / 3).alias("fake_id"), F.col("image_id").alias("real_id"), "fake_score")
    real = v.eval_samples.select(F.col("image_id").alias("real_id"), "real_score").distinct()
    return M.score_table(fake, real)


SCORES = """with o as (select sample_id as mask_id, floor(sample_id / 3)::bigint as fake_id, image_id as real_id, fake_score, real_score, row_number() over (partition by floor(sample_id / 3), image_id order by sample_id) as rn from eval_samples),
  sc as (select mask_id, fake_id, real_id, fake_score, real_score, avg(fake_score) over (partition by real_id) as mean_fake_by_real, stddev_samp(fake_score) over (partition by real_id) as std_fake_by_real from o where rn = 1)"""
WB = f"""{SCORES}, wb as (select real_id, min(real_score) as real_score, arg_min(mask_id, (fake_score, mask_id)) as worst_mask, min(fake_score) as worst_score, arg_min(mask_id, (-fake_score, mask_id)) as best_mask, max(fake_score) as best_score from sc group by 1),
  d as (select *, best_score - worst_score as best_minus_worst, real_score - best_score as real_minus_best, real_score - worst_score as real_minus_worst from wb)"""


@query("j14_a15_score_table", f"{SCORES} select * from sc")
def _(v):
    return _scores(v)


@query("a16_worst_best", f"{WB} select * from d")
def _(v):
    return M.worst_best(_scores(v))


@query("t1_worst_scores", f"{SCORES} select mask_id, fake_score from sc order by fake_score, mask_id limit 50")
def _(v):
    return M.extreme_scores(_scores(v), 50).select("mask_id", "fake_score")


@query("t1_best_scores", f"{SCORES} select mask_id, fake_score from sc order by fake_score desc, mask_id limit 50")
def _(v):
    return M.extreme_scores(_scores(v), 50, worst=False).select("mask_id", "fake_score")


@query("t2_rankings", f"""{WB}, u as (select 'best_worst' as ranking, real_id, -best_minus_worst as k from d union all select 'real_best', real_id, -real_minus_best from d union all select 'real_worst', real_id, -real_minus_worst from d
    union all select 'real_best_asc', real_id, real_minus_best from d union all select 'min_score', real_id, worst_score from d union all select 'max_score', real_id, -best_score from d),
    n as (select ranking, (row_number() over (partition by ranking order by k, real_id))::int as rank, real_id from u) select * from n where rank <= 20""")
def _(v):
    return M.rankings(M.worst_best(_scores(v)), 20)


HIST = "least(9, floor((fake_score - lo_) / bw))"


@query("a17_histogram", f"""with e as (select min(fake_score) as lo_, (max(fake_score) - min(fake_score)) / 10 as bw from eval_samples)
    select {HIST}::int as bin, lo_ + {HIST} * bw as lo, lo_ + ({HIST} + 1) * bw as hi, count(*) as n from eval_samples, e group by lo_, bw, {HIST}""")
def _(v):
    return M.histogram(v.eval_samples, "fake_score")


@query("a17_histogram_by_image", """with e as (select image_id, min(fake_score) as lo_, (max(fake_score) - min(fake_score)) / 10 as bw from eval_samples group by 1),
    x as (select image_id, lo_, bw, case when bw > 0 then least(9, floor((fake_score - lo_) / bw)) else 0 end::int as bin from eval_samples join e using (image_id))
    select image_id, bin, lo_ + bin * bw as lo, lo_ + (bin + 1) * bw as hi, count(*) as n from x group by image_id, bin, lo_, bw""")
def _(v):
    return M.histogram(v.eval_samples, "fake_score", by=["image_id"])


RESULTS = "select o_orderkey as item, case o_orderkey % 7 when 0 then 'failed' when 1 then 'skipped' else 'done' end as status, o_orderkey % 13 as n_found, o_orderkey % 5 as n_removed, (o_orderkey % 97) / 10.0e0 as seconds from orders"


def _results(v):
    return v.spark.sql(RESULTS.replace("from orders", "from {orders}"), orders=v.orders)


@query("a18_run_summary", f"""with r as ({RESULTS}) select count(*) as total, count(*) filter (status = 'done') as done, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'skipped') as skipped,
    sum(n_found) filter (status = 'done')::bigint as found, sum(n_removed) filter (status = 'done')::bigint as removed, avg(seconds) filter (status = 'done') as mean_seconds from r""")
def _(v):
    return M.run_summary(_results(v))


@query("a18_failed_items", f"with r as ({RESULTS}) select item from r where status = 'failed'")
def _(v):
    return M.failed_items(_results(v))


@query("a26_progress_pct", "select event_id, case when total > 0 then least(100, greatest(0, round_even(100.0::double * done / total, 0)))::int else 0 end as pct from progress_events")
def _(v):
    return v.progress_events.select("event_id", B.percent(F.col("done"), F.col("total")).alias("pct"))


@query("a27_mean_logs", "select tag as key, sum(value) / ((select count(distinct step) from scalars) + 1e-3::double) as value from scalars group by 1")
def _(v):
    return M.mean_logs(v.scalars.select("step", F.col("tag").alias("key"), "value"))


@query("a28_best_checkpoint", """with r as (select o_custkey as run, o_orderkey as line, o_orderkey % 40 as epoch, o_orderkey * 10 as step, ((o_orderkey * 31) % 101) / 101.0e0 - 0.5 as f1 from orders), k as (select c_custkey as run from customer),
    b as (select *, row_number() over (partition by run order by f1 desc, line) as rn from r where f1 > 0)
    select k.run, coalesce(epoch, 0)::bigint as epoch, coalesce(step, 0)::bigint as step, coalesce(f1, 0.0)::double as f1 from k left join b on k.run = b.run and rn = 1""")
def _(v):
    rows = v.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("line"), (F.col("o_orderkey") % 40).alias("epoch"), (F.col("o_orderkey") * 10).alias("step"), ((F.col("o_orderkey") * 31) % 101 / 101.0 - 0.5).alias("f1"))
    return M.best_checkpoint(rows, v.customer.select(F.col("c_custkey").alias("run")))


@query("a10_moments", """with a as (select side, unnest(embedding)::double as x, unnest(range(0, len(embedding)))::int as i, pair_id from activations),
    n as (select side, count(*)::bigint as n from activations group by 1)
    select side, n, i, sum(x) as total, sum(x * x) as squares from a join n using (side) group by side, n, i""")
def _(v):
    m = M.moment_tiles(v.activations.select("side", "embedding"), []).where("i = j")
    d = F.size("sums")
    m = m.select("side", "n", F.posexplode("sums").alias("k", "total"), "products", d.alias("d"), "i")
    return m.select("side", "n", (F.col("i") * M.TILE + F.col("k")).cast("int").alias("i"), "total", F.get("products", F.col("k") * F.col("d") + F.col("k")).alias("squares"))


def _times(a: str, b: str) -> str:
    """The product of two matrices, lists of rows."""
    return f"list_transform({a}, lambda r: list_transform(range(1, len({b}) + 1), lambda c: list_dot_product(r, list_transform({b}, lambda q: q[c]))))"


#: With the root of the covariances' product from a Newton-Schulz iteration, which needs no eigenvalues.
FRECHET = f"""with recursive x as (select side, pair_id, unnest(embedding)::double as v, unnest(range(1, len(embedding) + 1)) as i from activations),
    n as (select side, count(*)::double as n from activations group by 1), m as (select side, i, avg(v) as m from x group by 1, 2),
    c as (select a.side, a.i, b.i as j, (sum(a.v * b.v) - any_value(n) * any_value(p.m) * any_value(q.m)) / (any_value(n) - 1) as v
      from x a join x b using (side, pair_id) join n using (side) join m p on p.side = a.side and p.i = a.i join m q on q.side = a.side and q.i = b.i group by 1, 2, 3),
    w as (select side, i, list(v order by j) as r from c group by 1, 2), k as (select side, list(r order by i) as k from w group by 1),
    a as (select {_times('p.k', 't.k')} as a from k p, k t where p.side = 'pred' and t.side = 'target'),
    s as (select a, sqrt(list_sum(list_transform(a, lambda r: list_dot_product(r, r)))) as s from a),
    ns as (select 0 as i, list_transform(a, lambda r: list_transform(r, lambda x: x / s)) as y, list_transform(range(1, len(a) + 1), lambda p: list_transform(range(1, len(a) + 1), lambda q: case when p = q then 1.0::double else 0.0 end)) as z, s from s
      union all select i + 1, {_times('y', 't')}, {_times('t', 'z')}, s
      from (select *, list_transform(zy, lambda r, p: list_transform(r, lambda x, q: (case when p = q then 3.0::double else 0.0 end - x) / 2)) as t from (select *, {_times('z', 'y')} as zy from ns where i < 40) q) q),
    tr as (select sqrt(s) * list_sum(list_transform(range(1, len(y) + 1), lambda p: y[p][p])) as cross_ from ns where i = 40)
    select 'all' as grp, round((select sum((p.m - t.m) * (p.m - t.m)) from m p join m t on p.i = t.i and p.side = 'pred' and t.side = 'target') + (select sum(v) from c where i = j) - 2 * cross_, 6) as value from tr"""


@query("a10_frechet", FRECHET)
def _(v):
    return M.frechet(v.activations).withColumn("value", F.round("value", 6))


@query("a10_frechet_by_group")
def _(v):
    return M.frechet(v.activations, "grp")


@query("a11_frechet_loo")
def _(v):
    return M.frechet_loo(v.activations)


@query("a29_separability")
def _(v):
    return M.separability(v.activations)


@query("j18_compare_models", """with a as (select sample_id, ssim as value from eval_samples), b as (select sample_id, lpips as value from eval_samples), c as (select sample_id, fake_score as value from eval_samples)
    select sample_id, a.value as model_a, b.value as model_b, c.value as model_c from a join b using (sample_id) join c using (sample_id)""")
def _(v):
    from quirefold.operators.evalset import compare_models

    s = v.eval_samples
    return compare_models({"model_a": s.select("sample_id", F.col("ssim").alias("value")), "model_b": s.select("sample_id", F.col("lpips").alias("value")), "model_c": s.select("sample_id", F.col("fake_score").alias("value"))})


@query("f11_ramps", """select sample_id, case when sample_id < 100 then 0.25 when sample_id >= 9000 then 2.0 else 0.25 * (1 - (sample_id - 100) / 8900.0::double) + 2.0 * ((sample_id - 100) / 8900.0::double) end::double as linear,
    case when sample_id < 500 then 1.0 when sample_id < 4000 then 3.0 else 9.0 end::double as ladder from eval_samples""")
def _(v):
    i = F.col("sample_id")
    return v.eval_samples.select("sample_id", B.linear_ramp(i, 0.25, 2.0, 100, 9000).alias("linear"), B.ladder_ramp(i, [500, 4000], [1, 3, 9]).alias("ladder"))
