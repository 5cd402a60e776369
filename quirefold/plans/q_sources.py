"""Queries on sources, artifacts, reports and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quirefold.operators import metrics as M
from quirefold.operators import scoring as S
from quirefold.sources import artifacts as A
from quirefold.sources import files as R

from .q_metrics import LABEL, LONG
from .registry import query


def _tidy(v):
    return v.bubbles.select(
        F.col("page_id").cast("string").alias("job_id"), F.col("bubble_id").cast("string").alias("bubble_id"), F.col("cls_name").alias("class"), F.col("cls").cast("int").alias("class_id"),
        F.col("conf").alias("confidence"), (F.col("conf") >= 0.6).alias("definite"),
    )


@query("src8_artifact_round_trip", "select page_id::varchar as job_id, bubble_id::varchar as bubble_id, cls_name as class, cls::int as class_id, conf as confidence, conf >= 0.6 as definite from bubbles")
def _(v):
    docs = A.artifact_documents(_tidy(v), "bubble_classes")
    text = docs.select("job_id", F.to_json("classes").alias("j"))
    back = text.select("job_id", F.explode(F.from_json("j", f"map<string,{A.ARTIFACTS['bubble_classes'][1]}>")).alias("bubble_id", "v"))
    return back.select("job_id", "bubble_id", "v.*")


@query("f17_normalise_ocr", """select tok_id, 'a' as part, txt as text, conf from tokens union all select tok_id, 'b', txt, conf from tokens""")
def _(v):
    t = v.tokens
    poly = F.array(F.array("left_x", "top_y"), F.array("right_x", "bottom_y"))
    one = t.select("tok_id", F.lit("a").alias("part"), F.to_json(F.array(F.struct(poly.alias("poly"), F.col("txt").alias("text"), F.col("conf").alias("prob")))).alias("j"))
    two = t.select("tok_id", F.lit("b").alias("part"), F.to_json(F.struct(F.array(poly).alias("dt_polys"), F.array("txt").alias("rec_texts"), F.array("conf").alias("rec_scores"))).alias("j"))
    rows = one.unionByName(two).select("tok_id", "part", F.explode(A.normalise_ocr(F.col("j"))).alias("o"))
    return rows.select("tok_id", "part", "o.text", "o.conf")


@query("src11_report", f"""{LONG}, g as (select score, case when grouping(b) = 0 then {LABEL} else 'total' end as grp, avg(value) as mean, stddev_pop(value) as std from l group by grouping sets ((score), (score, b))),
    st as (select score, grp, 'mean' as stat, mean as value from g union all select score, grp, 'std', std from g) select score, stat, {', '.join(f"round(max(value) filter (grp = '{c}'), 4) as \"{c}\"" for c in ['total', *[f'{i * 10}-{i * 10 + 10}%' for i in range(10)]])} from st group by 1, 2""")
def _(v):
    e = M.evaluate(v.eval_samples, ["ssim", "lpips", "fake_score"])
    return R.report_table(e.selectExpr("score", "grp", "stack(2, 'mean', mean, 'std', std) as (stat, value)"))


@query("src12_w16_metric_rows", """select o_custkey as run, o_orderkey * 10 as line, o_orderkey % 40 as epoch, o_orderkey as step, ((o_orderkey * 31) % 1000) / 1000.0e0 as f1 from orders""")
def _(v):
    header = F.format_string("epoch %d step %d", F.col("o_orderkey") % 40, "o_orderkey")
    row = F.concat(F.lit("| 0.1 "), F.format_string("%.3f", (F.col("o_orderkey") * 31) % 1000 / 1000.0))
    lines = F.array(header, *[F.lit("--")] * 4, row)
    t = v.orders.select(F.col("o_custkey").alias("run"), "o_orderkey", F.posexplode(lines).alias("k", "text")).select("run", (F.col("o_orderkey") * 10 + F.col("k")).alias("line"), "text")
    return M.metric_rows(t)


@query("src14_class_dimension", "select n_nationkey as label_index, n_name as name, n_nationkey + 1 as idx, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey group by all")
def _(v):
    dim = v.nation.select((F.col("n_nationkey") + 1).alias("idx"), F.col("n_name").alias("name")).withColumn("label_index", F.col("idx") - 1)
    n = v.customer.groupBy(F.col("c_nationkey").alias("label_index")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(dim), "label_index", "right").select("label_index", "name", "idx", F.coalesce("n", F.lit(0)).alias("n"))  # one row per nation


@query("x1_x2_score", "select tok_id, length(txt)::bigint as n, case when tok_id % 1000 = 7 then 'ValueError: bad token' end as error from tokens where tok_id % 1000 <> 7 union all select tok_id, null, 'ValueError: bad token' from tokens where tok_id % 1000 = 7")
def _(v):
    def load():
        def predict(b: pd.DataFrame) -> pd.DataFrame:
            if (b["tok_id"] % 1000 == 7).any():
                raise ValueError("bad token")
            return pd.DataFrame({"n": b["txt"].str.len()})

        return predict

    return S.score(v.tokens.select("tok_id", "txt"), load, "n long").drop("txt")


@query("x1_retry_ladder", "select tok_id, case when conf >= 0.5 then txt when conf >= 0.2 then lower(txt) end as text, case when conf >= 0.5 then 0 when conf >= 0.2 then 1 end::int as attempt from tokens")
def _(v):
    first = lambda df: df.select("tok_id", F.when(F.col("conf") >= 0.5, F.col("txt")).alias("text"))
    second = lambda df: df.select("tok_id", F.when(F.col("conf") >= 0.2, F.lower("txt")).alias("text"))
    return S.retry_ladder(v.tokens, "tok_id", [first, second], "text")


@query("x3_x4_metric_registry", "select image_id, avg(ssim) as mean_ssim, max(lpips) as worst_lpips, sum(hole_frac) as hole_share from eval_samples group by 1")
def _(v):
    return S.run_metrics(v.eval_samples, ["mean_ssim", "worst_lpips", "hole_share"], ["image_id"])


@query("x6_run_chapters", "select folder, case when min(length(file_name)) < 6 then 'failed' else 'done' end as status, case when min(length(file_name)) < 6 then 0 else count(*) end as n, case when min(length(file_name)) < 6 then 'ValueError: short name' end as error from manifest group by 1")
def _(v):
    def work(rows: pd.DataFrame) -> int:
        if (rows["file_name"].str.len() < 6).any():
            raise ValueError("short name")
        return len(rows)

    return S.run_chapters(v.manifest.select("folder", "file_name"), work)
