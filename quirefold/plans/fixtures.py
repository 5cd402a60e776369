"""Inputs of the registered queries, derived from the driver's tables.

The same SQL text runs on Spark and, as a common table expression, on the oracle; where the two
dialects differ a pair (spark, oracle) is given. All of them grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quirefold.session import table

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

_LINE_ORDER = "l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate"
#: On Spark lines are numbered before anything is computed from them, so that only the table's columns move and all views of them share that shuffle.
_NUMBERED = f"(select l_orderkey, {_LINE_ORDER}, row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as rn from lineitem)"
#: The columns that place a line's box; the others of _LINE_ORDER only order lines that agree in these.
_PLACE = "l_linenumber,l_partkey,l_suppkey,l_quantity"
_BUCKET = "(xxhash64(l_orderkey) & 1048575)"

VIEWS: dict[str, str | tuple[str, str]] = {
    "boxes": (
        f"""
select l_orderkey*100 + rn as box_id, cast(floor(l_orderkey/4) as bigint) as page_id, cast(x1 as double) as left_x, cast(y1 as double) as top_y,
  cast(x1+w as double) as right_x, cast(y1+h as double) as bottom_y, conf, cls
from (select l_orderkey, rn, (l_partkey*7) % 600 as x1, (l_suppkey*97 + l_linenumber*131) % 1800 as y1, cast(40 + l_quantity*4 as bigint) as w, cast(30 + l_quantity*3 as bigint) as h,
    round(l_discount*10,1) as conf, l_linestatus, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as cls from {_NUMBERED}) r
where l_linestatus = 'O'""",
        f"""
select l_orderkey*100 + rn as box_id, cast(floor(l_orderkey/4) as bigint) as page_id, cast(x1 as double) as left_x, cast(y1 as double) as top_y,
  cast(x1+w as double) as right_x, cast(y1+h as double) as bottom_y, conf, cls
from (select l_orderkey, row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as rn,
    (l_partkey*7) % 600 as x1, (l_suppkey*97 + l_linenumber*131) % 1800 as y1, cast(40 + l_quantity*4 as bigint) as w, cast(30 + l_quantity*3 as bigint) as h,
    round(l_discount*10,1) as conf, l_linestatus, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as cls from lineitem) r
where l_linestatus = 'O'""",
    ),
    "tokens": (
        f"""
select l_orderkey*100 + rn as tok_id, cast(floor(l_orderkey/4) as bigint) as page_id, cast(x1 as double) as left_x, cast(y1 as double) as top_y,
  cast(x1+w as double) as right_x, cast(y1+h as double) as bottom_y, conf, concat(l_returnflag, cast(l_partkey as varchar(20))) as txt
from (select l_orderkey, l_returnflag, l_partkey, rn,
    (l_partkey*11) % 640 as x1, (l_suppkey*83 + l_linenumber*57) % 1800 as y1, cast(10 + l_quantity as bigint) as w, cast(8 + floor(l_quantity/4) as bigint) as h,
    round(l_tax*10,1) as conf, l_linestatus from {_NUMBERED}) r
where l_linestatus = 'F'""",
        f"""
select l_orderkey*100 + rn as tok_id, cast(floor(l_orderkey/4) as bigint) as page_id, cast(x1 as double) as left_x, cast(y1 as double) as top_y,
  cast(x1+w as double) as right_x, cast(y1+h as double) as bottom_y, conf, concat(l_returnflag, cast(l_partkey as varchar(20))) as txt
from (select l_orderkey, l_returnflag, l_partkey, row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as rn,
    (l_partkey*11) % 640 as x1, (l_suppkey*83 + l_linenumber*57) % 1800 as y1, cast(10 + l_quantity as bigint) as w, cast(8 + floor(l_quantity/4) as bigint) as h,
    round(l_tax*10,1) as conf, l_linestatus from lineitem) r
where l_linestatus = 'F'""",
    ),
    # boxes without conf and cls, for Spark alone. Lines of one place that are all boxes, or all none, may be numbered in any order, so only columns of the place move;
    # orders that have other such lines are numbered as in boxes, with those that share their bucket
    "outlines": f"""
with n as (select /*+ repartition(l_orderkey) */ l_orderkey,{_PLACE}, coalesce(l_linestatus = 'O', false) as is_box from lineitem),
  t as (select distinct {_BUCKET} as bucket from (select l_orderkey from n group by l_orderkey,{_PLACE} having bool_or(is_box) and not bool_and(is_box)) g),
  r as (
    select /*+ broadcast(t) */ l_orderkey,{_PLACE}, rn from (select *, row_number() over (partition by l_orderkey order by {_PLACE}) as rn from n) a left anti join t on {_BUCKET} = bucket and rn > 0 where is_box
    union all
    select l_orderkey,{_PLACE}, rn from (select l_orderkey,{_LINE_ORDER}, row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as rn from
      (select /*+ broadcast(t) */ l_orderkey,{_LINE_ORDER} from lineitem left semi join t on {_BUCKET} = bucket) b) c where l_linestatus = 'O')
select l_orderkey*100 + rn as box_id, cast(x1 as double) as left_x, cast(y1 as double) as top_y, cast(x1+w as double) as right_x, cast(y1+h as double) as bottom_y
from (select l_orderkey, rn, (l_partkey*7) % 600 as x1, (l_suppkey*97 + l_linenumber*131) % 1800 as y1, cast(40 + l_quantity*4 as bigint) as w, cast(30 + l_quantity*3 as bigint) as h from r) p""",
    "page_dim": "select distinct cast(floor(o_orderkey/4) as bigint) as page_id, 900 as width, 2100 as height from orders",
    # eight vectors, stacked, are a page of 64 rows and 8 columns
    "pixels": (
        "select cast(floor(vec_id/8) as bigint) as page_id, cast((vec_id % 8)*8 + floor(i/8) as bigint) as y, cast(i % 8 as bigint) as x, cast(floor((cast(e as double) + 1)*1000) as bigint) % 256 as v from (select vec_id, posexplode(embedding) as (i, e) from embeddings) q",
        "select cast(floor(vec_id/8) as bigint) as page_id, cast((vec_id % 8)*8 + floor(i/8) as bigint) as y, cast(i % 8 as bigint) as x, cast(floor((cast(e as double) + 1)*1000) as bigint) % 256 as v from (select vec_id, unnest(embedding) as e, unnest(range(0, len(embedding))) as i from embeddings) q",
    ),
    "eval_samples": """
select o_orderkey as sample_id, o_custkey as image_id, 256 + (o_custkey % 4)*128 as h, 256 + (o_custkey % 3)*128 as w,
  ((o_orderkey*37) % 1001)/1000.0e0 as hole_frac, 1.0e0 - ((o_orderkey*53) % 997)/2000.0e0 as ssim, ((o_orderkey*71) % 991)/1000.0e0 as lpips,
  ((o_orderkey*89) % 983)/100.0e0 - 5.0e0 as fake_score, ((o_custkey*97) % 977)/100.0e0 - 5.0e0 as real_score
from orders""",
    "class_freq": """
select l_orderkey as sample_id, l_partkey % 150 as class_id, sum(cast(l_quantity as bigint))*4 as n_total, sum(cast(l_quantity as bigint)) as n_mask_target,
  sum(cast(l_quantity as bigint) + l_suppkey % 5 - 2) as n_mask_pred
from lineitem group by l_orderkey, l_partkey % 150""",
    # the lines that class_freq adds up, for operators that add up themselves
    "class_lines": "select l_orderkey as sample_id, l_partkey % 150 as class_id, cast(l_quantity as bigint)*4 as n_px from lineitem",
    "activations": "select cast(floor(vec_id/2) as bigint) as pair_id, case when vec_id % 2 = 0 then 'pred' else 'target' end as side, label as grp, embedding from embeddings",
    "script_lines": """
select conv_id as page_id, turn as line_no,
  concat(case role when 'system' then '##' when 'assistant' then '//' else concat('S', cast(turn % 3 as varchar(4)), ':') end, text) as raw_text
from conversations""",
    "progress_events": """
select event_id, ts, user_id as job_id,
  case event_type when 'view' then 'detect_bubbles' when 'click' then 'ocr_text' when 'signup' then 'bubble_class' when 'purchase' then 'inpaint' else 'error' end as phase,
  cast(floor(value) as bigint) as done, cast(500 as bigint) as total
from events""",
    "scalars": """
select user_id as run_id, event_id as step, ts as wall_time, value,
  concat(case event_type when 'view' then 'train_' when 'click' then 'val_' when 'signup' then 'test_' when 'purchase' then 'extra_val_a256_' else 'misc_' end,
    case event_id % 3 when 0 then 'ssim_mean' when 1 then 'ssim_std' else 'fid_mean' end) as tag
from events""",
    "manifest": """
select concat(case o_custkey % 3 when 0 then 'ch' when 1 then 'chapter' else 'ch_' end, cast(o_custkey as varchar(20))) as folder,
  concat(cast(o_orderkey as varchar(20)), case o_orderkey % 5 when 0 then '_cleaned' when 1 then '_original' when 2 then '' when 3 then 'frame_1' else '' end,
    case o_orderkey % 7 when 0 then '.jpg' else '.png' end) as file_name, o_totalprice as n_bytes
from orders""",
    # union-of-rectangles masks, one to three rectangles per order
    "mask_rects": (
        f"""
select l_orderkey as mask_id, cast(floor(l_orderkey/4) as bigint) as image_id, rn, (l_suppkey*7 + rn*11) % 96 as y0, (l_suppkey*7 + rn*11) % 96 + 4 + cast(l_quantity as bigint) % 24 as y1,
  (l_partkey*5 + rn*13) % 96 as x0, (l_partkey*5 + rn*13) % 96 + 4 + cast(l_quantity as bigint) % 28 as x1
from {_NUMBERED} r""",
        f"""
select l_orderkey as mask_id, cast(floor(l_orderkey/4) as bigint) as image_id, rn, (l_suppkey*7 + rn*11) % 96 as y0, (l_suppkey*7 + rn*11) % 96 + 4 + cast(l_quantity as bigint) % 24 as y1,
  (l_partkey*5 + rn*13) % 96 as x0, (l_partkey*5 + rn*13) % 96 + 4 + cast(l_quantity as bigint) % 28 as x1
from (select l_orderkey, l_suppkey, l_partkey, l_quantity, row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as rn from lineitem) r""",
    ),
    "images": "select distinct o_custkey as image_id, 256 + (o_custkey % 4)*128 as h, 256 + (o_custkey % 3)*128 as w from orders",
    "listing": """
select concat('root/', case o_orderkey % 4 when 0 then 'img' when 1 then 'mask' else 'pred' end, '/', cast(o_custkey as varchar(20)), '_crop', cast(o_orderkey % 3 as varchar(4)),
  case o_orderkey % 4 when 0 then '' when 1 then '_mask000' else '_mask000_inpainted' end, case o_orderkey % 4 when 1 then '.png' when 0 then '.png' else '.jpg' end) as path
from orders""",
    "bubbles": """
select box_id as bubble_id, page_id, left_x, top_y, right_x, bottom_y, conf, cls,
  case when box_id % 5 = 0 then 'bbox_fallback' else 'seg' end as source, (box_id % 37)/100.0e0 as cov, cast(box_id % 6 as bigint) as line_count,
  cast(8 + box_id % 40 as double) as font_est_px, cast(box_id % 11 as bigint) as n_words,
  case box_id % 7 when 0 then 'rectangle' when 1 then 'thorn' when 2 then 'cloude' when 3 then 'sea_uchirin' when 4 then 'elipse' else 'other' end as cls_name
from boxes""",
}
#: Views that are built on other views.
NEEDS = {"bubbles": ("boxes",)}


def _used(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
    needed = [*NEEDS.get(name, ()), *[t for t in TABLES if re.search(rf"\bfrom {t}\b", sql)]]
    for n in needed:
        sql = re.sub(rf"\bfrom {n}\b", f"from {{{n}}}", sql)
    return spark.sql(sql, **{n: frame(spark, sf_dir, n) for n in needed})


def oracle(sql: str) -> str:
    """sql with the views that it uses before it."""
    wanted, todo = [], _used(sql, VIEWS)
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.append(n)
            todo += NEEDS.get(n, ())
    views = [f"{n} as ({VIEWS[n] if isinstance(VIEWS[n], str) else VIEWS[n][1]})" for n in VIEWS if n in wanted]
    body = sql.strip()
    recursive = body.lower().startswith("with recursive")
    if body.lower().startswith("with "):
        body = re.sub(r"(?i)^with (recursive )?", "", body)
        return f"with {'recursive ' * recursive}{', '.join([*views, ''])}{body}"
    return f"with {', '.join(views)} {body}" if views else body
