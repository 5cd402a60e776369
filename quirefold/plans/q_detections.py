"""Queries on detections, token assignment and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.operators import detections as D

from .registry import query

BOX = "left_x, top_y, right_x, bottom_y"


@query("p1_chunk_plan", "select page_id, (y / 640)::bigint as chunk_no, greatest(0, y - 96)::bigint as chunk_top, least(height, y + 640 + 96)::bigint as chunk_bottom from page_dim, unnest(range(0, height, 640)) as u(y)")
def _(v):
    return D.chunk_plan(v.page_dim, 640, 96)


@query(
    "p2_p3_lift_boxes",
    """with l as (select box_id, page_id, left_x, top_y - 40 as ty, right_x, bottom_y - 40 as by_, conf, cls, 500 + box_id % 3 * 600 as chunk_top from boxes),
    m as (select box_id, page_id, conf, cls, least(greatest(left_x, 0), width - 1.0) as left_x, least(greatest(ty + chunk_top, 0), height - 1.0) as top_y,
      least(greatest(right_x, 0), width - 1.0) as right_x, least(greatest(by_ + chunk_top, 0), height - 1.0) as bottom_y
      from l join page_dim using (page_id) where right_x - left_x >= 20 and by_ - ty >= 45)
    select box_id, page_id, conf, cls, left_x::double as left_x, top_y::double as top_y, right_x::double as right_x, bottom_y::double as bottom_y from m where right_x > left_x and bottom_y > top_y""",
)
def _(v):
    local = v.boxes.withColumns({"top_y": F.col("top_y") - 40, "bottom_y": F.col("bottom_y") - 40, "chunk_top": 500 + F.col("box_id") % 3 * 600})
    return D.lift_boxes(local, v.page_dim, 20, 45)


@query("p4_filter_conf", "select box_id, conf from boxes where conf >= 0.5")
def _(v):
    return D.filter_conf(v.boxes, 0.5).select("box_id", "conf")


@query("p7_relaxed_conf", "select tok_id, conf from tokens where conf >= greatest(0.0, 0.35::double - 0.10::double)")
def _(v):
    return D.filter_conf(v.tokens, 0.35, 0.10).select("tok_id", "conf")


@query(
    "p5_poly_rect",
    "select box_id, left_x, top_y, right_x, bottom_y + 3 as bottom_y, (left_x + right_x) / 2 as cx, greatest(1.0, bottom_y + 3 - top_y) as h from boxes",
)
def _(v):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    b = G.Box.of()
    poly = F.array(pt(b.left, b.top), pt(b.right, b.top), pt(b.right, b.bottom + 3), pt(b.left, b.bottom))
    r = G.poly_rect(poly)
    return v.boxes.select("box_id", *r.named(), ((r.left + r.right) / 2).alias("cx"), F.greatest(G.lit(1), r.height).alias("h"))


@query(
    "p6_clip_box",
    """with c as (select box_id, width, height, greatest(0, least(floor(left_x + 0.3), width - 1))::bigint as x0, greatest(0, least(floor(top_y - 0.4), height - 1))::bigint as y0, ceil(right_x + 0.2) as x1, ceil(bottom_y) as y1,
      greatest(0, least(trunc(left_x - 2), width - 1))::bigint as px0, greatest(0, least(trunc(top_y - 2), height - 1))::bigint as py0, trunc(right_x + 2) as px1, trunc(bottom_y + 2) as py1 from boxes join page_dim using (page_id))
    select box_id, x0, y0, greatest(x0 + 1, least(x1, width))::bigint as x1, greatest(y0 + 1, least(y1, height))::bigint as y1,
      px0, py0, greatest(px0 + 1, least(px1, width))::bigint as px1, greatest(py0 + 1, least(py1, height))::bigint as py1 from c""",
)
def _(v):
    b = G.Box.of()
    moved = G.Box(b.left + 0.3, b.top - 0.4, b.right + 0.2, b.bottom)
    df = v.boxes.join(v.page_dim, "page_id")
    a, p = G.clip_box(moved, F.col("width"), F.col("height")), G.clip_box(b, F.col("width"), F.col("height"), "padded")
    return df.select("box_id", *[c.alias(n) for c, n in zip((*a, *p), ("x0", "y0", "x1", "y1", "px0", "py0", "px1", "py1"), strict=True)])


@query(
    "p8_decide",
    """with t as (select tok_id, conf, tok_id % 3 = 0 as upgraded, tok_id % 4 <> 0 as inside from tokens),
    r as (select tok_id, case when conf < (case when upgraded then 0.3 else 0.2 end) then 'below_threshold' when not inside then 'outside_bubble' else 'ok' end as reason from t)
    select tok_id, reason = 'ok' as accepted, reason from r""",
)
def _(v):
    t = v.tokens.select("tok_id", "conf", (F.col("tok_id") % 3 == 0).alias("upgraded"), (F.col("tok_id") % 4 != 0).alias("inside"))
    return D.decide(t, 0.2, 0.3)


@query(
    "p10_box_algebra",
    """with s as (select *, (left_x + right_x) / 2 as cx, (top_y + bottom_y) / 2 as cy, greatest(1.0, right_x - left_x) * 1.2 as w, greatest(1.0, bottom_y - top_y) * 1.2 as h from boxes),
    e as (select *, cx - w / 2 as ex0, cy - h / 2 as ey0, cx + w / 2 as ex1, cy + h / 2 as ey1 from s),
    c as (select *, greatest(ex0, 50.0) as c0, greatest(ey0, 100.0) as c1, least(ex1, 500.0) as c2, least(ey1, 900.0) as c3 from e),
    k as (select *, c2 > c0 and c3 > c1 as ok from c),
    i as (select *, least(7.5, greatest(0.0, (right_x - left_x - 2) / 2)) as dx, least(900.0, greatest(0.0, (bottom_y - top_y - 2) / 2)) as dy from k)
    select box_id, ex0, ey0, ex1, ey1, (case when ok then c0 else 50 end)::double as kx0, (case when ok then c1 else 100 end)::double as ky0, (case when ok then c2 else 500 end)::double as kx1, (case when ok then c3 else 900 end)::double as ky1,
      left_x * (1 - 0.3::double) + ex0 * 0.3::double as bx0, bottom_y * (1 - 0.3::double) + ey1 * 0.3::double as by1, left_x + dx as ix0, top_y + dy as iy0, right_x - dx as ix1, bottom_y - dy as iy1 from i""",
)
def _(v):
    b = G.Box.of()
    e = G.scale_box(b, 1.2)
    k = G.clamp_box(e, G.Box(G.lit(50), G.lit(100), G.lit(500), G.lit(900)))
    m = G.blend_box(b, e, G.lit(0.3))
    i = G.inset_box(b, G.lit(7.5), G.lit(900))
    named = zip((*e, *k, m.left, m.bottom, *i), ("ex0", "ey0", "ex1", "ey1", "kx0", "ky0", "kx1", "ky1", "bx0", "by1", "ix0", "iy0", "ix1", "iy1"), strict=True)
    return v.boxes.select("box_id", *[c.alias(n) for c, n in named])


@query(
    "p17_poly_rel",
    """select box_id, least(greatest(left_x - 100, 0), 300.0)::double as x0, least(greatest(top_y - 200, 0), 400.0)::double as y0, least(greatest(right_x - 100, 0), 300.0)::double as x1, least(greatest(bottom_y - 200, 0), 400.0)::double as y1 from boxes""",
)
def _(v):
    b = G.Box.of()
    poly = F.array(F.struct(b.left.alias("x"), b.top.alias("y")), F.struct(b.right.alias("x"), b.bottom.alias("y")))
    r = G.poly_rel(poly, G.lit(100), G.lit(200), G.lit(300), G.lit(400))
    return v.boxes.select("box_id", r[0]["x"].alias("x0"), r[0]["y"].alias("y0"), r[1]["x"].alias("x1"), r[1]["y"].alias("y1"))


def _oval() -> str:
    k = repr(G.QUARTER) + "::double"
    arcs = [
        ("cx", "top_y", f"cx + hw * {k}", "top_y", "right_x", f"cy - hh * {k}", "right_x", "cy"), ("right_x", "cy", "right_x", f"cy + hh * {k}", f"cx + hw * {k}", "bottom_y", "cx", "bottom_y"),
        ("cx", "bottom_y", f"cx - hw * {k}", "bottom_y", "left_x", f"cy + hh * {k}", "left_x", "cy"), ("left_x", "cy", "left_x", f"cy - hh * {k}", f"cx - hw * {k}", "top_y", "cx", "top_y"),
    ]
    curve = lambda a, c, d, e: f"u * u * u * ({a}) + 3 * u * u * t * ({c}) + 3 * u * t * t * ({d}) + t * t * t * ({e})"
    parts = [f"select box_id, {12 * i} + s as i, {curve(*a[::2])} as x, {curve(*a[1::2])} as y from b" for i, a in enumerate(arcs)]
    return f"""with m as (select *, (left_x + right_x) / 2 as cx, (top_y + bottom_y) / 2 as cy, (right_x - left_x) / 2 as hw, (bottom_y - top_y) / 2 as hh from boxes), b as (select *, s / 12.0::double as t, 1 - s / 12.0::double as u from m, unnest(range(0, 12)) as v(s))
      {" union all ".join(parts)}"""


@query("p16_oval_poly", _oval())
def _(v):
    # numbered first, so that points are rows of plain columns and no arrays are built and taken apart
    # boxes of one width and place lie together in a task, so that their equal x, and y where outlines repeat, take little room in files: there are 48 points a box
    boxes = v.outlines.sortWithinPartitions("left_x", "right_x", "top_y", "bottom_y")
    points = boxes.select("box_id", *G.Box.of(), F.explode(F.sequence(F.lit(0), F.lit(47))).alias("i"))
    return points.select("box_id", "i", G.oval_point(G.Box.of(), F.col("i")).alias("p")).select("box_id", "i", "p.x", "p.y")


@query(
    "f1_iou_guards",
    """with p as (select a.box_id as a_id, b.box_id as b_id, greatest(0.0, least(a.right_x, b.right_x) - greatest(a.left_x, b.left_x)) as w, greatest(0.0, least(a.bottom_y, b.bottom_y) - greatest(a.top_y, b.top_y)) as h,
      (a.right_x - a.left_x) * (a.bottom_y - a.top_y) as aa, (b.right_x - b.left_x) * (b.bottom_y - b.top_y) as ba
      from boxes a join boxes b on a.page_id = b.page_id and a.box_id < b.box_id)
    select a_id, b_id, w * h / greatest(1e-9, aa + ba - w * h) as nms, w * h / (greatest(1e-6, aa) + greatest(1e-6, ba) - w * h) as match_, case when w > 0 and h > 0 then w * h / (aa + ba - w * h) else 0 end as merge_ from p where w * h > 0""",
)
def _(v):
    a = v.boxes.select("page_id", *[F.col(c).alias(f"a_{c}") for c in ("box_id", "left_x", "top_y", "right_x", "bottom_y")])
    b = v.boxes.select("page_id", *[F.col(c).alias(f"b_{c}") for c in ("box_id", "left_x", "top_y", "right_x", "bottom_y")])
    both = D.overlap_join(a, b, (F.col("a_top_y"), F.col("a_bottom_y")), (F.col("b_top_y"), F.col("b_bottom_y")), ["page_id"]).where("a_box_id < b_box_id")
    x, y = G.Box.of("a_"), G.Box.of("b_")
    out = both.select(F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), *[G.iou(x, y, g).alias(n) for g, n in (("nms", "nms"), ("match", "match_"), ("merge", "merge_"))])
    return out.where("nms > 0")


@query(
    "j1_slice_boxes",
    """with s as (select page_id, (y / 700)::bigint as slice_no, y as top, least(height, y + 700) as bottom from page_dim, unnest(range(0, height, 700)) as u(y))
    select s.page_id, slice_no, box_id, left_x as "left", greatest(top_y, top) - top as rel_top, right_x as "right", least(bottom_y, bottom) - top as rel_bottom
    from s join boxes b on s.page_id = b.page_id and bottom_y > top and top_y < bottom""",
)
def _(v):
    plan = D.chunk_plan(v.page_dim, 700, 0).select("page_id", F.col("chunk_no").alias("slice_no"), F.col("chunk_top").alias("top"), F.col("chunk_bottom").alias("bottom"))
    return D.slice_boxes(plan, v.boxes)


ASSIGN = """with bub as (select * from boxes where conf >= 0.5), c as (
      select t.tok_id, b.box_id, (t.left_x + t.right_x) / 2 between b.left_x and b.right_x and (t.top_y + t.bottom_y) / 2 between b.top_y and b.bottom_y as inside,
        greatest(0.0, least(t.right_x, b.right_x) - greatest(t.left_x, b.left_x)) * greatest(0.0, least(t.bottom_y, b.bottom_y) - greatest(t.top_y, b.top_y)) as common,
        greatest(1.0, (b.right_x - b.left_x) * (b.bottom_y - b.top_y)) as area
      from tokens t join bub b on t.page_id = b.page_id),
    r as (select *, row_number() over (partition by tok_id order by not inside, case when inside then 0 else -common end, area, box_id) as rn from c where inside or common > 0),
    assigned as (select tok_id, box_id, case when inside then 'inside' else 'overlap' end as how from r where rn = 1)"""


@query("j2_j3_assign_tokens", f"{ASSIGN} select * from assigned")
def assign(v):
    return D.assign_tokens(v.tokens, D.filter_conf(v.boxes, 0.5))


@query(
    "j4_centre_inside",
    """select t.tok_id, exists (select 1 from boxes b where b.page_id = t.page_id and (t.left_x * 2 + t.right_x) / 3 between b.left_x and b.right_x and (t.top_y * 2 + t.bottom_y) / 3 between b.top_y and b.bottom_y) as inside from tokens t""",
)
def _(v):
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    poly = F.array(pt("left_x", "top_y"), pt("right_x", "top_y"), pt("left_x", "bottom_y"))
    cx, cy = G.poly_centre(poly)
    return D.centre_inside(v.tokens.select("page_id", "tok_id", cx.alias("cx"), cy.alias("cy")), v.boxes)


@query(
    "j5_match_geometry",
    """with s as (select box_id as seg_id, page_id, left_x + 9 as sl, top_y - 7 as st, right_x + 4 as sr, bottom_y + 12 as sb from boxes where box_id % 3 <> 0),
    p as (select box_id, seg_id, greatest(0.0, least(right_x, sr) - greatest(left_x, sl)) * greatest(0.0, least(bottom_y, sb) - greatest(top_y, st)) as common,
      greatest(1e-6, (right_x - left_x) * (bottom_y - top_y)) as a, greatest(1e-6, (sr - sl) * (sb - st)) as b from boxes join s using (page_id)),
    m as (select box_id, seg_id, common / (a + b - common) as iou, row_number() over (partition by box_id order by common / (a + b - common) desc, seg_id) as rn from p where common > 0)
    select b.box_id, case when coalesce(iou, 0) >= 0.30 then seg_id end as seg_id, coalesce(iou, 0.0)::double as best_iou, case when coalesce(iou, 0) >= 0.30 then 'segmentation' else 'bbox_fallback' end as source
    from boxes b left join m on b.box_id = m.box_id and rn = 1""",
)
def _(v):
    moved = {"left_x": F.col("left_x") + 9, "top_y": F.col("top_y") - 7, "right_x": F.col("right_x") + 4, "bottom_y": F.col("bottom_y") + 12}
    return D.match_geometry(v.boxes, v.boxes.where("box_id % 3 <> 0").withColumns(moved).withColumnRenamed("box_id", "seg_id"))


def _two_passes(v):
    t = v.tokens.withColumnRenamed("txt", "text")
    second = t.withColumns({"left_x": F.col("left_x") + 2, "right_x": F.col("right_x") + 3, "conf": (F.col("tok_id") * 7 % 10) / 10.0})
    return t, second


_MET = "greatest(0.0, least(e.x1, z.x1) - greatest(e.x0, z.x0)) * greatest(0.0, least(e.y1, z.y1) - greatest(e.y0, z.y0))"
_IOU = f"case when {_MET} > 0 then {_MET} / ((e.x1 - e.x0) * (e.y1 - e.y0) + (z.x1 - z.x0) * (z.y1 - z.y0) - {_MET}) else 0.0 end"


@query(
    "j6_merge_passes",
    f"""with recursive s as (select page_id, row_number() over (partition by page_id order by tok_id) as i, left_x + 2 as x0, top_y as y0, right_x + 3 as x1, bottom_y as y1, txt, (tok_id * 7 % 10) / 10.0::double as conf from tokens),
    st as (select page_id, 0::bigint as i, list({{'id': tok_id, 'x0': left_x, 'y0': top_y, 'x1': right_x, 'y1': bottom_y, 'txt': txt, 'conf': conf, 'up': false}} order by tok_id) as ps from tokens group by 1 union all
      select page_id, i, case when p > 0 and conf > ps[p].conf then list_concat(list_append(ps[1:p - 1], {{'id': ps[p].id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'txt': txt, 'conf': conf, 'up': true}}), ps[p + 1:]) else ps end
      from (select *, case when list_max(d) > 0.5 then list_position(d, list_max(d)) else 0 end as p from (select z.*, ps, list_transform(ps, lambda e: {_IOU}) as d from st join s z on z.page_id = st.page_id and z.i = st.i + 1) q1) q2),
    l as (select page_id, unnest(arg_max(ps, i)) as e from st group by 1)
    select e.id as tok_id, page_id, e.x0 as left_x, e.y0 as top_y, e.x1 as right_x, e.y1 as bottom_y, e.txt as text, e.conf as conf, e.up as upgraded from l""",
)
def _(v):
    return D.merge_passes(*_two_passes(v))


@query(
    "j6_upgrade_pairs",
    """with p as (select *, (right_x - left_x) * (bottom_y - top_y) as a from tokens), s as (select tok_id, page_id, left_x + 2 as left_x, top_y, right_x + 3 as right_x, bottom_y, (tok_id * 7 % 10) / 10.0::double as conf, (right_x + 1 - left_x) * (bottom_y - top_y) as a from tokens),
    j as (select p.tok_id as p_id, s.tok_id as s_id, p.conf as pc, s.conf as sc, p.a + s.a as total, least(p.right_x, s.right_x) - greatest(p.left_x, s.left_x) as w, least(p.bottom_y, s.bottom_y) - greatest(p.top_y, s.top_y) as h from p join s using (page_id))
    select p_id, s_id, w * h / (total - w * h) as iou, sc > pc as better from j where w > 0 and h > 0 and w * h / (total - w * h) > 0.5""",
)
def _(v):
    return D.upgrade_pairs(*_two_passes(v))


@query(
    "j7_iou_pairs",
    """with p as (select a.box_id as a_id, b.box_id as b_id, a.page_id, greatest(0.0, least(a.right_x, b.right_x) - greatest(a.left_x, b.left_x)) * greatest(0.0, least(a.bottom_y, b.bottom_y) - greatest(a.top_y, b.top_y)) as common,
      (a.right_x - a.left_x) * (a.bottom_y - a.top_y) + (b.right_x - b.left_x) * (b.bottom_y - b.top_y) as total from boxes a join boxes b on a.page_id = b.page_id and a.box_id < b.box_id)
    select a_id, b_id, page_id, common / greatest(1e-9, total - common) as iou from p where common / greatest(1e-9, total - common) >= 0.2""",
)
def iou_pairs(v):
    return D.iou_pairs(v.boxes, 0.2)


@query(
    "j7_nms",
    """with recursive o as (select *, row_number() over (partition by page_id order by conf desc, box_id) as i from boxes),
    p as (select a.box_id as w, b.box_id as l, greatest(0.0, least(a.right_x, b.right_x) - greatest(a.left_x, b.left_x)) * greatest(0.0, least(a.bottom_y, b.bottom_y) - greatest(a.top_y, b.top_y)) as common,
      (a.right_x - a.left_x) * (a.bottom_y - a.top_y) + (b.right_x - b.left_x) * (b.bottom_y - b.top_y) as total from o a join o b on a.page_id = b.page_id and a.i < b.i),
    ab as (select l as box_id, list(w) as above from p where common / greatest(1e-9, total - common) >= 0.2 group by 1), oa as (select o.*, coalesce(above, []::bigint[]) as above from o left join ab using (box_id)),
    st as (select page_id, i, box_id, conf, true as ok, [box_id] as kept from oa where i = 1 union all
      select page_id, i, box_id, conf, ok, case when ok then list_append(kept, box_id) else kept end from (select z.page_id, z.i, z.box_id, z.conf, kept, not list_has_any(kept, above) as ok from st join oa z on z.page_id = st.page_id and z.i = st.i + 1) q)
    select box_id, page_id, conf from st where ok""",
)
def _(v):
    return D.nms(v.boxes, 0.2).select("box_id", "page_id", "conf")


@query(
    "j8_pick_box",
    """with p as (select tok_id as pt_id, page_id, left_x as px, top_y as py from tokens),
    r as (select pt_id, box_id, px between left_x and right_x and py between top_y and bottom_y as inside, conf, (right_x - left_x) * (bottom_y - top_y) as area,
      (px - (left_x + right_x) / 2) * (px - (left_x + right_x) / 2) + (py - (top_y + bottom_y) / 2) * (py - (top_y + bottom_y) / 2) as d from p join boxes using (page_id)),
    n as (select *, row_number() over (partition by pt_id order by not inside, case when inside then area else d end, -conf, box_id) as rn from r)
    select pt_id, box_id, inside from n where rn = 1""",
)
def _(v):
    return D.pick_box(v.tokens.select(F.col("tok_id").alias("pt_id"), "page_id", F.col("left_x").alias("px"), F.col("top_y").alias("py")), v.boxes)


RECONCILE = """with e as (select distinct o_custkey as doc_id, o_orderkey as id from orders where o_orderkey % 5 <> 0), r as (select distinct o_custkey as doc_id, o_orderkey as id from orders where o_orderkey % 7 <> 0),
    m as (select * from e except select * from r), x as (select * from r except select * from e), d as (select doc_id from e union select doc_id from r)"""


@query(
    "j10_reconcile",
    f"""{RECONCILE} select doc_id, coalesce((select string_agg(id::varchar, ',' order by id) from m where m.doc_id = d.doc_id), '') as missing, coalesce((select string_agg(id::varchar, ',' order by id) from x where x.doc_id = d.doc_id), '') as extra,
      not exists (select 1 from m where m.doc_id = d.doc_id) and not exists (select 1 from x where x.doc_id = d.doc_id) as ok from d""",
)
def _(v):
    ids = v.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"))
    out = D.reconcile(ids.where("id % 5 <> 0"), ids.where("id % 7 <> 0"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("doc_id", text("missing"), text("extra"), "ok")


@query("u4_missing_ids", f"{RECONCILE} select * from m")
def _(v):
    ids = v.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"))
    return ids.where("id % 5 <> 0").exceptAll(ids.where("id % 7 <> 0")).distinct()


@query("u1_union_boxes", "select page_id, box_id as id, left_x, top_y, conf, 'objects' as reader from boxes union all select page_id, tok_id, left_x, top_y, conf, 'text' from tokens")
def _(v):
    return D.union_boxes(
        objects=v.boxes.select("page_id", F.col("box_id").alias("id"), "left_x", "top_y", "conf"),
        text=v.tokens.select("page_id", F.col("tok_id").alias("id"), "left_x", "top_y", "conf"),
    )


@query("u2_language_passes", "select tok_id, txt, conf, 'fr' as reader from tokens where tok_id % 2 = 0 union all select tok_id, txt, conf, 'de' from tokens where tok_id % 3 = 0")
def _(v):
    passes = {"fr": (v.tokens.where("tok_id % 2 = 0"), "ok"), "de": (v.tokens.where("tok_id % 3 = 0"), "ok"), "es": (v.tokens, "failed")}
    return D.union_boxes(**{k: df.select("tok_id", "txt", "conf") for k, (df, status) in passes.items() if status == "ok"})
