"""Queries on page rows: costs, cuts, slices, reading order, bubble text, pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.operators import detections as D
from quirefold.operators import ordering as O
from quirefold.operators import pixels as P
from quirefold.operators import slicing as S

from .q_detections import ASSIGN
from .registry import query
from .sql import first_fit

FEATURES = """with s as (select page_id, y, x, v, coalesce(abs(v - lag(v) over (partition by page_id, x order by y)), 0) as step from pixels),
  feat as (select page_id, y, sum(v) / count(*)::double as mean, (count(*) * sum(v * v) - sum(v) * sum(v))::double / (count(*) * count(*)) as var, sum(step) / count(*)::double as grad from s group by 1, 2),
  f as (select *, mean / 255.0::double / (1.0 + var) as white from feat)"""
FORBIDDEN = """fb as (select page_id, y, exists (select 1 from boxes b where b.page_id = r.page_id and r.y >= greatest(0, trunc(b.top_y / 40) - 1) and r.y < trunc(b.bottom_y / 40) + 1) as forbidden from (select distinct page_id, y from pixels) r)"""
SCALED = "case when max({0}) over w - min({0}) over w < 1e-6 then 0.0 else ({0} - min({0}) over w) / (max({0}) over w - min({0}) over w) end"
COST = f"""{FEATURES}, {FORBIDDEN}, cost as (select page_id, y, 0.5 * {SCALED.format('var')} + 0.5 * {SCALED.format('grad')} - 2.0 * {SCALED.format('white')} as cost, not forbidden as safe from f join fb using (page_id, y) window w as (partition by page_id))"""


def _forbidden(v):
    rows = v.pixels.select("page_id", "y").distinct()
    small = v.boxes.withColumns({"top_y": F.col("top_y") / 40, "bottom_y": F.col("bottom_y") / 40})
    return S.forbidden_rows(rows, small, 1)


def _cost(v):
    return S.row_cost(S.row_features(v.pixels), _forbidden(v))


@query("a1_w1_row_features", f"{FEATURES} select * from f")
def _(v):
    return S.row_features(v.pixels)


@query("j9_forbidden_rows", f"with {FORBIDDEN} select * from fb")
def _(v):
    return _forbidden(v)


@query("a2_w2_row_cost", f"{COST} select * from cost")
def _(v):
    return _cost(v)


@query("w11_best_cut", f"""{COST}, h as (select page_id, max(y) + 1 as height from cost group by 1),
    r as (select page_id, y, row_number() over (partition by page_id order by not safe, case when safe then cost + 0.001 * abs(y - 20) end, y) as rn from cost join h using (page_id) where y >= 12 and y < least(28, height))
    select h.page_id, coalesce(r.y, least(12, height))::bigint as y from h left join r on h.page_id = r.page_id and rn = 1""")
def _(v):
    c = _cost(v)
    return S.best_cut(c, c.select("page_id").distinct().withColumn("cur", F.lit(0)), 12, 28, 0.001)


def cuts_sql(tail: str) -> str:
    last = "case when n - y < 8 then n else y end" if tail == "absorb" else "least(y, n - 1)"
    return f"""{COST.replace("with s as", "with recursive s as", 1)}, h as (select page_id, max(y) + 1 as n from cost group by 1),
      best as (select page_id, 0::bigint as k, 0::bigint as cur, n from h union all
        select page_id, k + 1, {last}, n from (select b.page_id, b.k, b.n, b.cur, coalesce((min({{'v': cost + 0.001 * abs(y - b.cur - 14), 'y': y}}) filter (safe)).y, b.cur + 8) as y
          from best b join cost c on c.page_id = b.page_id and c.y >= b.cur + 8 and c.y < least(b.cur + 20, b.n) where b.n - b.cur > 20 group by b.page_id, b.k, b.n, b.cur) q)
      select page_id, k as slice_no, cur as top, coalesce(lead(cur) over (partition by page_id order by k), n) as bottom from best where cur < n"""


@query("w12_cuts_absorb", cuts_sql("absorb"))
def cuts(v):
    return S.cuts(_cost(v), 8, 20, 0.001)


@query("w12_cuts_clamp", cuts_sql("clamp"))
def _(v):
    return S.cuts(_cost(v), 8, 20, 0.001, "clamp")


SLICES = "sl as (select page_id, k as slice_no, k * 9 as top, least(k * 9 + 9, h) as bottom from (select page_id, max(y) + 1 as h from pixels group by 1), unnest(range(0, (h + 8) // 9)) as u(k))"


def _slices(v):
    h = v.pixels.groupBy("page_id").agg((F.max("y") + 1).alias("height"))
    return D.chunk_plan(h, 9, 0).select("page_id", F.col("chunk_no").alias("slice_no"), F.col("chunk_top").alias("top"), F.col("chunk_bottom").alias("bottom"))


ROWS = "pr as (select page_id, y, sum(v * (x + 1))::bigint as v from pixels group by 1, 2)"


def _rows(v):
    return v.pixels.groupBy("page_id", "y").agg(F.sum(F.col("v") * (F.col("x") + 1)).alias("v"))


@query("src17_slice_rows", f"with {SLICES}, {ROWS} select page_id, slice_no, pr.y, y - top as y_local, v from pr join sl using (page_id) where y >= top and y < bottom")
def _(v):
    return S.slice_rows(_rows(v), _slices(v))


def _done(v):
    d = S.slice_rows(_rows(v), _slices(v)).where("(page_id + slice_no) % 4 <> 0 and not (slice_no = 1 and y_local = 8)")
    return d.select("page_id", "slice_no", "y_local", (F.col("v") + 1000).alias("v"))


@query("src18_merge_slices", f"""with {SLICES}, {ROWS} select page_id, y, case when (page_id + slice_no) % 4 <> 0 and not (slice_no = 1 and y - top = 8) then v + 1000 else v end as v,
    not ((page_id + slice_no) % 4 <> 0 and not (slice_no = 1 and y - top = 8)) as from_original from pr join sl using (page_id) where y >= top and y < bottom""")
def _(v):
    return S.merge_slices(_done(v), _slices(v), _rows(v))


@query("src18_check_heights", f"""with {SLICES}, {ROWS}, d as (select page_id, slice_no, max(y - top) + 1 as rows from pr join sl using (page_id) where y >= top and y < bottom and (page_id + slice_no) % 4 <> 0 and not (slice_no = 1 and y - top = 8) group by 1, 2),
    n as (select page_id, slice_no, bottom - top as expected, coalesce(rows, 0) as actual from sl left join d using (page_id, slice_no)) select *, actual = expected as ok from n""")
def _(v):
    return S.check_heights(_done(v), _slices(v))


CENTRES = """c as (select page_id, box_id, top_y as top, left_x as "left", greatest(0.0, bottom_y - top_y) as h, left_x + greatest(0.0, right_x - left_x) / 2 as x_mid, top_y + greatest(0.0, bottom_y - top_y) / 2 as y_mid from boxes)"""


@query("w3_reading_order_rows", f"""with recursive {CENTRES}, o as (select *, page_id as key, row_number() over (partition by page_id order by y_mid, x_mid, box_id) as i, y_mid as y, greatest(1.0, median(h) over (partition by page_id) * 0.5) as tol from c), {first_fit('o')},
    l as (select key, arg_max(m, i) as m from ff group by 1), pl as (select key, r, row_number() over (partition by key order by mean, r) - 1 as place from (select key, unnest(m) as mean, generate_subscripts(m, 1) as r from l) q),
    t as (select page_id, box_id, place, row_number() over (partition by page_id order by place, x_mid, o.i) as ordinal from o join ff using (key, i) join pl using (key, r))
    select page_id, box_id, place::int as row_no, ordinal::int as ordinal, 'AUTO_' || lpad(ordinal::varchar, 4, '0') as label from t""")
def _(v):
    return O.reading_order_rows(v.boxes)


def nearest_sql(sign: str) -> str:
    near = "list_transform(range(1, len(m) + 1), lambda k: case when abs(o.y - m[k]) <= greatest(1.0, least(o.h, mh[k]) * 0.5) then abs(o.y - m[k]) else 1e300 end)"
    put = lambda c, old, new: f"case when p = 0 then list_append({c}, {new}) else list_concat(list_append({c}[1:p - 1], {old}), {c}[p + 1:]) end"
    return f"""with recursive {CENTRES}, o as (select *, row_number() over (partition by page_id order by y_mid, {sign} * x_mid, top, {sign} * "left", box_id) as i, y_mid as y, count(*) over (partition by page_id) as n_boxes from c),
      f as (select page_id, i, [y] as m, [h] as mh, [top] as t, [1] as n, 1::bigint as r from o where i = 1 union all
        select page_id, i, {put('m', '(m[p] * n[p] + y) / (n[p] + 1)', 'y')}, {put('mh', '(mh[p] * n[p] + h) / (n[p] + 1)', 'h')}, {put('t', 'least(t[p], top)', 'top')}, {put('n', 'n[p] + 1', '1')}, case when p = 0 then len(m) + 1 else p end
        from (select *, case when list_min(d) < 1e300 then list_position(d, list_min(d)) else 0 end as p from (select o.page_id, o.i, o.y, o.h, o.top, m, mh, t, n, {near} as d from f join o on o.page_id = f.page_id and o.i = f.i + 1) q1) q2),
      l as (select page_id, arg_max(m, i) as m, arg_max(t, i) as t from f group by 1), pl as (select page_id, r, row_number() over (partition by page_id order by t, m, r) - 1 as place from (select page_id, unnest(m) as m, unnest(t) as t, generate_subscripts(m, 1) as r from l) q),
      e as (select o.page_id, box_id, n_boxes, place, row_number() over (partition by o.page_id order by place, {sign} * x_mid, y, top, o.i) as ordinal from o join f using (page_id, i) join pl on pl.page_id = o.page_id and pl.r = f.r)
      select page_id, box_id, place::int as row_no, ordinal::int as ordinal, 'B' || lpad(ordinal::varchar, greatest(3, length(n_boxes::varchar))::int, '0') as label from e"""


@query("w4_reading_order_nearest", nearest_sql("1"))
def _(v):
    return O.reading_order_nearest(v.boxes)


@query("w4_reading_order_rtl", nearest_sql("-1"))
def _(v):
    return O.reading_order_nearest(v.boxes, rtl=True)


def _assigned(v):
    return D.assign_tokens(v.tokens, D.filter_conf(v.boxes, 0.5))


TOKENS_IN = f"{ASSIGN.replace('with bub', 'with recursive bub', 1)}, tk as (select a.box_id, t.tok_id, (t.left_x + t.right_x) / 2 as x_mid, (t.top_y + t.bottom_y) / 2 as y_mid, t.bottom_y - t.top_y as h, t.top_y, t.bottom_y, txt from assigned a join tokens t using (tok_id))"


@query("w5_a5_bubble_text", f"""{TOKENS_IN}, o as (select *, box_id as key, row_number() over (partition by box_id order by y_mid, x_mid, tok_id) as i, y_mid as y, median(greatest(1.0, h)) over (partition by box_id) * 0.6 as tol from tk), {first_fit('o')},
    ln as (select box_id, r, coalesce(string_agg(txt, ' ' order by x_mid, o.i) filter (txt <> ''), '') as line from o join ff using (key, i) group by 1, 2)
    select box_id, trim(string_agg(line, chr(10) order by r), ' ' || chr(10)) as text from ln group by 1""")
def bubble_text(v):
    b = G.Box.of()
    t = v.tokens.withColumns({"x_mid": (b.left + b.right) / 2, "y_mid": (b.top + b.bottom) / 2, "h": b.height})
    return O.bubble_text(D.assign_tokens(t, D.filter_conf(v.boxes, 0.5), ("x_mid", "y_mid", "h", "txt")))


LINES = "greatest(1, least(12, max(r)))::int"


@query("w6_line_counts", f"""with recursive o as (select page_id as key, row_number() over (partition by page_id order by (top_y + bottom_y) / 2, box_id) as i, (top_y + bottom_y) / 2 as y, greatest(1.0, median(greatest(1.0, bottom_y - top_y)) over (partition by page_id) * 0.6) as tol from boxes), {first_fit('o')}
    select key as box_id, {LINES} as line_count from ff group by 1""")
def _(v):
    b = G.Box.of()
    return O.line_counts(v.boxes.select(F.col("page_id").alias("box_id"), F.col("box_id").alias("tok_id"), ((b.top + b.bottom) / 2).alias("y_mid"), b.height.alias("h")))


@query("a4_median_heights", "select page_id, median(bottom_y - top_y) as median_h from boxes group by 1")
def _(v):
    return O.median_heights(v.boxes)


@query("a3_ocr_stats", f"""{ASSIGN}, b as (select * from bub), j as (select a.box_id, t.left_x, t.top_y, t.right_x, t.bottom_y, b.left_x as bl, b.top_y as bt, b.right_x as br, b.bottom_y as bb from assigned a join tokens t using (tok_id) join b using (box_id)),
    cells as (select distinct box_id, x, y from j, unnest(range(floor(least(greatest(left_x, bl), br))::bigint, floor(least(greatest(right_x, bl), br))::bigint)) as ux(x), unnest(range(floor(least(greatest(top_y, bt), bb))::bigint, floor(least(greatest(bottom_y, bt), bb))::bigint)) as uy(y)),
    ar as (select box_id, count(*) as mask_area from cells group by 1), bx as (select box_id, count(*) as n_polys, min(left_x) as ocr_left, min(top_y) as ocr_top, max(right_x) as ocr_right, max(bottom_y) as ocr_bottom from j group by 1)
    select b.box_id, coalesce(n_polys, 0) as n_polys, coalesce(mask_area, 0) as mask_area, greatest(1.0, (right_x - left_x) * (bottom_y - top_y)) as bubble_area, least(1.0, coalesce(mask_area, 0) / greatest(1.0, (right_x - left_x) * (bottom_y - top_y))) as cov, ocr_left, ocr_top, ocr_right, ocr_bottom
    from b left join ar using (box_id) left join bx using (box_id)""")
def _(v):
    return O.ocr_stats(v.tokens, _assigned(v), D.filter_conf(v.boxes, 0.5)).drop("line_count", "font_est_px")


@query("a3_w6_ocr_lines", f"""{TOKENS_IN}, o as (select box_id as key, row_number() over (partition by box_id order by y_mid, tok_id) as i, y_mid as y, greatest(1.0, median(greatest(1.0, h)) over (partition by box_id) * 0.6) as tol from tk), {first_fit('o')},
    n as (select key as box_id, {LINES} as line_count from ff group by 1), e as (select box_id, max(bottom_y) - min(top_y) as height from tk group by 1)
    select b.box_id, coalesce(line_count, 0)::int as line_count, case when height > 0 and line_count > 0 then height / line_count / 1.2::double end as font_est_px from bub b left join n using (box_id) left join e using (box_id)""")
def _(v):
    return O.ocr_stats(v.tokens, _assigned(v), D.filter_conf(v.boxes, 0.5)).select("box_id", "line_count", "font_est_px")


BLOCKS = "with q as (select page_id, y // 2 as y, x // 2 as x, max(v) filter (y % 2 = 0 and x % 2 = 0) as a, max(v) filter (y % 2 = 0 and x % 2 = 1) as b, max(v) filter (y % 2 = 1 and x % 2 = 0) as c, max(v) filter (y % 2 = 1 and x % 2 = 1) as d from (select page_id, y, x, v % 4 as v from pixels) p group by 1, 2, 3)"


def _few(v):
    return v.pixels.withColumn("v", F.col("v") % 4)


@query("a19_mode_2x2", f"{BLOCKS} select page_id, y, x, case when a = b or a = c then a when b = c then b else d end as v from q")
def mode_2x2(v):
    return P.downsample(_few(v))


@query("a19_mode_raw", f"{BLOCKS} select page_id, y, x, coalesce(case when a = b or a = c then nullif(a, 0) when b = c then nullif(b, 0) end, d) as v from q")
def _(v):
    return P.downsample(_few(v), "raw")


@query("a19_mode_stippled", f"{BLOCKS} select page_id, y, x, coalesce(case when a = b or a = c then nullif(a, 0) when b = c then nullif(b, 0) end, nullif(d, 0), nullif(a, 0), nullif(b, 0), c) as v from q")
def _(v):
    return P.downsample(_few(v), "stippled")


@query("a20_counting", """with n as (select page_id, y // 2 as y, x // 2 as x, v % 4 as v, count(*) as n, min(y * 100 + x) as pos from pixels group by 1, 2, 3, 4), r as (select *, row_number() over (partition by page_id, y, x order by n desc, pos) as rn from n) select page_id, y, x, v from r where rn = 1""")
def _(v):
    return P.downsample(_few(v), "counting")


@query("a21_mode_blocks", """with c as (select page_id // 2 as vol_id, page_id % 2 as z, y, x, v % 5 as v from pixels), n as (select vol_id, z // 2 as z, y // 2 as y, x // 2 as x, v, count(*) as n, min(z * 10000 + y * 100 + x) as f, max(z * 10000 + y * 100 + x) as l from c group by 1, 2, 3, 4, 5),
    r as (select *, row_number() over (partition by vol_id, z, y, x order by n desc, f) as rn, row_number() over (partition by vol_id, z, y, x order by l desc) as ln from n),
    g as (select vol_id, z, y, x, max(n) as m, max(v) filter (rn = 1) as best, max(v) filter (ln = 1) as last from r group by 1, 2, 3, 4) select vol_id, z, y, x, case when m >= 2 then best else last end as v from g""")
def _(v):
    vox = v.pixels.select(F.floor(F.col("page_id") / 2).alias("vol_id"), (F.col("page_id") % 2).alias("z"), "y", "x", (F.col("v") % 5).alias("v"))
    return P.downsample_blocks(vox)


@query("a22_average", "select page_id, y // 2 as y, x // 2 as x, floor(avg(v))::bigint as v from pixels group by 1, 2, 3")
def _(v):
    return P.downsample(v.pixels, "average")


@query("a22_max", "select page_id, y // 2 as y, x // 2 as x, max(v) as v from pixels group by 1, 2, 3")
def _(v):
    return P.downsample(v.pixels, "max")


@query("a22_stride", "select page_id, y // 2 as y, x // 2 as x, v from pixels where y % 2 = 0 and x % 2 = 0")
def _(v):
    return P.downsample(v.pixels, "stride")


@query("a23_otsu", """with h as (select page_id as grp, v, count(*) as n from pixels group by 1, 2), c as (select grp, v, sum(n) over u as wb, sum(n * v) over u as sb, sum(n) over g as total, sum(n * v) over g as s from h window u as (partition by grp order by v), g as (partition by grp)),
    m as (select *, case when total - wb > 0 then wb::double * (total - wb) * (sb / wb::double - (s - sb) / (total - wb)::double) * (sb / wb::double - (s - sb) / (total - wb)::double) end as var from c),
    r as (select *, row_number() over (partition by grp order by var desc nulls last, v) as rn from m) select grp, case when var is null then 128 else v end::bigint as threshold from r where rn = 1""")
def _(v):
    return P.otsu(v.pixels.select(F.col("page_id").alias("grp"), "v"))


def lab_sql(r: str, g: str, b: str, name: str) -> str:
    """SQL of a struct {L, a, b} of three sRGB expressions."""
    linear = lambda c: f"case when ({c}) / 255.0::double > 0.04045 then pow((({c}) / 255.0::double + 0.055::double) / 1.055::double, 2.4::double) else ({c}) / 255.0::double / 12.92::double end"
    x, y, z = (f"({p}::double * ({linear(r)}) + {q}::double * ({linear(g)}) + {s}::double * ({linear(b)}))" for p, q, s in (("0.412453", "0.357580", "0.180423"), ("0.212671", "0.715160", "0.072169"), ("0.019334", "0.119193", "0.950227")))
    x, z = f"({x} / 0.950456::double)", f"({z} / 1.088754::double)"
    f = lambda t: f"(case when {t} > 0.008856 then cbrt({t}) else 7.787::double * {t} + 16.0::double / 116 end)"
    return f"{{'L': (case when {y} > 0.008856 then 116 * cbrt({y}) - 16 else 903.3::double * {y} end) * 255 / 100, 'a': 500 * ({f(x)} - {f(y)}) + 128, 'b': 200 * ({f(y)} - {f(z)}) + 128}} as {name}"


@query("a24_fill_color", f"""with p0 as (select page_id as bubble_id, v as r, v * 3 % 256 as g, v * 7 % 256 as b, (y + x) % 3 = 0 as in_mask from pixels),
    n as (select bubble_id, count(*) filter (in_mask) as n_mask, count(*) filter (not in_mask) as n_bg from p0 group by 1), p1 as (select * from p0 join n using (bubble_id) where n_mask >= {P.MIN_MASK}),
    bg as (select bubble_id, median(r) as br, median(g) as bgr, median(b) as bb from p1 where not in_mask or n_bg < {P.MIN_BACKGROUND} group by 1),
    p2 as (select *, {lab_sql('r::double', 'g::double', 'b::double', 'own')}, {lab_sql('br', 'bgr', 'bb', 'far')} from p1 join bg using (bubble_id) where in_mask),
    p3 as (select *, sqrt((own.L - far.L) * (own.L - far.L) + (own.a - far.a) * (own.a - far.a) + (own.b - far.b) * (own.b - far.b)) as d from p2), tp as (select bubble_id, quantile_cont(d, 0.98) as top from p3 group by 1),
    lv as (select p3.*, top, trunc(least(255.0, greatest(0.0, d / top * 255)))::bigint as v from p3 join tp using (bubble_id)),
    h as (select bubble_id as grp, v, count(*) as n from lv where top > 1e-3 group by 1, 2), c as (select grp, v, sum(n) over u as wb, sum(n * v) over u as sb, sum(n) over g as total, sum(n * v) over g as s from h window u as (partition by grp order by v), g as (partition by grp)),
    m as (select *, case when total - wb > 0 then wb::double * (total - wb) * (sb / wb::double - (s - sb) / (total - wb)::double) * (sb / wb::double - (s - sb) / (total - wb)::double) end as var from c),
    ot as (select grp as bubble_id, case when var is null then 128 else v end as threshold from (select *, row_number() over (partition by grp order by var desc nulls last, v) as rn from m) q where rn = 1),
    gl as (select lv.*, coalesce(threshold / 255.0::double * top < 3.0 or d > threshold / 255.0::double * top, true) as glyph from lv left join ot using (bubble_id)),
    us as (select *, count(*) filter (glyph) over (partition by bubble_id) as n_glyph from gl)
    select bubble_id, median(r) as r, median(g) as g, median(b) as b from us where glyph or n_glyph < {P.MIN_GLYPH} or n_glyph > 0.95 * n_mask group by 1""")
def _(v):
    p = v.pixels.select(F.col("page_id").alias("bubble_id"), F.col("v").alias("r"), (F.col("v") * 3 % 256).alias("g"), (F.col("v") * 7 % 256).alias("b"), ((F.col("y") + F.col("x")) % 3 == 0).alias("in_mask"))
    return P.fill_color(p)


@query("p20_luma", "select page_id, y, x, 0.299 * v + 0.587 * (v * 3 % 256) + 0.114 * (v * 7 % 256) as l from pixels")
def _(v):
    c = F.col("v").cast("double")
    return v.pixels.select("page_id", "y", "x", G.luma(c, (F.col("v") * 3 % 256).cast("double"), (F.col("v") * 7 % 256).cast("double")).alias("l"))


@query("p21_white_mask", "select page_id, y, x from pixels where v = 255")
def _(v):
    return P.white_mask(v.pixels)


@query("p22_composite", "select page_id, y, x, case when (y + x) % 2 = 0 then (1 - 0.25::double) * v + 0.25::double * (255 - v) else v end::double as v from pixels")
def _(v):
    mask = v.pixels.where((F.col("y") + F.col("x")) % 2 == 0).select("page_id", "y", "x", G.lit(0.25).alias("m"))
    return P.composite(v.pixels, mask, v.pixels.withColumn("v", 255 - F.col("v")))


@query("p27_clamp_range", "select sample_id, least(greatest(fake_score, 0.0), 1.0)::double as v from eval_samples")
def _(v):
    return v.eval_samples.select("sample_id", G.clamp_range(F.col("fake_score"), 0.0, 1.0).alias("v"))


@query("f20_lab", f"select page_id, y, x, lab.L as \"L\", lab.a as a, lab.b as b from (select page_id, y, x, {lab_sql('v', 'v * 3 % 256', 'v * 7 % 256', 'lab')} from pixels) q")
def _(v):
    c = F.col("v").cast("double")
    lab = G.rgb_to_lab(c, c * 3 % 256, c * 7 % 256)
    return v.pixels.select("page_id", "y", "x", lab.alias("lab")).select("page_id", "y", "x", "lab.L", "lab.a", "lab.b")


@query("j17_class_counts", """with t as (select page_id as sample_id, y, x, v % 11 as t, (v * 3 + x) % 11 as p, (y + x) % 3 = 0 as m from pixels),
    l as (select sample_id, t as class_id, 1 as n, m::int as mt, 0 as mp from t union all select sample_id, p, 0, 0, m::int from t) select sample_id, class_id, sum(n)::bigint as n_total, sum(mt)::bigint as n_mask_target, sum(mp)::bigint as n_mask_pred from l group by 1, 2""")
def _(v):
    p = v.pixels.withColumnRenamed("page_id", "sample_id")
    return P.class_counts(p.withColumn("cls", (F.col("v") * 3 + F.col("x")) % 11), p.withColumn("cls", F.col("v") % 11), p.where((F.col("y") + F.col("x")) % 3 == 0))


@query("a9_ssim", """with w as (select k, exp(-(k * k) / (2 * 1.5::double * 1.5)) as g from unnest(range(-5, 6)) as u(k)), n as (select k, g / (select sum(g) from w) as g from w),
    a as (select page_id, y, x, v / 255.0::double as p, least(255, v + x) / 255.0::double as t from pixels),
    h as (select page_id, y, x - k as x, sum(g * p) as p, sum(g * t) as t, sum(g * p * p) as pp, sum(g * t * t) as tt, sum(g * p * t) as pt from a, n group by 1, 2, 3),
    b as (select page_id, y - k as y, x, sum(g * p) as p, sum(g * t) as t, sum(g * pp) as pp, sum(g * tt) as tt, sum(g * pt) as pt from h, n group by 1, 2, 3)
    select page_id, avg(((2 * b.p * b.t + 1e-4::double) * (2 * (pt - b.p * b.t) + 9e-4::double)) / ((b.p * b.p + b.t * b.t + 1e-4::double) * ((pp - b.p * b.p) + (tt - b.t * b.t) + 9e-4::double))) as ssim
    from b join a using (page_id, y, x) group by 1""")
def _(v):
    rows = lambda e: v.pixels.groupBy("page_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", e.alias("v")))), lambda s: s["v"]).alias("px"))
    return P.ssim(rows(F.col("v")), rows(F.least(F.lit(255), F.col("v") + F.col("x"))))
