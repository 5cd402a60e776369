"""Queries on mask datasets and layout."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.operators import layout as L
from quirefold.operators import masks as M
from quirefold.session import tables

from .registry import query
from .sql import norm_token

SIDES = ("left_x", "top_y", "right_x", "bottom_y")


def unit(seed, draw: str, *keys: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {''.join(f'({k})::varchar || chr(58) || ' for k in keys)} '{draw}'), 1, 8))::bigint / 4294967296.0::double)"


def whole(u: str, low: str, high: str) -> str:
    return f"({low} + floor({u} * greatest(0, {high} - {low})))::bigint"


RECTS = f"""with a as (select *, least(100, h - 20, w - 20) as side, {whole(unit(7, 'times', 'image_id'), '0', '4')} as times from images), b as (select *, i from a, unnest(range(1, times + 1)) as u(i)),
  c as (select *, {whole(unit(7, 'bw', 'image_id', 'i'), '30', 'side')} as bw, {whole(unit(7, 'bh', 'image_id', 'i'), '30', 'side')} as bh from b),
  d as (select *, {whole(unit(7, 'x', 'image_id', 'i'), '10', '(w - 10 - bw + 1)')} as x0, {whole(unit(7, 'y', 'image_id', 'i'), '10', '(h - 10 - bh + 1)')} as y0 from c)"""


@query("g1_rectangles", f"{RECTS} select image_id, i, y0, y0 + bh as y1, x0, x0 + bw as x1 from d")
def _(v):
    return M.gen_rectangles(v.images, 7)


STRIPES = f"""with a as (select *, {whole(unit(7, 'sy', 'image_id'), '2', '5')} as sy, {whole(unit(7, 'sx', 'image_id'), '2', '5')} as sx, {unit(7, 'wy', 'image_id')} as uy, {unit(7, 'wx', 'image_id')} as ux, {unit(7, 'oy', 'image_id')} as vy, {unit(7, 'ox', 'image_id')} as vx from images),
    b as (select *, {whole('uy', '1', 'least(sy, 4)')} as wy, {whole('ux', '1', 'least(sx, 4)')} as wx, {whole('vy', '0', 'sy')} as oy, {whole('vx', '0', 'sx')} as ox from a)
    select image_id, 'y' as axis, i, i as y0, least(i + wy, h) as y1, 0 as x0, w as x1 from b, unnest(range(oy, h, sy)) as u(i) union all select image_id, 'x', i, 0, h, i, least(i + wx, w) from b, unnest(range(ox, w, sx)) as u(i)"""


@query("g2_stripes", STRIPES)
def _(v):
    return M.gen_stripes(v.images, 7)


@query("g3_central_square", f"select image_id, round_even(w / 2 - {math.sqrt(0.225) / 2!r}::double * w, 0)::bigint as y0, round_even(w / 2 + {math.sqrt(0.225) / 2!r}::double * w, 0)::bigint as y1, round_even(h / 2 - {math.sqrt(0.225) / 2!r}::double * h, 0)::bigint as x0, round_even(h / 2 + {math.sqrt(0.225) / 2!r}::double * h, 0)::bigint as x1 from images")
def _(v):
    return M.gen_area(v.images, 7, False)


LO, HI = math.sqrt(0.1), math.sqrt(0.35)


RANDOM_AREA = f"""with s as (select *, round_even(({unit(7, 'side_w', 'image_id')} * {HI - LO!r}::double + {LO!r}::double) * w, 0)::bigint as sw, round_even(({unit(7, 'side_h', 'image_id')} * {HI - LO!r}::double + {LO!r}::double) * h, 0)::bigint as sh from images),
    t as (select *, {whole(unit(7, 'start_w', 'image_id'), '0', '(w - sw)')} as a, {whole(unit(7, 'start_h', 'image_id'), '0', '(h - sh)')} as b from s) select image_id, a as y0, a + sw as y1, b as x0, b + sh as x1 from t"""


@query("g3_random_area", RANDOM_AREA)
def _(v):
    return M.gen_area(v.images, 7, True)


def _pad(i, size):
    return f"({whole(unit(7, f'pad{i}', 'image_id'), f'floor(0.04::double * {size})::bigint', f'floor(0.25::double * {size})::bigint')} / {size}::double)"


BORDER = f"""with a as (select *, {unit(7, 'side0', 'image_id')} < 0.5 as d0, {unit(7, 'side1', 'image_id')} < 0.5 as d1, {unit(7, 'side2', 'image_id')} < 0.5 as d2, {unit(7, 'side3', 'image_id')} < 0.5 as d3, {unit(7, 'lone', 'image_id')} as u from images),
    b as (select *, not (d0 or d1 or d2 or d3) as none, least(3, floor(u * 4)) as pick from a)
    select image_id, 0 as side, 0 as y0, h as y1, 0 as x0, trunc({_pad(0, 'h')} * w)::bigint as x1 from b where d0 or (none and pick = 0) union all
    select image_id, 1, 0, trunc({_pad(1, 'w')} * h)::bigint, 0, w from b where d1 or (none and pick = 1) union all
    select image_id, 2, 0, h, trunc((1 - {_pad(2, 'h')}) * w)::bigint, w from b where d2 or (none and pick = 2) union all
    select image_id, 3, trunc((1 - {_pad(3, 'w')}) * h)::bigint, h, 0, w from b where d3 or (none and pick = 3)"""


@query("g4_border", BORDER)
def _(v):
    return M.gen_border(v.images, 7)


def draw(name: str) -> str:
    """A draw of a stroke whose name is an SQL expression."""
    return f"(('0x' || substr(md5('7:' || image_id || ':' || stroke || ':' || {name}), 1, 8))::bigint / 4294967296.0::double)"


STROKES = f"""st as (select *, {whole(unit(7, 'times', 'image_id'), '0', '11')} as times from images), ss as (select *, s as stroke from st, unnest(range(0, times)) as u(s)),
  s0 as (select *, {whole(draw("'x'"), '0', 'w')} as sx, {whole(draw("'y'"), '0', 'h')} as sy, {whole(draw("'n'"), '1', '6')} as n from ss),
  wk as (select image_id, w, h, stroke, n, -1::bigint as segment, 0::bigint as x0, 0::bigint as y0, sx as x1, sy as y1, 0::bigint as width from s0 union all
    select image_id, w, h, stroke, n, segment + 1, x1, y1, greatest(0, least(w, trunc(x1 + length * sin(angle))))::bigint, greatest(0, least(h, trunc(y1 + length * cos(angle))))::bigint, width
    from (select image_id, w, h, stroke, n, segment, x1, y1, case when stroke % 2 = 0 then 2 * 3.1415926::double - (turn + 0.01::double) else turn + 0.01::double end as angle, length, width
      from (select *, {whole(draw("'a' || (segment + 1)"), '0', '4')} as turn, {whole(draw("'l' || (segment + 1)"), '10', '70')} as length, {whole(draw("'b' || (segment + 1)"), '5', '25')} as width from (select * exclude (width) from wk) q where segment + 1 < n) q1) q2)"""


@query("g5_strokes", f"with recursive {STROKES} select image_id, stroke, segment, x0, y0, x1, y1, width from wk where segment >= 0")
def _(v):
    return M.gen_strokes(v.images, 7)


@query("g6_kinds", f"""select image_id, case when {unit(7, 'kind', 'image_id')} < 0.5 / 2.0 then 'box' when {unit(7, 'kind', 'image_id')} < 1.5 / 2.0 then 'dumb' else 'superres' end as kind, {unit(7, 'invert', 'image_id')} < 0.25 as inverted from images""")
def _(v):
    return v.images.select("image_id", M.choose_kind(7, {"box": 0.5, "dumb": 1.0, "superres": 0.5}, F.col("image_id")).alias("kind"), (M.unit(7, "invert", F.col("image_id")) < 0.25).alias("inverted"))


BOXES = f"{RECTS} select image_id, y0, y0 + bh as y1, x0, x0 + bw as x1 from d"
SQUARES = "select image_id, y0 - width // 2 as y0, y0 + width // 2 as y1, x0 - width // 2 as x0, x0 + width // 2 as x1 from wk where segment >= 0"
PARTS = {"box": BOXES, "dumb": RANDOM_AREA, "outpainting": f"select image_id, y0, y1, x0, x1 from ({BORDER}) q", "squares": SQUARES}
CIRCLES = "select image_id, y0 + d as y0, y0 + d + 1 as y1, x0 - half as x0, x0 + half + 1 as x1 from (select *, floor(sqrt((width * width - d * d)::double))::bigint as half from wk, unnest(range(-width, width + 1)) as u(d) where segment >= 0) q"


def _edge(side: str) -> str:
    a = f"y0 + {side} * r * (x1 - x0) / n"
    b = f"y1 + {side} * r * (x1 - x0) / n"
    return f"case when n > 0 and y0 <> y1 and y >= least({a}, {b}) and y <= greatest({a}, {b}) then x0 + -{side} * r * (y1 - y0) / n + (y - ({a})) / (y1 - y0) * (x1 - x0) end"


_REACH = "case when abs(y - {0}) <= r then sqrt(r * r - (y - {0}) * (y - {0})) end"
_ENDS = ", ".join([*(f"{x} {sign} {_REACH.format(y)}" for x, y in (("x0", "y0"), ("x1", "y1")) for sign in "-+"), _edge("1.0::double"), _edge("(-1.0::double)")])
LINES = f"""select image_id, y::bigint as y0, y::bigint + 1 as y1, ceil(lo)::bigint as x0, floor(hi)::bigint + 1 as x1 from (select image_id, y, least({_ENDS}) as lo, greatest({_ENDS}) as hi from
  (select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as n, yy::double as y from (select image_id, x0::double as x0, y0::double as y0, x1::double as x1, y1::double as y1, width / 2.0::double as r from wk where segment >= 0) q,
    unnest(range(floor(least(y0, y1) - r)::bigint, ceil(greatest(y0, y1) + r)::bigint + 1)) as u(yy)) q1) q2 where floor(hi)::bigint + 1 > ceil(lo)::bigint"""
GENERATED = {
    "circles": f"with recursive {STROKES} {CIRCLES}", "lines": f"with recursive {STROKES} {LINES}",
    "box": BOXES, "dumb": RANDOM_AREA, "outpainting": f"select image_id, y0, y1, x0, x1 from ({BORDER}) q", "squares": f"with recursive {STROKES} {SQUARES}",
    "superres": f"select image_id, y0, y1, x0, x1 from ({STRIPES}) q",
}
for _name, _sql in GENERATED.items():
    query(f"x5_generator_{_name}", _sql)(lambda v, name=_name: M.GENERATORS[name](v.images, 7))


def kind_sql(*names: str) -> str:
    """Names of equal probability."""
    steps = " ".join(f"when {unit(7, 'kind', 'image_id')} < {i}.0 / {len(names)}.0::double then '{n}'" for i, n in enumerate(names[:-1], 1))
    return f"case {steps} else '{names[-1]}' end"


def mixed_sql(*names: str) -> str:
    """Tables ki (image_id, kind, inverted) and mx (the rectangles of each image's own kind)."""
    parts = " union all ".join(f"select kind, inverted, p.* from ki join ({PARTS[n]}) p using (image_id) where kind = '{n}'" for n in names)
    return f"ki as (select image_id, {kind_sql(*names)} as kind, {unit(7, 'invert', 'image_id')} < 0.2 as inverted from images), mx as ({parts})"


@query("g6_mixed_masks", f"with recursive {STROKES}, {mixed_sql('box', 'dumb', 'outpainting', 'squares')} select image_id, kind, inverted, y0, y1, x0, x1 from mx")
def _(v):
    return M.mixed_masks(v.images, {"box": 1, "dumb": 1, "outpainting": 1, "squares": 1}, 7, 0.2)


@query("g7_debug_windows", "select image_id, y0, least(y0 + 200, h) as y1, x0, least(x0 + 200, w) as x1 from images, unnest(range(0, h - 100, 100)) as a(y0), unnest(range(0, w - 100, 100)) as b(x0)")
def _(v):
    return M.debug_windows(v.images)


UNION_AREA = """eg as (select distinct mask_id, x from (select mask_id, x0 as x from rects union all select mask_id, x1 from rects) q), sp as (select mask_id, x as a, lead(x) over (partition by mask_id order by x) as b from eg),
  cv as (select r.mask_id, a, b, y0, y1, coalesce(max(y1) over (partition by r.mask_id, a order by y0, y1 rows between unbounded preceding and 1 preceding), y0) as reached from rects r join sp on r.mask_id = sp.mask_id and x0 <= a and x1 >= b),
  ar as (select mask_id, sum(greatest(0, y1 - greatest(y0, reached)) * (b - a))::bigint as area from cv group by 1)"""


@query("g8_mask_dataset", f"""with fan as (select image_id * 4 + k as image_id, w, h from images, unnest(range(0, 4)) as u(k)), {mixed_sql('box', 'dumb', 'outpainting').replace('from images', 'from fan')}, rects as (select image_id as mask_id, kind, y0, y1, x0, x1 from mx where y1 > y0 and x1 > x0), {UNION_AREA},
    kd as (select mask_id, min(kind) as kind from rects group by 1), sz as (select mask_id, kind, area, area / (w * h)::double as share from ar join kd using (mask_id) join fan on mask_id = image_id where area > 0 and area / (w * h)::double <= 0.5),
    rk as (select *, row_number() over (partition by mask_id // 4 order by {unit(7, 'keep', 'mask_id')}, mask_id) as rn from sz)
    select mask_id // 4 as image_id, mask_id % 4 as variant, mask_id, kind, area, share from rk where rn <= 2""")
def _(v):
    return M.mask_dataset(v.images, {"box": 1, "dumb": 1, "outpainting": 1}, 4, 0.5, 2, 7)


BOUNDS = "bd as (select mask_id, min(y0) as y0, max(y1) - 1 as y1, min(x0) as x0, max(x1) - 1 as x1, case when mask_id % 2 = 0 then 160 else 128 end as w, case when mask_id % 2 = 0 then 128 else 160 end as h from mask_rects group by 1)"


@query("g9_square_crop", f"""with {BOUNDS}, e as (select *, h < w as wide, least(w, h) as size, greatest(w, h) as f, case when h < w then x0 else y0 end as low, case when h < w then x1 else y1 end as high from bd),
    g as (select *, greatest(0.0, least(f - size - 1, low + (high - low) * 0.5 - size)) as first from e), k as (select *, greatest(first + 1, least(f - size, low + (high - low) * 0.5)) as last from g),
    s as (select *, {whole(unit(7, 'crop', 'mask_id'), 'trunc(first)::bigint', 'trunc(last)::bigint')} as start from k)
    select mask_id, case when wide then start else 0 end as cx0, case when wide then 0 else start end as cy0, case when wide then start + size else w end as cx1, case when wide then h else start + size end as cy1 from s""")
def _(v):
    b = v.mask_rects.groupBy("mask_id").agg(F.min("y0").alias("y0"), (F.max("y1") - 1).alias("y1"), F.min("x0").alias("x0"), (F.max("x1") - 1).alias("x1"))
    even = F.col("mask_id") % 2 == 0
    return M.square_crop(b.withColumns({"w": F.when(even, 160).otherwise(128), "h": F.when(even, 128).otherwise(160)}), 7)


@query("g10_curriculum", f"""{RECTS.replace("least(100, h - 20, w - 20) as side", "least(trunc(31 + 70 * ramp)::bigint, h - 20, w - 20) as side").replace("'0', '4'", "").replace("greatest(0, 4 - 0)", "greatest(0, trunc(3 * ramp)::bigint + 1 - 0)").replace("from images)", "from (select *, case when image_id < 0 then 0.0 when image_id >= 1000 then 1.0 else image_id / 1000.0::double end::double as ramp from images) q)", 1)}
    select image_id, i, y0, y0 + bh as y1, x0, x0 + bw as x1 from d""")
def _(v):
    return M.curriculum(v.images, 7, F.col("image_id"), 1000)


@query("g11_candidates", "with g as (select sample_id, class_id as seg_id, bool_or(class_id % 4 <> 0) as thing, sum(n_total)::double as n from class_freq group by 1, 2) select sample_id, seg_id, n / (30 * 30) as share from g where thing and n / (30 * 30) < 0.1::double")
def _(v):
    s = v.class_lines.select("sample_id", F.col("class_id").alias("seg_id"), (F.col("class_id") % 4 != 0).alias("is_thing"), "n_px")
    dims = v.class_lines.select("sample_id").distinct().withColumns({"w": F.lit(30), "h": F.lit(30)})
    return M.candidates(s, dims, 0.1).withColumn("share", F.col("share").cast("double"))


_MOVED = "least(greatest(round_even({0}, 0)::bigint, 0), 128)"
_X = "(r.{0} - mx) * f"
#: Copies of masks on images of 128 x 128: strips between edges of y, disjoint spans in each, and sums over them for every shift.
PLACED = f"""with b as materialized (select mask_id, (min(y0)::double + max(y1)) / 2 as my, (min(x0)::double + max(x1)) / 2 as mx from mask_rects group by 1),
  v as materialized (select *, (1 - 0.2::double) + 2 * 0.2::double * {unit(7, 'scale', 'mask_id', 'k')} as f, {unit(7, 'flip', 'mask_id', 'k')} < 0.5 as flip, my + (2 * 0.1::double * {unit(7, 'shift', 'mask_id', 'k')} - 0.1::double) * 128 as cy from b, unnest(range(0, 2)) as u(k)),
  mv as materialized (select mask_id, k, rn, {_MOVED.format('cy + (r.y0 - my) * f')} as y0, {_MOVED.format('cy + (r.y1 - my) * f')} as y1,
    case when flip then (128 - mx) + -({_X.format('x1')}) else mx + {_X.format('x0')} end as a, case when flip then (128 - mx) + -({_X.format('x0')}) else mx + {_X.format('x1')} end as b from v join mask_rects r using (mask_id)),
  mo as materialized (select * from mv where y0 < y1),
  og as materialized (select mask_id, k, y0, y1, x0::double as a, x1::double as b from v join mask_rects using (mask_id)),
  ed as materialized (select mask_id, k, y0 as e from mo union select mask_id, k, y1 from mo union select mask_id, k, y0 from og union select mask_id, k, y1 from og),
  st as materialized (select *, lead(e) over (partition by mask_id, k order by e) as e2 from ed),
  sp as materialized (select st.mask_id, st.k, e, e2, 0 as own, a, b from st join og on og.mask_id = st.mask_id and og.k = st.k and y0 <= e and y1 >= e2 union all select st.mask_id, st.k, e, e2, 1, a, b from st join mo on mo.mask_id = st.mask_id and mo.k = st.k and y0 <= e and y1 >= e2),
  dj as materialized (select mask_id, k, e, e2, own, greatest(a, coalesce(max(b) over (partition by mask_id, k, e, own order by a, b rows between unbounded preceding and 1 preceding), a)) as a, b from sp),
  pc as materialized (select * from dj where a < b), ar as (select mask_id, k, sum((e2 - e) * (b - a))::bigint as area from pc where own = 0 group by 1, 2),
  sh as materialized (select mask_id, k, d, {unit(7, 'x', 'mask_id', 'k').replace("'x'", "'x' || d")} as u from v, unnest(range(-64, 64, 8)) as u(d)),
  tr as materialized (select p.mask_id, p.k, d, e, e2, {_MOVED.format('a + d')} as a, {_MOVED.format('b + d')} as b from pc p join sh on sh.mask_id = p.mask_id and sh.k = p.k where own = 1),
  mi as materialized (select mask_id, k, d, sum((e2 - e) * (b - a)) as mine from tr group by 1, 2, 3),
  co as materialized (select x.mask_id, x.k, x.d, sum((x.e2 - x.e) * greatest(0, least(x.b, y.b) - greatest(x.a, y.a))) as common from tr x join pc y on x.mask_id = y.mask_id and x.k = y.k and x.e = y.e and y.own = 0 group by 1, 2, 3),
  ok as materialized (select mask_id, k, arg_min(d, struct_pack(u := u, d := d)) as d from mi join sh using (mask_id, k, d) left join co using (mask_id, k, d) join ar using (mask_id, k)
    where mine > 0 and mine >= 0.02::double * 128 * 128 and coalesce(common, 0) <= 0.5::double * least(area, mine) group by 1, 2)
  select mask_id, k as variant, y0, y1, {_MOVED.format('a + d')} as x0, {_MOVED.format('b + d')} as x1 from mo join ok using (mask_id, k) where {_MOVED.format('a + d')} < {_MOVED.format('b + d')}"""


@query("g12_place", PLACED)
def _(v):
    return M.place(v.mask_rects, v.mask_rects.select("mask_id").distinct().withColumns({"w": F.lit(128), "h": F.lit(128)}), 7)


UP = "(ceil({0} / 16) * 16)::bigint"


@query("g13_area_crop", f"""with a as (select *, least(h, w, 128) as lo, least(h, w, 512) as hi from images), b as (select *, {unit(7, 'which', 'image_id')} < 0.5 as tall, least(hi, {UP.format(whole(unit(7, 'side', 'image_id'), 'lo', '(hi + 1)'))}) as one from a),
    c as (select *, least(hi, {UP.format('floor(65536 / one)')}) as two from b), d as (select *, case when tall then one else two end as out_h, case when tall then two else one end as out_w from c)
    select image_id, {whole(unit(7, 'sy', 'image_id'), '0', '(h - out_h + 1)')} as start_y, {whole(unit(7, 'sx', 'image_id'), '0', '(w - out_w + 1)')} as start_x, out_h, out_w from d""")
def _(v):
    return M.area_crop(v.images, 7)


@query("p23_border_crop", "select image_id, w as out_w, h as out_h, u.y0, u.y1, u.x0, u.x1 from images, lateral (values (0, trunc(h * 0.3 / 2)::bigint, 0, w), (h - trunc(h * 0.3 / 2)::bigint, h, 0, w), (0, h, 0, trunc(w * 0.3 / 2)::bigint), (0, h, w - trunc(w * 0.3 / 2)::bigint, w)) u(y0, y1, x0, x1)")
def _(v):
    return M.border_mask(v.images, 0.3, False)


@query("p23_border_expand", """with e as (select image_id, trunc(h * 0.3 / 2)::bigint as ph, trunc(w * 0.3 / 2)::bigint as pw, h + 2 * trunc(h * 0.3 / 2)::bigint as oh, w + 2 * trunc(w * 0.3 / 2)::bigint as ow from images)
    select image_id, ow as out_w, oh as out_h, u.y0, u.y1, u.x0, u.x1 from e, lateral (values (0, ph, 0, ow), (oh - ph, oh, 0, ow), (0, oh, 0, pw), (0, oh, ow - pw, ow)) u(y0, y1, x0, x1)""")
def _(v):
    return M.border_mask(v.images, 0.3, True)


@query("a31_mask_area", """with c as (select distinct mask_id, y, x from mask_rects, unnest(range(y0, y1)) as a(y), unnest(range(x0, x1)) as b(x)) select mask_id, count(*) as area, count(*) / (128 * 128)::double as share from c group by 1""")
def mask_area(v):
    return M.mask_area(v.mask_rects, v.mask_rects.select("mask_id").distinct().withColumns({"w": F.lit(128), "h": F.lit(128)}))


PAIRS = """pr as (select distinct a.image_id, a.mask_id as a, b.mask_id as b from mask_rects a join mask_rects b on a.image_id = b.image_id and a.mask_id < b.mask_id and a.y0 < b.y1 and b.y0 < a.y1 and a.x0 < b.x1 and b.x0 < a.x1)"""


@query("j15_overlap_pairs", f"""with {PAIRS}, r as (select *, row_number() over (partition by image_id, a order by b) as rn from pr), s as (select o_orderkey as mask_id, min(o_totalprice) as score from orders group by 1)
    select image_id, a, b, sb.score - sa.score as score_diff from r join s sa on a = sa.mask_id join s sb on b = sb.mask_id where rn <= 2""")
def overlap_pairs(v):
    return M.overlap_pairs(v.mask_rects, v.orders.groupBy(F.col("o_orderkey").alias("mask_id")).agg(F.min("o_totalprice").alias("score")))


@query("t3_pairs_by_score", f"""with {PAIRS}, r as (select *, row_number() over (partition by image_id, a order by b) as rn from pr), s as (select o_orderkey as mask_id, min(o_totalprice) as score from orders group by 1),
    d as (select image_id, a, b, sb.score - sa.score as score_diff from r join s sa on a = sa.mask_id join s sb on b = sb.mask_id where rn <= 2) select *, (row_number() over (partition by image_id order by score_diff, a, b))::int as pos from d""")
def _(v):
    from pyspark.sql import Window

    pairs = M.overlap_pairs(v.mask_rects, v.orders.groupBy(F.col("o_orderkey").alias("mask_id")).agg(F.min("o_totalprice").alias("score")))
    return pairs.withColumn("pos", F.row_number().over(Window.partitionBy("image_id").orderBy("score_diff", "a", "b")))


@query("j16_accept_masks", """with cells as (select distinct image_id, mask_id, y, x from mask_rects, unnest(range(y0, y1)) as a(y), unnest(range(x0, x1)) as b(x)), n as (select mask_id, count(*) as area from cells group by 1),
    p as (select c.mask_id, e.mask_id as e_id, count(*) as common from cells c join cells e using (image_id, y, x) where c.mask_id % 2 = 0 and e.mask_id % 2 = 1 group by 1, 2),
    g as (select p.mask_id, max(common / ne.area::double) as of_existing, max(common / nc.area::double) as of_current from p join n nc on p.mask_id = nc.mask_id join n ne on p.e_id = ne.mask_id group by 1)
    select n.mask_id, coalesce(of_existing, 0.0)::double as max_inter_existing, coalesce(of_current, 0.0)::double as max_inter_current, coalesce(of_existing, 0.0) <= 0.2 and coalesce(of_current, 0.0) <= 0.3 as accepted from n left join g using (mask_id) where n.mask_id % 2 = 0""")
def _(v):
    r = v.mask_rects
    return M.accept_masks(r.where("mask_id % 2 = 0"), r.where("mask_id % 2 = 1"), 0.2, 0.3)


# -- layout


@query("p9_top_class", """with s as (select bubble_id, [(bubble_id * 7 % 10) / 10.0::double, (bubble_id * 3 % 10) / 10.0::double, (bubble_id % 10) / 10.0::double] as probs from bubbles), m as (select bubble_id, probs, list_max(probs) as best from s)
    select bubble_id, (list_position(probs, best) - 1)::int as class_id, ['cloude', 'elipse', 'other'][list_position(probs, best)] as class, best as confidence, best >= 0.6 as definite from m""")
def _(v):
    p = lambda k: F.col("bubble_id") * k % 10 / 10.0
    return L.top_class(v.bubbles.select("bubble_id", F.array(p(7), p(3), p(1)).alias("probs")))


def _inputs(v):
    with tables(v.spark) as save:
        b = save(v.bubbles, keep=True)
    texts = b.select("bubble_id", F.when(F.col("bubble_id") % 13 == 0, " ").otherwise(F.repeat(F.lit("word "), F.col("n_words").cast("int") + 1)).alias("text"))
    g = G.inset_box(G.Box.of(), G.lit(6), G.lit(4))
    geometry = b.where("bubble_id % 5 <> 1").select("bubble_id", "source", *g.named("core_"))
    stats = b.where("bubble_id % 4 <> 2").select("bubble_id", "cov", "line_count", "font_est_px")
    classes = b.where("bubble_id % 3 <> 0").select("bubble_id", F.col("cls_name").alias("class"), F.col("conf").alias("confidence"), (F.col("conf") >= 0.6).alias("definite"))
    return L.layout_inputs(b, texts, geometry, stats, classes)


INPUTS = """li as (select bubble_id, repeat('word ', (n_words + 1)::int) as text, left_x, top_y, right_x, bottom_y, case when bubble_id % 5 <> 1 then left_x + 6 else left_x end as core_left_x, case when bubble_id % 5 <> 1 then top_y + 4 else top_y end as core_top_y,
    case when bubble_id % 5 <> 1 then right_x - 6 else right_x end as core_right_x, case when bubble_id % 5 <> 1 then bottom_y - 4 else bottom_y end as core_bottom_y, case when bubble_id % 5 <> 1 then source else 'bbox_fallback' end as source,
    case when bubble_id % 4 <> 2 then cov else 0 end::double as cov, case when bubble_id % 4 <> 2 then line_count else 0 end as line_count, case when bubble_id % 4 <> 2 then font_est_px end as font_est_px, (n_words + 1)::int as n_words,
    case when bubble_id % 3 <> 0 then cls_name end as class, case when bubble_id % 3 <> 0 then conf end as confidence, case when bubble_id % 3 <> 0 then conf >= 0.6 end as definite from bubbles where bubble_id % 13 <> 0)"""


@query("j11_layout_inputs", f"with {INPUTS} select * from li")
def _(v):
    return _inputs(v)


COMFORT_STEPS = """a as (select *, source like 'bbox_fallback%' as fb, greatest(1.0, core_right_x - core_left_x) as cw, greatest(1.0, core_bottom_y - core_top_y) as ch from li),
  b as (select *, (0.07::double + case when cov < 0.08 then 0.06::double when cov < 0.18 then 0.04::double when cov < 0.30 then 0.02::double else 0 end + case when fb then 0.06::double * (case when cov >= 0.30 then 0.20::double when cov >= 0.20 then 0.35::double when cov >= 0.12 then 0.55::double else 0.80::double end) else 0 end
    - case when cov >= 0.18 then 0.02::double else 0 end - case when cov >= 0.28 then 0.01::double else 0 end - case when line_count >= 4 then 0.02::double else 0 end) * (case when least(cw, ch) < 120 then 0.55::double when least(cw, ch) < 200 then 0.75::double else 1 end) as frac from a),
  c as (select *, greatest(0.03::double, least(0.14::double, frac)) as f from b), d as (select *, greatest(3.0, least(40.0, cw * f / 2)) as dx0, greatest(3.0, least(40.0, ch * f / 2)) as dy0 from c),
  e as (select *, least(dx0, greatest(0.0, (cw - 2) / 2)) as dx, least(dy0, greatest(0.0, (ch - 2) / 2)) as dy from d), cc as (select *, core_left_x + dx as c0, core_top_y + dy as c1, core_right_x - dx as c2, core_bottom_y - dy as c3 from e)"""
COMFORT = f"with {INPUTS}, {COMFORT_STEPS}"


@query("p11_comfort_clamp", f"{COMFORT} select bubble_id, c0 as left_x, c1 as top_y, c2 as right_x, c3 as bottom_y from cc")
def _(v):
    i = L.comfort_clamp(_inputs(v), "comfort", "core_")
    return i.select("bubble_id", *[F.col(f"comfort_{c}").alias(c) for c in SIDES])


RELAX_STEPS = """k as (select *, case when not fb then 1 when line_count <= 1 then 1.14::double when n_words <= 4 then 1.10::double when n_words <= 7 then 1.06::double else 1 end::double as k from cc),
    s as (select *, (c0 + c2) / 2 as mx, (c1 + c3) / 2 as my, greatest(1.0, c2 - c0) * k as w, greatest(1.0, c3 - c1) * k as h from k),
    rx as (select *, case when k > 1 then greatest(mx - w / 2, core_left_x) else c0 end as clamp_left_x, case when k > 1 then greatest(my - h / 2, core_top_y) else c1 end as clamp_top_y, case when k > 1 then least(mx + w / 2, core_right_x) else c2 end as clamp_right_x, case when k > 1 then least(my + h / 2, core_bottom_y) else c3 end as clamp_bottom_y from s)"""


@query("p12_short_text_relax", f"{COMFORT}, {RELAX_STEPS} select bubble_id, {', '.join(f'clamp_{c} as {c}' for c in SIDES)} from rx")
def _(v):
    i = L.comfort_clamp(_inputs(v), "comfort", "core_")
    i = L.short_text_relax(i, "relaxed", "comfort_", "core_")
    return i.select("bubble_id", *[F.col(f"relaxed_{c}").alias(c) for c in SIDES])


def scaled(box: str, k: str) -> list[str]:
    """SQL of a box scaled about its centre."""
    a, b, c, d = (f"{box}_{x}" if box else x for x in SIDES)
    w, h = f"greatest(1.0, {c} - {a}) * ({k}) / 2", f"greatest(1.0, {d} - {b}) * ({k}) / 2"
    return [f"({a} + {c}) / 2 - {w}", f"({b} + {d}) / 2 - {h}", f"({a} + {c}) / 2 + {w}", f"({b} + {d}) / 2 + {h}"]


def kept(name: str, columns: list[str]) -> str:
    return ", ".join(f"{c} as {name}_{x}" for c, x in zip(columns, SIDES, strict=True))


def clamped(box: str, to: str) -> list[str]:
    of = [f"{f}({box}_{x}, {to + '_' if to else ''}{x})" for x, f in zip(SIDES, ("greatest", "greatest", "least", "least"), strict=True)]
    ok = f"{of[2]} > {of[0]} and {of[3]} > {of[1]}"
    return [f"case when {ok} then {c} else {to + '_' if to else ''}{x} end" for c, x in zip(of, SIDES, strict=True)]


def blended(box: str, to: str, w: str) -> list[str]:
    """w is a column between 0 and 1; a result without area is the box itself."""
    one = lambda x: f"{box}_{x}", lambda x: f"{to + '_' if to else ''}{x}"
    of = {x: f"case when {w} <= 0 then {one[0](x)} when {w} >= 1 then {one[1](x)} else {one[0](x)} * (1 - {w}) + {one[1](x)} * {w} end" for x in SIDES}
    ok = f"{w} >= 1 or (({of['right_x']}) > ({of['left_x']}) and ({of['bottom_y']}) > ({of['top_y']}))"
    return [f"case when {ok} then {of[x]} else {one[0](x)} end" for x in SIDES]


# the core moves and grows with fallback geometry; what COMFORT_STEPS call core is the fit box
FIT = f"""{INPUTS}, m0 as (select *, source like 'bbox_fallback%' as low, case when cov < 0.15 then 0.24::double when cov < 0.30 then 0.20::double else 0.16::double end as by_ from li),
  m1 as (select *, {kept('moved', blended('core', '', 'by_'))} from m0), m2 as (select * exclude ({', '.join(f'moved_{x}' for x in SIDES)}), {kept('moved', clamped('moved', ''))} from m1),
  m3 as (select *, {kept('grown', scaled('moved', '1.10::double'))} from m2), m4 as (select * exclude ({', '.join(f'grown_{x}' for x in SIDES)}), {kept('grown', clamped('grown', ''))} from m3),
  ft as (select * exclude ({', '.join(f'core_{x}' for x in SIDES)}), {', '.join(f'case when not low then core_{x} when line_count <= 1 or n_words <= 3 then grown_{x} else moved_{x} end as core_{x}' for x in SIDES)} from m4)"""


@query("p13_fit_area", f"""with {FIT}, {COMFORT_STEPS.replace('from li)', 'from ft)', 1)}, {RELAX_STEPS},
    o1 as (select *, bubble_id % 2 = 0 as has, {kept('oc', scaled('', '0.4::double'))} from rx), o2 as (select *, {kept('ocr', [f'case when has then oc_{x} else core_{x} end' for x in SIDES])}, case when cov < 0.08 then 1.85::double when cov < 0.18 then 1.55::double else 1.32::double end as spread from o1),
    o3 as (select *, {kept('se', scaled('core', '1.03::double'))}, {kept('hi', scaled('ocr', 'spread'))} from o2), o4 as (select *, {kept('seed', clamped('se', 'clamp'))}, {kept('hint', clamped('hi', 'clamp'))}, case when has then greatest(0.0, least(0.5, (case when low then 0.16::double else 0.30::double end) * (case when n_words <= 3 then 0.55::double else 1 end))) else 0 end::double as pull from o3),
    o5 as (select *, {kept('lay', blended('seed', 'hint', 'pull'))} from o4), o6 as (select *, {kept('layout', clamped('lay', 'clamp'))} from o5)
    select bubble_id, {', '.join(f'{k}_{x}' for k in ('clamp', 'layout') for x in SIDES)} from o6""")
def _(v):
    i = _inputs(v)
    has = F.col("bubble_id") % 2 == 0
    ocr = [F.when(has, c).alias(f"ocr_{n}") for c, n in zip(G.scale_box(G.Box.of(), 0.4), ("left_x", "top_y", "right_x", "bottom_y"), strict=True)]
    return L.fit_area(i.select("*", *ocr))


PRE = "(values ('rect', 0.55, 0.80, 0.78, 1.8, 1.5, 5.5), ('mild', 0.75, 0.62, 0.55, 2.5, 2.0, 5.0), ('ellipse', 0.85, 0.55, 0.45, 2.8, 2.2, 5.0), ('tapered', 0.90, 0.50, 0.40, 3.0, 2.5, 4.8)) p(preset, a, m, b, s, c, h)"


@query("p14_layout_profile", f"""with {INPUTS}, x as (select *, source like 'bbox_fallback%' as fb, greatest(1.0, right_x - left_x) as bw, greatest(1.0, bottom_y - top_y) as bh, greatest(1.0, core_right_x - core_left_x) * greatest(1.0, core_bottom_y - core_top_y) as ca from li),
    y as (select *, case when class = 'rectangle' then 'rect' when class in ('thorn', 'cloude', 'sea_uchirin') then 'tapered' when not fb then case when ca / (bw * bh) >= 0.62 or bw / bh >= 1.40 then 'rect' when ca / (bw * bh) <= 0.44 then 'tapered' else 'ellipse' end when class = 'elipse' then 'ellipse' else 'mild' end as preset from x),
    z as (select bubble_id, preset, fb, bh / bw >= 1.35 and preset in ('ellipse', 'tapered') as tall, a::double as a, m::double as m, b::double as b, s::double as s, c::double as c, h::double as h from y join {PRE} using (preset))
    select bubble_id, preset, greatest(0.0, least(0.95::double, (a + case when tall then 0.05::double else 0 end) * case when fb then 0.96::double else 1 end)) as alpha, greatest(0.45::double, least(1.0, m - case when tall then 0.03::double else 0 end + case when fb then 0.02::double else 0 end)) as min_factor,
      b + case when fb then 0.06::double else 0 end as line_break_penalty, s * case when fb then 0.92::double else 1 end as shape_penalty, c * case when fb then 0.92::double else 1 end as center_peak_penalty, (h + case when fb then 0.30::double else 0 end) * 0.58::double as hyphen_break_penalty from z""")
def _(v):
    return L.layout_profile(_inputs(v))


@query("p15_font_cap", "select bubble_id, least(20 + bubble_id % 40, 16 + floor((greatest(16, least(52, round_even(font_est_px * 1.25, 0))) - 16) / 2) * 2)::int as font_pt from bubbles")
def _(v):
    return L.font_cap(v.bubbles.withColumn("best_pt", 20 + F.col("bubble_id") % 40))


@query("j12_choose_font", """with m as (select * from (values ('thorn', 'spiky'), ('cloude', 'soft'), ('rectangle', 'mono')) c(cls_name, font)), b as (select bubble_id, cls_name, conf, case when bubble_id % 3 = 0 then null else conf >= 0.5 end as definite from bubbles)
    select bubble_id, case when bubble_id % 17 = 0 then 'own' when m.font is not null and coalesce(definite, conf >= 0.6, true) then m.font else 'base' end as font from b left join m using (cls_name)""")
def _(v):
    b = v.bubbles.select("bubble_id", F.col("cls_name").alias("class"), F.col("conf").alias("confidence"), F.when(F.col("bubble_id") % 3 != 0, F.col("conf") >= 0.5).alias("definite"))
    classes = v.spark.createDataFrame([("thorn", "spiky"), ("cloude", "soft"), ("rectangle", "mono")], "class string, font string")
    return L.choose_font(b, b.where("bubble_id % 17 = 0").select("bubble_id", F.lit("own").alias("font")), classes, "base")


@query("a30_max_font", """with l as (select doc_id as bubble_id, coalesce(text, '') as text, 400.0 + doc_id % 900 as bw, 300.0 + doc_id % 2500 as bh from documents), c as (select bubble_id, unnest(string_split(text, '')) as ch from l), n as (select bubble_id, ch, count(*) as n from c group by 1, 2),
    e as (select bubble_id, sum(n * case ch when 'e' then 500000 when 'i' then 250000 when ' ' then 300000 else 600000 end)::bigint / 1000000::double as em from n group by 1),
    f as (select bubble_id, pt, greatest(1, ceil(coalesce(em, 0) * pt / bw)) * pt * 1.2::double <= bh as fits from l left join e using (bubble_id), unnest(range(16, 53, 2)) as u(pt)) select bubble_id, coalesce(max(pt) filter (fits), 16)::int as font_pt from f group by 1""")
def max_font(v):
    layout = v.documents.select(F.col("doc_id").alias("bubble_id"), "text", (400.0 + F.col("doc_id") % 900).alias("box_w"), (300.0 + F.col("doc_id") % 2500).alias("box_h"))
    return L.max_font(layout, v.spark.createDataFrame([("e", 0.5), ("i", 0.25), (" ", 0.3)], "ch string, em double"))


#: Words in a block of the quality queries.
BLOCK_WORDS = 12


def _quality(v):
    """Every run of BLOCK_WORDS words of a text is a block, named by the document and its number; each word is in one block."""
    run = rf"\G([^ ]*(?: [^ ]*){{0,{BLOCK_WORDS - 1}}})(?: |\z)"
    runs = F.regexp_extract_all("text", F.lit(run), F.lit(1))
    # a text that ends with a whole block gives an empty match after it
    count = F.ceil((F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1) / BLOCK_WORDS).cast("int")
    rows = v.documents.select("doc_id", F.col("lang").alias("class"), F.posexplode_outer(F.slice(runs, 1, count)).alias("block", "run"))
    n = (2 + F.col("doc_id") % 4).cast("int")
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / n).cast("int") - 1), lambda i: F.array_join(F.slice(w, i * n + 1, n), " "))
    lines = G.let(F.split("run", " "), cut)
    blocks = rows.select(F.concat_ws(":", "doc_id", "block").alias("bubble_id"), "class", lines.alias("lines")).withColumn("widths", F.transform("lines", lambda s: F.length(s) * 7.5))
    return L.layout_quality(blocks)


def _shape(w: str, tol: float, hard: str, soft: str, edge: str, shift: str) -> str:
    """Shape terms of the list of widths w as columns; null for up to two widths, where they don't count."""
    a, b, up, n = f"{w}[i]", f"{w}[i + 1]", f"(i - 0.5 < (len({w}) - 1) / 2.0)", f"len({w})"
    slack = f"greatest(2.0::double, greatest({a}, {b}) * {tol}::double)"
    fall = lambda least, k: f"list_sum([case when {up} and {b} < {a} then ({a} - {b}) / greatest({least}::double, {a}) * {k}::double when not {up} and {b} > {a} then ({b} - {a}) / greatest({least}::double, {b}) * {k}::double else 0 end for i in range(1, {n})])"
    return f"""list_sum([case when {up} then {b} - {a} < -{slack} else {b} - {a} > {slack} end::int for i in range(1, {n})]) as {hard}, {fall(10, 1)} as {soft}, {fall(12, 8)} as {soft}_seq,
    greatest({w}[1], {w}[-1]) / greatest(1.0::double, list_max({w})) as {edge}, abs(list_position({w}, list_max({w})) - 1 - ({n} - 1) / 2.0::double) as {shift}"""


def _shape_sums(n: str, hard: str, soft: str, edge: str, shift: str) -> str:
    limit = f"case {n} when 3 then 1.01::double when 4 then 0.95::double else 0.92::double end"
    return f"""case when {n} <= 2 then 0 else {hard} + ({edge} > {limit})::int end::double as {hard}_all, case when {n} <= 2 then 0 else {soft} + greatest(0.0::double, {edge} - ({limit} - 0.10::double)) * 4.0::double + {shift} * 0.60::double end as {soft}_all"""


#: Blocks of the quality queries, their lines' shapes in pixels (p) and in characters (c), and what ends in a hyphen or is tiny.
QUALITY = rf"""wd as (select doc_id, lang as class, string_split(text, ' ') as w, (2 + doc_id % 4)::int as n from documents),
    bl as (select doc_id, class, b, n, w[{BLOCK_WORDS} * b + 1:{BLOCK_WORDS} * b + {BLOCK_WORDS}] as w from wd, unnest(range(0, (len(w) + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})) as u(b)),
    ln as (select doc_id || ':' || b as bubble_id, class, [array_to_string(w[i * n + 1:i * n + n], ' ') for i in range(0, (len(w) + n - 1) // n)] as lines from bl),
    tr as (select *, [trim(s, ' ') for s in lines] as t, [length(s) * 7.5::double for s in lines] as wp from ln),
    nt as (select *, [{norm_token('s')} for s in t] as norm, [length(regexp_replace(s, '\s+', '', 'g'))::double for s in t] as wc, [s[-1:] = '-' for s in t] as broken,
      [length({norm_token("string_split(regexp_replace(s, '-$', ''), ' ')[-1]")}) for s in t] as piece, len(list_filter(regexp_split_to_array(array_to_string(t, ' '), '\s+'), lambda x: x <> '')) as nw from tr),
    st as (select *, coalesce(len(t) >= 2 and broken[1] and length({norm_token("regexp_replace(t[1], '-+$', '')")}) <= 2 and norm[2] <> '', false) as stutter, {_shape('wp', 0.04, 'hp', 'sp', 'ep', 'fp')}, {_shape('wc', 0.07, 'hc', 'sc', 'ec', 'fc')} from nt),
    ct as (select *, len([i for i in range(1, len(t)) if length(norm[i]) <= 2 and not (stutter and i = 1)]) as tiny, len([i for i in range(1, len(t) + 1) if broken[i] and piece[i] <= 3 and not (stutter and i = 1)]) as short, len([x for x in broken if x])::int as hyphens,
      {_shape_sums('len(wp)', 'hp', 'sp', 'ep', 'fp')}, {_shape_sums('len(wc)', 'hc', 'sc', 'ec', 'fc')}, list_max(wc) as peak, greatest(wc[1], wc[-1]) as rim, len(wc) // 2 as half,
      case when len(wc) % 2 = 1 then wc[len(wc) // 2 + 1] else greatest(wc[len(wc) // 2], wc[len(wc) // 2 + 1]) end as middle from st),
    pn as (select *, case when len(wc) <= 2 then 0 else sc_seq + case when peak > 0 and rim > peak * 0.95::double then (rim / peak - 0.95::double) * 12.0::double else 0 end end as seq,
      case when len(wc) <= 2 then 0 else fc * 2.4::double + case when middle > 0 and rim >= middle then (rim - middle) / greatest(12.0::double, middle) * case when len(wc) % 2 = 1 then 18.0::double else 14.0::double end else 0 end + abs(wc[1] - wc[-1]) / greatest(12.0::double, rim) * 3.0::double end as flat from ct),
    ql as (select bubble_id, class, hp_all as hard, sp_all as soft, hyphens * case when nw <= 2 then 0.6::double when nw <= 4 then 0.9::double else 1.2::double end + short * case when nw <= 2 then 2.2::double when nw <= 4 then 1.8::double else 2.4::double end
      + tiny * 2.0::double + hc_all * 4.5::double + sc_all * 1.8::double + seq * 0.55::double + flat * 0.45::double as badness, hyphens from pn)"""


@query("a32_f14_f16_layout_quality", f"with {QUALITY} select * from ql")
def _(v):
    return _quality(v)


@query("a32_quality_by_class", f"with {QUALITY} select class, count(*) as n, avg(hard) as hard, avg(soft) as soft, avg(badness) as badness, avg(hyphens) as hyphens from ql group by 1")
def _(v):
    return L.quality_by_class(_quality(v))
