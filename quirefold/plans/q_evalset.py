"""Queries on datasets: pairing, statistics, sampling, resizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.operators import evalset as E

from .q_metrics import bin_sql
from .registry import query


@query("src5_pair_files", r"""with p as (select distinct path from listing), m as (select path as mask, regexp_extract(path, '([^/]*)\.png$', 1) as stem, regexp_extract(path, '^(.*)/mask/', 1) as root from p where regexp_matches(path, '/mask/[^/]*_mask[^/]*\.png$')),
    w as (select mask, root || '/img/' || regexp_extract(stem, '^(.*)_mask', 1) || '.png' as wi, root || '/pred/' || stem || '_inpainted.jpg' as wp from m)
    select mask, i.path as image, q.path as prediction, case when i.path is null and q.path is null then 'no_image_no_prediction' when i.path is null then 'no_image' when q.path is null then 'no_prediction' else 'ok' end as status
    from w left join p i on wi = i.path left join p q on wp = q.path""")
def _(v):
    return E.pair_files(v.listing)


@query("src5_pair_by_parts", r"""with p as (select distinct path from listing), w as (select path as mask, regexp_extract(path, '^(.*)/mask/', 1) || '/img/' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '_[^_]*$', '') || '.png' as wi from p where contains(path, '/mask/'))
    select mask, i.path as image from w left join p i on wi = i.path""")
def _(v):
    return E.pair_files_by_parts(v.listing)


@query("j19_pair_labels", "select path, case when starts_with(path, 'root/img/') then 'labels/' || substr(path, 10) end as label_path from listing")
def _(v):
    return E.pair_labels(v.listing, "root/img/", "labels/")


@query("src6_filter_shards", "select doc_id, source from documents where contains(source, 'src1') or contains(source, '7')")
def _(v):
    return E.reshard(v.documents.select("doc_id", "source"), "source", ["src1", "7"], 16, 3).drop("shard")


@query("src6_filter_counts", "select count(*) filter (contains(source, 'src1')) as good, count(*) filter (not contains(source, 'src1')) as bad from documents")
def _(v):
    return E.filter_counts(v.documents, "source", ["src1"])


@query("src6_reshard", "select doc_id, source, (('0x' || substr(md5('3:' || source), 1, 8))::bigint % 16)::int as shard from documents")
def _(v):
    return E.reshard(v.documents.select("doc_id", "source"), "source", ["nofilter"], 16, 3)


@query("a6_dataset_stats", "with s as (select h, w, floor(h * w * hole_frac) as hole_area, lpips * 50 as dist from eval_samples) select count(*) as n, " + ", ".join(
    f"{f}(({e})::double) as {n}_{k}" for n, e in (("h", "h"), ("w", "w"), ("area", "h * w"), ("hole_area", "hole_area"), ("hole_pct", "100.0::double * hole_area / (h * w)"), ("dist", "dist")) for k, f in (("min", "min"), ("max", "max"), ("mean", "avg"))
) + ", median(dist) as dist_median from s")
def _(v):
    return E.dataset_stats(v.eval_samples.select("h", "w", F.floor(F.col("h") * F.col("w") * F.col("hole_frac")).alias("hole_area"), (F.col("lpips") * 50).alias("dist")))


@query("a7_area_bins", f"""with c as (select {bin_sql('hole_frac', 'left')} as bin, count(*) as n from eval_samples group by 1)
    select b::int as bin, (b * 10)::varchar || '-' || (b * 10 + 10)::varchar || '%' as label, coalesce(n, 0) as n, coalesce(n, 0) / (sum(n) over ())::double as share from range(10) r(b) left join c on c.bin = b""")
def area_bins(v):
    return E.area_bins(v.eval_samples)


@query("w14_stratified", f"""with b as (select sample_id, {bin_sql('hole_frac', 'left')} as bin from eval_samples), r as (select *, row_number() over (partition by bin order by md5('11:' || sample_id::varchar), sample_id) as rn from b) select sample_id, bin from r where rn <= 5""")
def _(v):
    from quirefold.functions.bins import bin_index

    b = v.eval_samples.select("sample_id", bin_index(F.col("hole_frac"), side="left").alias("bin"))
    return E.stratified(b, "bin", "sample_id", 5, 11)


@query("w15_cap_masks", "with r as (select sample_id, image_id, row_number() over (partition by image_id order by md5('5:' || sample_id::varchar), sample_id) as rn from eval_samples) select sample_id, image_id from r where rn <= 3")
def _(v):
    return E.cap_per_key(v.eval_samples.select("sample_id", "image_id"), "image_id", "sample_id", 3, 5)


@query("t5_shared_subset", "select sample_id from (select distinct sample_id from eval_samples) s order by md5('9:' || sample_id::varchar), sample_id limit 200")
def _(v):
    return E.shared_subset(v.eval_samples, "sample_id", 200, 9)


@query("p18_padded_size", "select image_id, (ceil(w / 48) * 48)::bigint as pad_w, (ceil(h / 48) * 48)::bigint as pad_h, (ceil(w / 48) * 48 - w)::bigint as add_w, (ceil(h / 48) * 48 - h)::bigint as add_h from images")
def _(v):
    return E.padded_size(v.images, 48)


RESIZE = "select image_id, 300.0::double / least(w, h) as factor, round_even(w * (300.0::double / least(w, h)), 0)::bigint as out_w, round_even(h * (300.0::double / least(w, h)), 0)::bigint as out_h from images"


@query("p19_resize_drop", f"{RESIZE} where least(w, h) >= 300")
def _(v):
    return E.resize_plan(v.images, 300)


@query("p19_resize_upscale", RESIZE)
def _(v):
    return E.resize_plan(v.images, 300, "upscale")


@query("w13_unique_names", """with b as (select o_orderkey as id, case when o_orderkey % 11 = 0 then 'item' else 'n' || (o_custkey % 50)::varchar end as base from orders), r as (select *, row_number() over (partition by base order by id) - 1 as rn from b)
    select id, case when rn > 0 then base || '_' || case when rn < 10000 then lpad(rn::varchar, 4, '0') else rn::varchar end else base end as unique_name from r""")
def _(v):
    n = v.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.concat(F.lit("n"), (F.col("o_custkey") % 50).cast("string"))).alias("name"))
    return E.unique_names(n, "name", ["id"]).select("id", "unique_name")


@query("u3_union_sets", "select sample_id, ssim, 'a' as part from eval_samples where sample_id % 2 = 0 union all select sample_id, ssim, 'b' from eval_samples where sample_id % 3 = 0")
def _(v):
    s = v.eval_samples.select("sample_id", "ssim")
    return s.where("sample_id % 2 = 0").withColumn("part", F.lit("a")).unionByName(s.where("sample_id % 3 = 0").withColumn("part", F.lit("b")))
