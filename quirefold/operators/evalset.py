"""Evaluation and training datasets: pairing, sharding, statistics, sampling, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.bins import bin_index, bin_label
from quirefold.functions.geometry import ceil_modulo


def pair_files(listing: DataFrame) -> DataFrame:
    """(path) -> mask, image, prediction, status.

    A mask is a .png with ``_mask`` in its name; its image has the name before the last ``_mask`` under
    ``img``, its prediction the mask's stem with ``_inpainted.jpg`` under ``pred``. A side that isn't
    listed is null and named in the status. Repeated paths count once.
    """
    paths = listing.select("path").distinct()
    mask = paths.where(F.rlike("path", F.lit(r"/mask/[^/]*_mask[^/]*\.png$")))
    stem = F.regexp_extract("path", r"([^/]*)\.png$", 1)
    root = F.regexp_extract("path", r"^(.*)/mask/", 1)
    image = F.concat(root, F.lit("/img/"), F.regexp_replace(stem, "_mask(?!.*_mask).*$", ""), F.lit(".png"))
    want = mask.select(F.col("path").alias("mask"), image.alias("want_image"), F.concat(root, F.lit("/pred/"), stem, F.lit("_inpainted.jpg")).alias("want_pred"))
    out = want.join(paths.withColumnRenamed("path", "image"), F.col("want_image") == F.col("image"), "left")
    out = out.join(paths.withColumnRenamed("path", "prediction"), F.col("want_pred") == F.col("prediction"), "left")
    status = F.when(F.col("image").isNull() & F.col("prediction").isNull(), "no_image_no_prediction").when(F.col("image").isNull(), "no_image")
    return out.select("mask", "image", "prediction", status.when(F.col("prediction").isNull(), "no_prediction").otherwise("ok").alias("status"))


def pair_files_by_parts(listing: DataFrame) -> DataFrame:
    """The second layout: the image's name is the mask's without its last ``_`` part -> mask, image (may be null)."""
    paths = listing.select("path").distinct()
    mask = paths.where(F.rlike("path", F.lit("/mask/")))
    want = F.concat(F.regexp_extract("path", "^(.*)/mask/", 1), F.lit("/img/"), F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "_[^_]*$", ""), F.lit(".png"))
    both = mask.select(F.col("path").alias("mask"), want.alias("want"))
    return both.join(paths.withColumnRenamed("path", "image"), F.col("want") == F.col("image"), "left").select("mask", "image")


def pair_labels(images: DataFrame, from_root: str, to_root: str) -> DataFrame:
    """(path) -> path, label_path: the same place under another root; null where the root differs."""
    rest = F.expr(f"substring(path, {len(from_root) + 1})")
    return images.select("path", F.when(F.col("path").startswith(from_root), F.concat(F.lit(to_root), rest)).alias("label_path"))


def in_categories(key: Column, categories: list[str]) -> Column:
    """Whether the key contains any of the categories; ``nofilter`` among them lets all pass."""
    if "nofilter" in categories:
        return F.lit(True)
    out = F.lit(False)
    for c in categories:
        out = out | F.contains(key, F.lit(c))
    return F.coalesce(out, F.lit(False))


def reshard(records: DataFrame, key: str, categories: list[str], shards: int, seed: int) -> DataFrame:
    """Records of the categories with the output shard that each goes to, by the md5 of seed and key."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return records.where(in_categories(F.col(key), categories)).withColumn("shard", (drawn % shards).cast("int"))


def filter_counts(records: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """One row: how many records pass the filter and how many don't."""
    good = in_categories(F.col(key), categories)
    return records.agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))


def dataset_stats(samples: DataFrame) -> DataFrame:
    """(h, w, hole_area, dist) -> one row of least, largest and mean values, and the median distance."""
    cols = {"h": F.col("h"), "w": F.col("w"), "area": F.col("h") * F.col("w"), "hole_area": F.col("hole_area"), "hole_pct": 100.0 * F.col("hole_area") / (F.col("h") * F.col("w")), "dist": F.col("dist")}
    aggs = [f(c.cast("double")).alias(f"{n}_{k}") for n, c in cols.items() for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return samples.agg(F.count("*").alias("n"), *aggs, F.median("dist").alias("dist_median"))


def area_bins(samples: DataFrame, bins: int = 10) -> DataFrame:
    """(hole_frac) -> bin, label, n, share for every bin, also empty ones. An edge closes the bin before it."""
    spark = samples.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    counted = samples.where("hole_frac is not null").groupBy(bin_index(F.col("hole_frac"), bins, "left").alias("bin")).agg(F.count("*").alias("n"))
    out = every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per bin
    return out.select("bin", bin_label(F.col("bin"), bins).alias("label"), "n", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("share"))


def hash_order(key: Column, seed: int) -> Column:
    """A seeded order that SQL engines share: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each stratum, drawn by the seeded hash order of key (ties by key)."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key))
    return df.withColumn("rank_", rank).where(F.col("rank_") <= n).drop("rank_")


def cap_per_key(df: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """At most k rows per group, drawn as in stratified."""
    return stratified(df, group, key, k, seed)


def shared_subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most n distinct keys, the same for every set that holds them."""
    return df.select(key).distinct().orderBy(hash_order(F.col(key), seed), key).limit(n)


def compare_models(sets: dict[str, DataFrame], max_n: int | None = None, seed: int = 0) -> DataFrame:
    """{name: (sample_id, value)} -> sample_id and a column per model. The sets must have equal sizes."""
    sizes = {name: df.count() for name, df in sets.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"sets differ in size: {sizes}")
    out = None
    for name, df in sets.items():
        one = df.select("sample_id", F.col("value").alias(name))
        out = one if out is None else out.join(one, "sample_id")
    return out if max_n is None else out.join(shared_subset(out, "sample_id", max_n, seed), "sample_id", "left_semi")


def resize_plan(images: DataFrame, out_min: int, small_mode: str = "drop") -> DataFrame:
    """(image_id, w, h) -> image_id, factor, out_w, out_h: the shorter side becomes out_min.

    Smaller images are dropped, or scaled up with ``upscale``.
    """
    short = F.least("w", "h")
    factor = out_min / short.cast("double")
    rows = images.where(short > 0)
    rows = rows.where(short >= out_min) if small_mode == "drop" else rows
    return rows.select("image_id", factor.alias("factor"), F.bround(F.col("w") * factor, 0).cast("long").alias("out_w"), F.bround(F.col("h") * factor, 0).cast("long").alias("out_h"))


def padded_size(images: DataFrame, mod: int = 8) -> DataFrame:
    """(image_id, w, h) -> sizes raised to a multiple of mod, and the padding."""
    w, h = ceil_modulo(F.col("w"), mod), ceil_modulo(F.col("h"), mod)
    return images.select("image_id", w.alias("pad_w"), h.alias("pad_h"), (w - F.col("w")).cast("long").alias("add_w"), (h - F.col("h")).cast("long").alias("add_h"))


def unique_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Adds unique_name: the first row of a name keeps it, later ones get _0001, _0002, ... ``item`` if empty."""
    base = F.when(F.coalesce(F.trim(name), F.lit("")) == "", "item").otherwise(F.col(name))
    rank = F.row_number().over(Window.partitionBy("base_").orderBy(*order)) - 1
    out = df.withColumn("base_", base).withColumn("rank_", rank)
    return out.withColumn("unique_name", F.when(F.col("rank_") > 0, F.format_string("%s_%04d", "base_", "rank_")).otherwise(F.col("base_"))).drop("base_", "rank_")
