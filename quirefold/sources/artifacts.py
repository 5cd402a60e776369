"""JSON artifacts of a job: maps keyed by bubble on disk, tidy tables in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<left:double,top:double,right:double,bottom:double>"
#: Artifact -> the field that holds the map, and the type of its values.
ARTIFACTS = {
    "bubble_classes": ("classes", "struct<class:string,class_id:int,confidence:double,definite:boolean>"),
    "ocr_mask_stats": ("stats", f"struct<mask_area:bigint,bubble_area:double,ocr_bbox:{BOX},n_polys:bigint,cov:double,line_count:int,font_est_px:double>"),
    "bubble_geometry": ("items", f"struct<source:string,best_iou:double,seg_det_index:int,core_bbox:{BOX},poly_rel:array<array<double>>>"),
    "text_styles": ("styles", "struct<fill:struct<r:double,g:double,b:double>>"),
    "translation_fit": ("fit", f"struct<font_pt:int,layout_bbox:{BOX},layout_text:string>"),
}

OCR_SHAPES = ("array<struct<poly:array<array<double>>,text:string,prob:double>>", "struct<dt_polys:array<array<array<double>>>,rec_texts:array<string>,rec_scores:array<double>>")


def read_artifact(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Folders of one JSON document per job -> job_id (the document's, else its file's), bubble_id and the value's fields."""
    field, kind = ARTIFACTS[name]
    docs = spark.read.schema(f"schema_version int, job_id string, {field} map<string,{kind}>").json(path, multiLine=True)
    job = F.coalesce("job_id", F.regexp_extract(F.input_file_name(), r"([^/]*)/[^/]*$", 1))
    return docs.select(job.alias("job_id"), F.explode(field).alias("bubble_id", "v")).select("job_id", "bubble_id", "v.*")


def artifact_documents(tidy: DataFrame, name: str) -> DataFrame:
    """(job_id, bubble_id, fields) -> job_id, schema_version and the map, one row per job."""
    field, kind = ARTIFACTS[name]
    value = F.struct(*[F.col(c) for c in tidy.columns if c not in ("job_id", "bubble_id")])
    entries = F.array_sort(F.collect_list(F.struct(F.col("bubble_id").alias("key"), value.alias("value"))))
    return tidy.groupBy("job_id").agg(F.map_from_entries(entries).alias(field)).select("job_id", F.lit(1).alias("schema_version"), field)


def write_artifact(tidy: DataFrame, path: str, name: str) -> None:
    """One folder per job; jobs that are written replace their folder, others stay."""
    tidy.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    artifact_documents(tidy, name).write.mode("overwrite").partitionBy("job_id").json(path)


def normalise_ocr(json: Column) -> Column:
    """OCR results in either of two shapes -> array<struct<poly, text, conf>>; empty if neither fits."""
    one, two = F.from_json(json, OCR_SHAPES[0]), F.from_json(json, OCR_SHAPES[1])
    named = lambda p, t, c: F.struct(p.alias("poly"), t.alias("text"), c.alias("conf"))
    first = F.transform(one, lambda x: named(x["poly"], x["text"], x["prob"]))
    both = F.arrays_zip(two["dt_polys"].alias("p"), two["rec_texts"].alias("t"), two["rec_scores"].alias("c"))
    second = F.transform(both, lambda x: named(x["p"], x["t"], x["c"]))
    kind = "array<struct<poly:array<array<double>>,text:string,conf:double>>"
    listed = F.startswith(F.ltrim(json), F.lit("["))
    return F.coalesce(F.when(listed, first).otherwise(second), F.array().cast(kind))
