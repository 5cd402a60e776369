"""Job documents as tables: latest progress, status transitions, patches, scalar logs, batch runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.bins import percent
from quirefold.functions.geometry import Box, clip_box
from quirefold.functions.text import chapter_no, safe_name

# The states of a job in order.
STATES = ("created", "detect_bubbles_running", "await_edit", "await_ocr_clean", "ocr_clean_running", "await_translation")

#: Tags: a set and a title.
TAG = r"(?i)^(train|test|val|extra_val_.*?(?:256|512))_(.*)$"


def latest_progress(events: DataFrame) -> DataFrame:
    """(job_id, ts, event_id, phase, done, total) -> the last event of each job and its percentage; batch or stream."""
    last = F.max_by(F.struct("phase", "done", "total"), F.struct("ts", "event_id")).alias("p")
    out = events.groupBy("job_id").agg(last)
    return out.select("job_id", "p.phase", "p.done", "p.total", percent(F.col("p.done"), F.col("p.total")).alias("pct"))


def patch_progress(events: DataFrame) -> DataFrame:
    """(job_id, item, ts, event_id, done, total, status) -> per job: items, finished items, failed items, percentage."""
    last = events.groupBy("job_id", "item").agg(F.max_by(F.struct("done", "total", "status"), F.struct("ts", "event_id")).alias("p"))
    out = last.groupBy("job_id").agg(
        F.count("*").alias("items"), F.count_if(F.col("p.done") >= F.col("p.total")).alias("finished"), F.count_if(F.col("p.status") == "error").alias("failed")
    )
    return out.withColumn("pct", percent(F.col("finished"), F.col("items")))


def valid_transition(prev: Column, cur: Column) -> Column:
    """A job starts as created, goes one state on, stays, or fails; after an error only an error follows."""
    ok = F.when(prev.isNull(), cur == STATES[0])
    for a, b in zip(STATES, STATES[1:], strict=False):
        ok = ok.when(prev == a, cur.isin(a, b, "error"))
    ok = ok.when(prev == STATES[-1], cur.isin(STATES[-1], "error"))
    return F.coalesce(ok.otherwise(cur == "error"), F.lit(False))


def transitions(status: DataFrame) -> DataFrame:
    """(job_id, ts, event_id, status) -> job_id, event_id, prev, cur, valid, in order of (ts, event_id)."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    rows = status.withColumn("prev", F.lag("status").over(order))
    return rows.select("job_id", "event_id", "prev", F.col("status").alias("cur"), valid_transition(F.col("prev"), F.col("status")).alias("valid"))


def regroup(scalars: DataFrame) -> DataFrame:
    """(run_id, tag, step, wall_time, value) -> run, set and title of the tag; tags ending in _std or without a set go. Batch or stream."""
    rows = scalars.where(~F.endswith("tag", F.lit("_std")) & F.rlike("tag", F.lit(TAG)))
    part = lambda i: F.regexp_extract("tag", TAG, i)
    return rows.select("run_id", F.lower(part(1)).alias("grp"), part(2).alias("title"), "step", "wall_time", "value")


def ignored_tags(scalars: DataFrame) -> DataFrame:
    """Each tag once that regroup leaves out for want of a set."""
    return scalars.where(~F.endswith("tag", F.lit("_std")) & ~F.rlike("tag", F.lit(TAG))).select("tag").distinct()


def discover_chapters(manifest: DataFrame) -> DataFrame:
    """(folder) -> distinct folders named ch* or chapter*, with their number (0 without one) and place in that order."""
    found = manifest.where(F.rlike("folder", F.lit("^ch"))).select("folder").distinct()
    return found.select("folder", F.coalesce(chapter_no(F.col("folder")), F.lit(0)).alias("number"))


def chapter_range(chapters: DataFrame, start: int, stop: int) -> DataFrame:
    """Chapters with a number from start to stop; folders without digits stay."""
    n = chapter_no(F.col("folder"))
    return chapters.where(n.isNull() | n.between(start, stop))


def skipped_count(chapters: DataFrame, start: int, stop: int) -> DataFrame:
    n = chapter_no(F.col("folder"))
    skip = F.coalesce(~n.between(start, stop), F.lit(False))
    return chapters.agg(F.count("*").alias("total"), F.count_if(skip).alias("skipped"), F.count_if(~skip).alias("kept"))


def choose_originals(manifest: DataFrame) -> DataFrame:
    """(folder, file_name) -> folder, file, status, target: the original page image of each folder.

    Candidates are .png in any case whose stem has neither ``_cleaned`` nor ``frame_``. None: error.
    Several: the only one with ``_original``, else error. A single one is to be renamed to <folder>_original.png.
    """
    stem = F.lower(F.regexp_replace("file_name", r"\.[^.]*$", ""))
    cand = F.lower("file_name").endswith(".png") & ~F.contains(stem, F.lit("_cleaned")) & ~F.contains(stem, F.lit("frame_"))
    marked = cand & F.contains(stem, F.lit("_original"))
    g = manifest.groupBy("folder").agg(
        F.count_if(cand).alias("n"), F.count_if(marked).alias("m"), F.min(F.when(cand, F.col("file_name"))).alias("one"), F.min(F.when(marked, F.col("file_name"))).alias("orig")
    )
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "single").when(F.col("m") == 1, "marked").otherwise("ambiguous")
    file = F.when(F.col("n") == 1, F.col("one")).when((F.col("n") > 1) & (F.col("m") == 1), F.col("orig"))
    return g.select("folder", file.alias("file"), status.alias("status"), F.when(F.col("n") == 1, F.concat("folder", F.lit("_original.png"))).alias("target"))


def patch_plan(squares: DataFrame, page_dim: DataFrame) -> DataFrame:
    """squares(id, page_id, name, box) -> id, safe_id and the box in whole pixels of the page; repeated names get _%04d within a page."""
    rows = squares.join(page_dim.select("page_id", "width", "height"), "page_id").withColumn("base_", safe_name(F.col("name")))
    rank = F.row_number().over(Window.partitionBy("page_id", "base_").orderBy("id")) - 1
    rows = rows.withColumn("rank_", rank)
    box = clip_box(Box.of(), F.col("width"), F.col("height"))
    unique = F.when(F.col("rank_") > 0, F.format_string("%s_%04d", "base_", "rank_")).otherwise(F.col("base_"))
    return rows.select("id", unique.alias("safe_id"), *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


def drop_style_key(styles: Column, key: str) -> Column:
    """map<id, struct> without one field of every style."""
    return F.transform_values(styles, lambda _, s: s.dropFields(key))
