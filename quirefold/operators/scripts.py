"""Script lines: style prefixes, numbering, page sections; bubble scripts in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import plain_quotes, plain_spaces

PAGE = r"(?i)Page [0-9]+"
HEADER = r"^\s*\[(B[0-9]+)\]\s*$"


def _without_first(text: Column, part: Column) -> Column:
    """text without the first occurrence of part."""
    at = F.position(part, text)
    cut = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))
    return F.when((F.length(part) > 0) & (at > 0), cut).otherwise(text)


def match_styles(lines: DataFrame, prefixes: DataFrame, current_first: bool = True, current_folder: str | None = None) -> DataFrame:
    """lines(page_id, line_no, raw_text), prefixes(prefix, style_id, folder, ord) -> page_id, line_no, prefix, style_id.

    The first prefix in order of tier and ord that the line starts with. Tiers: the current folder's
    prefixes, then all; or unfoldered, foldered, all. Prefixes are a small table that users keep by
    hand, and are broadcast; the join is on the first character, so that no line meets all of them.
    """
    here = F.col("folder").eqNullSafe(F.lit(current_folder))
    tier = F.when(here, 0).otherwise(1) if current_first else F.when(F.col("folder").isNull(), 0).otherwise(1)
    p = prefixes.where(F.length("prefix") > 0).select("prefix", "style_id", tier.alias("tier"), "ord", F.substring("prefix", 1, 1).alias("head"))
    some = lines.withColumn("head", F.substring("raw_text", 1, 1)).join(F.broadcast(p), "head").where(F.startswith("raw_text", "prefix"))
    best = some.groupBy("page_id", "line_no").agg(F.min(F.struct("tier", "ord", "prefix", "style_id")).alias("m"))
    return best.select("page_id", "line_no", F.col("m.prefix").alias("prefix"), F.col("m.style_id").alias("style_id"))


def parse_lines(lines: DataFrame, prefixes: DataFrame, ignore_prefixes: list[str], tags: list[str], images: bool = True, **tiers) -> DataFrame:
    """Parsed script lines: page_id, line_no, text, style_id, ignore, index, section, last.

    ``//`` and ``//:`` lines take the style of the last line before them that is not ignored and has one.
    Lines with an ignore prefix, without text, or with a page marker are ignored and have index 0;
    the others are counted. section counts page markers so far. last marks, with images, the last
    counted line before a marker.
    """
    found = match_styles(lines, prefixes, **tiers)
    rows = lines.join(found, ["page_id", "line_no"], "left")
    raw = F.coalesce(F.col("raw_text"), F.lit(""))
    ignored = F.lit("")
    for p in reversed(ignore_prefixes):
        ignored = F.when(F.startswith(raw, F.lit(p)), F.lit(p)).otherwise(ignored)
    follow = F.startswith(raw, F.lit("//"))
    prefix = F.when(F.startswith(raw, F.lit("//:")), "//:").when(follow, "//").otherwise(F.coalesce("prefix", F.lit("")))
    text = _without_first(_without_first(raw, ignored), prefix)
    for t in tags:
        if t:
            text = F.replace(text, F.lit(t), F.lit(""))
    text = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    rows = rows.select("page_id", "line_no", ignored.alias("ign"), follow.alias("follow"), text.alias("text"), F.when(~follow, F.col("style_id")).alias("own"), F.rlike(raw, F.lit(PAGE)).alias("is_page"))
    rows = rows.withColumn("ignore", (F.col("ign") != "") | (F.col("text") == "") | F.col("is_page"))
    order = Window.partitionBy("page_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a following line has the style it takes, so the last styled line is the last with a style of its own that isn't ignored
    taken = F.last(F.when(~F.col("ignore") & ~F.col("follow"), F.col("own")), ignorenulls=True).over(before)
    rows = rows.withColumns(
        {
            "style_id": F.when(F.col("follow"), taken).otherwise(F.col("own")),
            "index": F.when(F.col("ignore"), 0).otherwise(F.sum(F.when(F.col("ignore"), 0).otherwise(1)).over(order)),
            "section": F.sum(F.col("is_page").cast("long")).over(order),
        }
    )
    counted = F.max("index").over(Window.partitionBy("page_id", "section"))
    # a section that isn't the page's last one ends at a marker
    ends = F.col("section") < F.max("section").over(Window.partitionBy("page_id"))
    last = F.lit(images) & ends & (F.col("index") > 0) & (F.col("index") == counted)
    return rows.select("page_id", "line_no", "text", "style_id", "ignore", F.col("index").cast("long").alias("index"), "section", last.alias("last"))


def next_pages(parsed: DataFrame) -> DataFrame:
    """parse_lines -> page_id, section, next_line: the first counted line of the following sections that have one."""
    first = parsed.where(~F.col("ignore")).groupBy("page_id", "section").agg(F.min("line_no").alias("first_line"))
    every = parsed.groupBy("page_id", "section").agg(F.min("line_no").alias("at")).join(first, ["page_id", "section"], "left")
    order = Window.partitionBy("page_id").orderBy("section")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    return every.select("page_id", "section", F.first("first_line", ignorenulls=True).over(after).alias("next_line"))


def parse_script(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, raw) -> doc_id, bubble_id, text: bodies under ``[B1]`` headers, trimmed, quotes made plain.

    Lines before the first header go; of repeated headers the last one counts.
    """
    raw = plain_spaces(F.coalesce(F.col("raw"), F.lit("")))
    rows = lines.select("doc_id", "line_no", raw.alias("raw"), F.regexp_extract(raw, HEADER, 1).alias("head"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("part", F.sum((F.col("head") != "").cast("long")).over(order)).where("part > 0")
    body = F.array_sort(F.collect_list(F.when(F.col("head") == "", F.struct("line_no", "raw"))))
    parts = rows.groupBy("doc_id", "part").agg(F.max("head").alias("bubble_id"), F.array_join(F.transform(body, lambda x: x["raw"]), "\n").alias("text"))
    last = parts.groupBy("doc_id", "bubble_id").agg(F.max_by("text", "part").alias("text"))
    return last.select("doc_id", "bubble_id", plain_quotes(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text"))


def export_script(texts: DataFrame) -> DataFrame:
    """(doc_id, bubble_id, text) -> doc_id, script: bubbles in string order as header, body, blank line; empty text is dots."""
    body = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("....."))
    piece = F.struct(F.col("bubble_id").cast("string").alias("id"), F.concat(F.lit("["), F.col("bubble_id").cast("string"), F.lit("]\n"), body, F.lit("\n")).alias("t"))
    return texts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "\n").alias("script"))


def script_lines(files: DataFrame) -> DataFrame:
    """(doc_id, value) whole files -> doc_id, line_no, raw."""
    return files.select("doc_id", F.posexplode(F.split(plain_spaces(F.col("value")), "\n")).alias("line_no", "raw"))


def read_scripts(spark, path: str) -> DataFrame:
    """Text files -> doc_id (the path), line_no, raw."""
    return script_lines(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value"))
