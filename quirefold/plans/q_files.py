"""Queries that write files and read them back: page files, shards, and streams over them.

Files go to the folder of the session's checkpoints. Pages are text files with a row of pixels a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.operators import evalset as E
from quirefold.session import scratch_path
from quirefold.sources import files as R
from quirefold.streaming import jobs as S

from .fixtures import VIEWS
from .q_scripts import PATCHES, REGROUPED, STATUS, TRANSITIONS, patch_events
from .registry import query


def _page_files(v, path: str, some: str = "true") -> None:
    """A text file for each page."""
    px = v.pixels.where(some).groupBy("page_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("px"))
    lines = px.select("page_id", "y", F.array_join(F.transform("px", lambda p: p["v"].cast("string")), " ").alias("line"))
    pages = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("lines"))
    content = F.concat(F.array_join("lines.line", "\n"), F.lit("\n"))
    R.write_files(pages.select(F.concat(F.lit("page_id="), F.col("page_id"), F.lit(".txt")).alias("name"), content.alias("content")), path)


def text_size(content: bytes) -> tuple[int, int]:
    """Width and height of a page file."""
    lines = content.decode().splitlines()
    return len(lines[0].split()), len(lines)


def _page(path: Column) -> Column:
    return F.regexp_extract(path, "page_id=([0-9]+)", 1).cast("long")


@query("src4_page_dims", "select page_id, max(x) + 1 as width, max(y) + 1 as height, null::varchar as error from pixels group by 1")
def _(v):
    path = scratch_path(v.spark)
    _page_files(v, path)
    return R.page_dims(v.spark, path, text_size, "*.txt").withColumn("page_id", _page(F.col("page_id")))


@query("src4_listing", "select page_id, count(*) as n_files, sum(n)::bigint as length from (select page_id, 1 as k, sum(length(v::varchar) + 1) as n from pixels group by 1) q group by 1")
def _(v):
    path = scratch_path(v.spark)
    _page_files(v, path)
    return R.list_files(v.spark, path, "*.txt").groupBy(_page(F.col("path")).alias("page_id")).agg(F.count("*").alias("n_files"), F.sum("length").alias("length"))


@query("src7_split_shard", "select doc_id, true as fits from documents")
def _(v):
    path, most = scratch_path(v.spark), 40
    R.split_shard(v.documents.select("doc_id", "lang"), path, most)
    rows = v.spark.read.parquet(path).select("doc_id", F.input_file_name().alias("file"))
    return rows.join(rows.groupBy("file").count(), "file").select("doc_id", (F.col("count") <= most).alias("fits"))


@query("src7_split_by_size", """with recursive d as (select doc_id % 8 as shard, doc_id, row_number() over (partition by doc_id % 8 order by doc_id) as i, coalesce(strlen(text), 0) as size from documents),
    g as (select shard, doc_id, i, 0::bigint as part, 1 as n, size as held, size from d where i = 1 union all
      select d.shard, d.doc_id, d.i, case when n + 1 > 40 or held + d.size > 60000 then part + 1 else part end, case when n + 1 > 40 or held + d.size > 60000 then 1 else n + 1 end, case when n + 1 > 40 or held + d.size > 60000 then d.size else held + d.size end, d.size
      from g join d on d.shard = g.shard and d.i = g.i + 1)
    select doc_id, shard, part, md5(text) as content, sum(size) over (partition by shard, part)::bigint as part_bytes, count(*) over (partition by shard, part) as part_records from g join documents using (doc_id)""")
def _(v):
    path = scratch_path(v.spark)
    rows = v.documents.select("doc_id", (F.col("doc_id") % 8).alias("shard"), "text", F.octet_length("text").alias("size"))
    R.split_shards(rows, path, "shard", ["doc_id"], "size", 40, 60_000)
    kept = v.spark.read.schema("doc_id long, text string, size int, shard long, part long").parquet(path)
    kept = kept.select("doc_id", "shard", "part", F.md5(F.col("text")).alias("content"), F.coalesce("size", F.lit(0)).alias("size"))
    part = Window.partitionBy("shard", "part")
    return kept.select("doc_id", "shard", "part", "content", F.sum("size").over(part).alias("part_bytes"), F.count("*").over(part).alias("part_records"))


@query("src6_written_shards", "select doc_id, (('0x' || substr(md5('3:' || doc_id), 1, 8))::bigint % 4)::int as shard from documents")
def _(v):
    path = scratch_path(v.spark)
    R.write_shards(E.reshard(v.documents.select("doc_id", "source"), "doc_id", ["nofilter"], 4, 3), path)
    return v.spark.read.parquet(path).select("doc_id", "shard")


def _appended(stream: DataFrame, path: str) -> None:
    """Runs a stream over what is there now into a folder of parquet files."""
    out = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()


#: How late the events of the streams below come, in microseconds, and how many runs bring them.
LATE, RUNS = 6 * 3600 * 10**6, 3


def _runs(v, events: DataFrame):
    """Writes events in files that come up to LATE after their time and in no order, with every seventh event again in the run after its own; yields before each run."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(LATE))
    first, last = events.agg(F.min(at), F.max(at)).first()
    if first is None:
        return
    dealt = events.withColumn("run", F.floor((at - first) * RUNS / (last - first + 1)))
    path = scratch_path(v.spark)
    for k in range(RUNS + 1):
        again = (F.col("run") == k - 1) & (F.col("event_id") % 7 == 0)
        rows = dealt.where((F.col("run") == k) | again).drop("run")
        if k == RUNS:  # time goes on: a job of no one has an event much later
            much_later = (F.lit(last) + 10 * LATE).cast("long")
            rows = rows.unionByName(events.limit(1).withColumns({"job_id": F.lit(-1).cast("long"), "ts": F.timestamp_micros(much_later).cast(events.schema["ts"].dataType)}))
        rows.repartition(F.xxhash64("event_id")).write.mode("append").parquet(f"{path}/files")
        yield S.read_events(v.spark, f"{path}/files", events.schema, 10**6)


@query("st2_invalid_transitions_stream", f"select job_id, event_id, prev, cur from ({TRANSITIONS}) q where not valid")
def _(v):
    path, out = scratch_path(v.spark), None
    for stream in _runs(v, v.events.select(F.col("user_id").alias("job_id"), "event_id", "ts", F.expr(STATUS).alias("status"))):
        out = S.invalid_transitions(stream, f"{LATE // 10**6} seconds")
        with S.state_store(v.spark):
            _appended(out, path)
    schema = out.schema if out else "job_id long, event_id long, prev string, cur string"
    return v.spark.read.schema(schema).parquet(f"{path}/rows")


@query("st5_patch_progress_stream", PATCHES)
def _(v):
    path, out = scratch_path(v.spark), None
    for stream in _runs(v, patch_events(v)):
        out = S.patch_progress(stream.where("job_id >= 0"))
        with S.state_store(v.spark):
            run = out.writeStream.foreachBatch(S.upsert(f"{path}/figures")).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
    return S.latest(v.spark, f"{path}/figures", out.schema, "job_id")


@query("st4_regroup_stream", REGROUPED)
def _(v):
    path = scratch_path(v.spark)
    # a file or a folder of files, whichever the table is
    events = S.read_events(v.spark, f"{v.sf_dir}/events.parquet*", v.events.schema)
    scalars = v.spark.sql(VIEWS["scalars"].replace("from events", "from {events}"), events=events)
    out = S.regroup(scalars)
    _appended(out, path)
    return v.spark.read.schema(out.schema).parquet(f"{path}/rows").drop("wall_time")


@query("st6_ingest_once", "select page_id, 1::bigint as times, sum(length(v::varchar) + 1)::bigint as length from pixels group by 1")
def _(v):
    path = scratch_path(v.spark)
    for some in ("page_id % 2 = 0", "page_id % 2 = 1"):
        _page_files(v, f"{path}/pages", some)
        out = S.ingest(v.spark, f"{path}/pages", "*.txt")
        with S.listing(v.spark):
            _appended(out, path)
    rows = v.spark.read.schema(out.schema).parquet(f"{path}/rows")
    return rows.groupBy(_page(F.col("path")).alias("page_id")).agg(F.count("*").alias("times"), F.sum("length").alias("length"))
