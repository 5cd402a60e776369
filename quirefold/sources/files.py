"""File sources and sinks: image listings, shards, slices, reports, logs, dimensions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators.metrics import metric_rows
from quirefold.session import qualified, removed


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modified, length) of matching files; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def page_dims(spark: SparkSession, path: str, size_of: Callable[[bytes], tuple[int, int]], pattern: str = "*.png") -> DataFrame:
    """(page_id, width, height, error) of image files; size_of decodes one file's header and may raise."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    w, h = size_of(bytes(c))
                    rows.append((p, w, h, None))
                except Exception as e:
                    rows.append((p, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["page_id", "width", "height", "error"]).astype({"width": "Int64", "height": "Int64"})

    return files.mapInPandas(run, "page_id string, width long, height long, error string")


def png_size(content: bytes) -> tuple[int, int]:
    """Width and height in a PNG header."""
    if content[:8] != b"\x89PNG\r\n\x1a\n" or len(content) < 24:
        raise ValueError("not a PNG")
    return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")


def write_shards(records: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per output shard; large shards are split over tasks and small ones share one, by their size at run time."""
    records.hint("rebalance", F.col(shard)).write.mode("overwrite").partitionBy(shard).parquet(path)


def split_shard(records: DataFrame, path: str, most: int) -> None:
    """Files of at most ``most`` records."""
    records.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(path)


def numbered(records: DataFrame, shard: str, order: list[str], size: str, max_records: int, max_bytes: int) -> DataFrame:
    """records and ``part``, from 0 in every shard: its records in order, as many in each part as both bounds allow.

    A record larger than max_bytes is a part of its own; a null size counts as 0. Keys and sizes alone are sorted and streamed through; a shard, which
    is a file that some writer made, is one run of them.
    """
    narrow = records.select(shard, *order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size_"))
    kinds = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in [shard, *order])

    def run(batches):
        key, part, count, held = None, 0, 0, 0
        for b in batches:
            if not len(b):
                continue
            keys, sizes = b[shard].to_numpy(), b["size_"].to_numpy(np.int64)
            parts, ends = np.empty(len(b), np.int64), np.cumsum(sizes)
            new = np.r_[key is None or keys[0] != key, keys[1:] != keys[:-1]]
            at = 0
            for stop in [*np.flatnonzero(new)[1:].tolist(), len(b)] if new[0] else [*np.flatnonzero(new).tolist(), len(b)]:
                if new[at]:
                    part, count, held = 0, 0, 0
                while at < stop:
                    before = ends[at - 1] if at else 0
                    fit = min(stop, at + max_records - count, int(np.searchsorted(ends, before + max_bytes - held, side="right")))
                    if fit <= at and count == 0:
                        fit = at + 1  # larger than a part may be
                    parts[at:fit] = part
                    if fit > at:
                        count, held = count + fit - at, held + int(ends[fit - 1] - before)
                    if fit < stop:
                        part, count, held = part + 1, 0, 0
                    at = max(at, fit)
            key = keys[-1]
            yield b[[shard, *order]].assign(part=parts)

    parts = narrow.repartition(shard).sortWithinPartitions(shard, *order).mapInPandas(run, f"{kinds}, part long")
    return records.join(parts, [shard, *order])


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path within it."""
    return (fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)) if path.startswith("file:") else fs.FileSystem.from_uri(path)


def _put(to: fs.FileSystem, folder: str, name: str, write: Callable) -> None:
    """A file, whole or not at all: a task that runs again puts the same in its place. Readers don't see the name that it has before."""
    before = f"{folder}/_{uuid.uuid4().hex}"
    with to.open_output_stream(before) as out:
        write(out)
    to.move(before, f"{folder}/{name}")


def write_files(files: DataFrame, path: str) -> None:
    """A file in the folder for every row (name, content), which are strings; what is there stays, but for files of these names.

    Tasks write their files themselves: Spark's writers need a folder for each of them, and most of their time goes into permissions and moves.
    The path is one that executors share and pyarrow can write to.
    """
    path = qualified(files.sparkSession, path)
    to, folder = _folder(path)
    to.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, folder = _folder(path)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                _put(to, folder, name, lambda out, content=content: out.write(content.encode()))
            yield pa.RecordBatch.from_arrays([b.column("name")], ["name"])

    # dealt out by number, which is not coalesced for being few bytes
    dealt = files.select("name", "content").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    dealt.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def split_shards(records: DataFrame, path: str, shard: str, order: list[str], size: str, max_records: int, max_bytes: int) -> None:
    """A folder for every shard with a parquet file for every part of it, as ``numbered`` cuts them, of records in order and their ``part``.

    (shard, order) must not repeat. What was in the folder goes. The path is as that of ``write_files``, and so are the writers.
    """
    path = qualified(records.sparkSession, path)
    removed(records.sparkSession, path)
    to, folder = _folder(path)
    to.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, folder = _folder(path)

        def put(key: tuple, held: list[pa.RecordBatch]) -> None:
            of = "__HIVE_DEFAULT_PARTITION__" if key[0] is None else quote(str(key[0]), safe="")
            to.create_dir(f"{folder}/{shard}={of}", recursive=True)
            _put(to, f"{folder}/{shard}={of}", f"part-{key[1]:08d}.parquet", lambda out: pq.write_table(pa.Table.from_batches(held).drop_columns([shard]), out))

        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            of = [b.column(c).dictionary_encode("encode").indices.to_numpy() for c in (shard, "part")]
            at = [0, *(np.flatnonzero((of[0][1:] != of[0][:-1]) | (of[1][1:] != of[1][:-1])) + 1).tolist(), b.num_rows]
            for start, stop in zip(at, at[1:], strict=False):
                new = (b.column(shard)[start].as_py(), b.column("part")[start].as_py())
                if new != key and held:
                    put(key, held)
                    held = []
                key = new
                held.append(b.slice(start, stop - start))
            yield pa.RecordBatch.from_arrays([b.column("part")], ["part"])
        if held:
            put(key, held)

    rows = numbered(records, shard, order, size, max_records, max_bytes).repartition(shard, "part").sortWithinPartitions(shard, "part", *order)
    rows.mapInArrow(run, "part long").write.format("noop").mode("overwrite").save()


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """A class table (Idx, Ratio, Train, Val, Stuff, Name) with label_index = Idx - 1."""
    schema = "Idx int, Ratio double, Train int, Val int, Stuff int, Name string"
    return spark.read.csv(path, header=True, schema=schema).withColumn("label_index", F.col("Idx") - 1)


def report_table(results: DataFrame, short: bool = False) -> DataFrame:
    """(score, grp, stat, value) -> a row per score and stat, a column per group, four decimals.

    short leaves out scores that begin with ``segm_``. Columns without any value go. Groups are few
    (bins, classes).
    """
    rows = results.where(~F.startswith("score", F.lit("segm_"))) if short else results
    wide = rows.withColumn("grp", F.coalesce("grp", F.lit("total"))).groupBy("score", "stat").pivot("grp").agg(F.first("value"))
    values = [c for c in wide.columns if c not in ("score", "stat")]
    seen = wide.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & ~F.isnan(f"`{c}`")).alias(c) for c in values]).first() if values else {}
    kept = [c for c in values if seen[c]]
    return wide.select("score", "stat", *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in kept])


def write_report(results: DataFrame, path: str, short: bool = False) -> None:
    """The report as tab-separated text with a header, one file (a row per score and stat)."""
    report_table(results, short).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_training_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files -> run (the file), line, epoch, step, f1 of every metrics row."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return metric_rows(whole)
