"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: One or more of these separate the words of the decontamination and license operators.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Setting by which the shuffle files of a finished statement go at once.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A word of the near-duplicate and mixing operators.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII texts take the fast built-in path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """The ASCII-lower-cased words between SEPARATORS; an empty array for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def row_key() -> Column:
    """64 bits that rows share which agree in id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))


#: Values that ``running`` adds up in one heap.
HEAP = 128


def once(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(numbers: Column, merge=lambda a, b: a + b) -> Column:
    """array<int> -> for each place, what merge makes of 0 and all numbers before it.

    An array is copied whenever it grows, so sums grow in heaps of HEAP numbers.
    """
    zero = F.lit(0)
    last = lambda acc: F.element_at(acc, F.lit(-1))
    grown = lambda xs, first: F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(merge(last(acc), x))))
    split = lambda xs: F.transform(F.sequence(zero, F.floor((F.size(xs) - 1) / HEAP).cast("int")), lambda i: F.slice(xs, i * HEAP + 1, HEAP))
    starts = lambda heaps: grown(F.transform(heaps, lambda h: F.aggregate(h, zero, lambda a, x: merge(a, x))), zero)
    within = lambda heaps: once(starts(heaps), lambda at: F.flatten(F.transform(heaps, lambda h, i: F.slice(grown(h, F.get(at, i)), 1, F.size(h)))))
    return once(numbers, lambda xs: F.when(F.size(xs) > 0, once(split(xs), within)).otherwise(F.array().cast("array<int>")))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and the master is local (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not conf and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(conf or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return jsc.getCheckpointDir().get()


#: Per open ``scratch``, outermost first, the folders of the tables that it will delete.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("_OPEN", default=())


#: Files of large rows: a row group, which is held whole by who writes or reads it, has one. Else sizes are first looked at after 100 rows.
LARGE = {"parquet.block.row.count.limit": 1, "parquet.enable.dictionary": "false"}


def saved(df: DataFrame, keep: bool = False, large: bool = False) -> DataFrame:
    """df, written to the checkpoint folder and read again.

    Its lineage ends there, a lost executor costs nothing that is written, and the planner
    sees the size that it really has (a checkpointed DataFrame would keep multiplying old estimates
    in iterative plans). Two readers of it don't compute it twice. Shuffle files of the job that wrote
    it are removed as soon as it is written. It goes at the end of the ``scratch`` around it, or with ``keep``, of the next one further out.
    ``large``: its rows have megabytes, and a task holds one at a time.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.options(compression="zstd", **(LARGE if large else {})).parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    open_ = _OPEN.get()[: -1 if keep else None]
    if open_:
        open_[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, in whatever file system they are."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``saved`` writes inside are deleted at the end, but for those saved with keep."""
    mine: list[str] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        deleted(spark, *mine)


def hinted(small: DataFrame, row_bytes: int, most: int) -> DataFrame:
    """A written table with the hint to broadcast it, if its rows of about row_bytes fit in most bytes; else as it is."""
    return F.broadcast(small) if small.count() * row_bytes <= most else small
