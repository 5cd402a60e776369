"""Removal of byte strings that stand more than once, by a depth-limited radix sort of suffixes.

Suffixes are told apart only through their first ``LENGTH`` bytes, most significant digits first,
and a group of one leaves after each pass. The digits are hashes of growing byte ranges:

1. The gram: of each suffix's 32-byte grams within its first LENGTH bytes the one with the smallest
   hash. Neighbouring suffixes share it, so one row stands for a run of suffixes (about 180), and
   equal suffixes have the same gram at the same distance.
2. The core: the suffixes of a run are cut into blocks by their distance from the gram, 64 each;
   the bytes that all suffixes of a block have in common are its core.
3. The whole: blocks that agree byte for byte in all that their suffixes cover are repeated as they
   stand. Blocks that agree in the core only are opened, and single suffixes are compared.

Groups that are left hold the repeated windows. Each pass counts before it shuffles (a group of a
third of all rows is one counter per task) and joins the counts back, so no group meets in a task.
Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, once, saved
from .rolling import Ranges, buffers, chunks, mix, signed

LENGTH = 400
GRAM = 32
BLOCK = 64
CHUNK = 1 << 20
#: Positions within a chunk take this many bits beside the grams' hashes.
BITS = 24
#: A single text is handled in pieces of this many bytes.
PIECE = 1 << 22
#: What is joined to the texts is broadcast up to this many bytes.
MAX_BROADCAST = 48 << 20
SPANS = "array<struct<s:bigint,e:bigint>>"


def _runs(data: np.ndarray, ends: np.ndarray, length: int):
    """The ranges of the buffer, its grams' hashes, and per run: gram position, first and last suffix.

    ends: for each byte the end of its text. Suffixes with fewer than ``length`` bytes are left out.
    """
    ranges = Ranges(data)
    n, width = len(data) - length + 1, length - GRAM + 1
    if n <= 0:
        return ranges, np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3
    low = np.uint64((1 << BITS) - 1)
    grams = ranges.every(GRAM)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(packed) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    valid = np.arange(n) + length <= ends[:n]
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (ends[1:n] != ends[: n - 1])
    first = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    last = np.flatnonzero(last)
    return ranges, grams, at[first], first, last


def _pieces(offsets: np.ndarray, length: int):
    """(texts, byte ranges): chunks of whole texts, or overlapping pieces of one long text."""
    for first, last in chunks(offsets, CHUNK):
        a, b = int(offsets[first]), int(offsets[last])
        if last - first > 1 or b - a <= PIECE:
            if b - a >= length:
                yield first, last, a, b
        else:
            for at in range(a, b - length + 1, PIECE - length + 1):
                yield first, last, at, min(b, at + PIECE)


def _text_of(offsets: np.ndarray, first: int, last: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of a piece: its text's number and the end of that text within the piece."""
    edges = np.clip(offsets[first : last + 1] - a, 0, b - a)
    sizes = np.diff(edges)
    return np.repeat(np.arange(first, last), sizes), np.repeat(edges[1:], sizes)


def _emit_grams(length: int):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for first, last, a, b in _pieces(offsets, length):
                _, ends = _text_of(offsets, first, last, a, b)
                _, grams, p, _, _ = _runs(data[a:b], ends, length)
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams[p]))], ["h"])

    return run


def _emit_runs(length: int, block: int):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            key = batch.column("k").to_numpy(zero_copy_only=False)
            for first, last, a, b in _pieces(offsets, length):
                doc, ends = _text_of(offsets, first, last, a, b)
                ranges, grams, p, s0, s1 = _runs(data[a:b], ends, length)
                if not len(p):
                    continue
                low, high = (p - s1) // block, (p - s0) // block
                n = high - low + 1
                of = np.repeat(np.arange(len(p)), n)
                j = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                near, far = np.maximum(j * block, (p - s1)[of]), np.minimum(j * block + block - 1, (p - s0)[of])
                core = mix(ranges.hash(p[of] - j * block, length - block + 1) + j.astype(np.uint64))
                whole = mix(ranges.hash(p[of] - far, far - near + length) + ((near << 20) + far).astype(np.uint64))
                at = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                base = a - offsets[doc[s0]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(grams[p])), pa.array(key[doc[s0]]), pa.array(p + base), pa.array(s0 + base), pa.array(s1 + base),
                        pa.ListArray.from_arrays(at, pa.array(signed(core))), pa.ListArray.from_arrays(at, pa.array(signed(whole))),
                    ],
                    ["h", "k", "p", "s0", "s1", "cores", "wholes"],
                )

    return run


def _emit_windows(length: int):
    """One row per suffix of the blocks that ``open`` lists: its hash, text key, start and weight."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            key = batch.column("k").to_numpy(zero_copy_only=False)
            for i, blocks in enumerate(batch.column("open").to_pylist()):
                base = int(offsets[i])
                for b in blocks:
                    a, z = b["lo"], b["hi"]
                    h = Ranges(data[base + a : base + z + length]).every(length)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(h)), pa.array(np.full(n, key[i])), pa.array(np.arange(a, z + 1)), pa.array(np.full(n, b["weight"], np.int32))],
                        ["w", "k", "s", "weight"],
                    )

    return run


def _merged(most: int = 200):
    """Batches that are too small cost more to send than to make: joins them."""

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if len(held) >= most or rows >= 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held and rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def _then(one, two):
    return lambda batches: two(one(batches))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents(doc_id, text) -> (k, spans): per text key the byte ranges [s, e) that are covered by
    a string of ``length`` bytes that starts at another place too, merged and sorted. Texts without
    such a range have no row. k = text_key(doc_id, text)."""
    block = max(1, min(BLOCK, length // 4))
    texts = docs.select(text_key().alias("k"), "text").where(F.octet_length("text") >= length)
    grams = texts.select("text").mapInArrow(_then(_emit_grams(length), _merged()), "h long")
    # counts are written out, so that the joins that follow deal both sides anew and split hot keys
    twice = saved(grams.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    runs = texts.mapInArrow(
        _then(_emit_runs(length, block), _merged()), "h long, k long, p long, s0 long, s1 long, cores array<long>, wholes array<long>"
    )
    kept = runs.join(twice, "h").select("k", "p", "s0", "s1", F.posexplode(F.arrays_zip("cores", "wholes")).alias("i", "x"))
    j = F.floor((F.col("p") - F.col("s1")) / block) + F.col("i")
    near, far = F.greatest(j * block, F.col("p") - F.col("s1")), F.least(j * block + block - 1, F.col("p") - F.col("s0"))
    blocks = saved(
        kept.select(
            "k", F.col("x.cores").alias("core"), F.col("x.wholes").alias("whole"),
            (F.col("p") - far).cast("int").alias("lo"), (F.col("p") - near).cast("int").alias("hi"),
        )
    )
    variants = blocks.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("k", "lo")).alias("one"))
    cores = variants.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    known = saved(variants.join(cores, "core").select("core", "whole", "n", "kinds", "one"))
    # a block that stands alone and shares its core with others, and one of each repeated kind of block there
    held = blocks.join(known, ["core", "whole"])
    whole = held.where("n > 1").select("k", F.col("lo").cast("long").alias("s"), (F.col("hi") + length).cast("long").alias("e"))
    opened = held.where("kinds > 1 and (n = 1 or (k = one.k and lo = one.lo))").select("k", "lo", "hi", F.when(F.col("n") > 1, 2).otherwise(1).alias("weight")).distinct()
    opened = saved(opened.groupBy("k").agg(F.collect_list(F.struct("lo", "hi", "weight")).alias("open")))  # within one text
    size = opened.agg(F.coalesce(F.sum(F.size("open") * 16 + 16), F.lit(0))).first()[0]
    some = texts.join(F.broadcast(opened) if size <= MAX_BROADCAST else opened, "k")
    windows = some.mapInArrow(_then(_emit_windows(length), _merged()), "w long, k long, s long, weight int")
    windows = saved(windows)
    again = saved(windows.groupBy("w").agg(F.sum("weight").alias("n")).where("n > 1").select("w"))
    single = windows.where("weight = 1").join(again, "w").select("k", "s", (F.col("s") + length).alias("e"))
    return union_of_spans(whole.unionByName(single))


def union_of_spans(spans: DataFrame) -> DataFrame:
    """(k, s, e) -> (k, spans): touching and overlapping ranges of one text joined."""
    order = Window.partitionBy("k").orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("s") <= reached, 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(order)).groupBy("k", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return islands.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def text_key() -> Column:
    """Rows that agree in id and text share a key, and so their result."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))


def _kept(text: Column, spans: Column) -> Column:
    """The bytes of text outside the spans."""
    raw = F.encode(text, "UTF-8")

    def left(b: Column) -> Column:
        piece = lambda s, e: F.hex(F.substring(b, (s + 1).cast("int"), (e - s).cast("int")))
        end = lambda i: F.coalesce(F.get(spans, i - 1)["e"], F.lit(0).cast("long"))
        pieces = F.transform(spans, lambda x, i: piece(end(i), x["s"]))
        return F.unhex(F.array_join(F.concat(pieces, F.array(piece(end(F.size(spans)), F.octet_length(text)))), ""))

    return F.when(F.size(spans) > 0, once(raw, left)).otherwise(raw)


def with_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs plus ``repeats``: array<struct<s, e>> of the byte ranges to remove (empty if none)."""
    spans = saved(repeated_spans(docs, length))
    size = spans.agg(F.coalesce(F.sum(F.size("spans") * 16 + 16), F.lit(0))).first()[0]
    k = fresh(docs, "text_key")
    spans = spans.select(F.col("k").alias(k), F.col("spans").alias("repeats"))
    out = docs.withColumn(k, text_key()).join(F.broadcast(spans) if size <= MAX_BROADCAST else spans, k, "left")
    return out.withColumn("repeats", F.coalesce("repeats", F.array().cast(SPANS))).drop(k)


def exact_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Null text: no bytes. Texts under ``length`` bytes keep all. Repeated rows remove each other's
    bytes whole, from ``length`` bytes on. Empty table: no rows. Other columns are ignored.
    """
    out = with_repeats(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), length)
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return out.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("repeats").cast("long").alias("n_spans"),
        F.sha2(_kept(F.col("text"), F.col("repeats")), 256).alias("kept_sha256"),
        F.col("repeats").alias("spans"),
    )


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


#: All 400-byte windows, in hexadecimal digits, counted one by one; texts are cut into overlapping pieces first, as long strings are slow to index.
OP7_SQL = r"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
pc as (select r, b, len(h) // 2 - 399 - 500 * b as n, substr(h, 1000 * b + 1, 1798) as piece from d, unnest(range(0, greatest(0, (len(h) // 2 + 100) // 500))) as u(b)),
w as (select r, 500 * b + j as i, hash(substr(piece, 2 * j + 1, 800)) as k from pc, unnest(range(0, greatest(0, least(500, n)))) as u(j)),
hit as (select r, i, i - lag(i) over (partition by r order by i) as gap from w where k in (select k from w group by 1 having count(*) > 1)),
isl as (select r, i, sum(case when gap <= 400 then 0 else 1 end) over (partition by r order by i) as island from hit),
sp as (select r, min(i) as s, max(i) + 400 as e from isl group by r, island),
g as (select r, s, e, coalesce(lag(e) over (partition by r order by s), 0) as b, lead(s) over (partition by r order by s) as nxt from sp),
k as (select r, string_agg(substr(h, 2 * b + 1, 2 * (s - b)) || case when nxt is null then substr(h, 2 * e + 1) else '' end, '' order by s) as kept, sum(e - s) as n_removed, count(*) as n_spans from g join d using (r) group by r)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join k using (r)
"""
