"""Packing documents into sequences by bounded-space online best fit.

Every document is its tokens and an end token. What is longer than a sequence is cut into pieces as long as
one, of which the first takes the remainder. Pieces are dealt by hash into shards of bounded size, where they arrive
in random runs, each the longest first: so open bins always meet pieces of all lengths. A shard holds a fixed number of open bins; a bitset has a bit for each amount of free space that an open bin
has. A piece goes where the least free space is that holds it, the first set bit from its length upwards. If none holds it,
a bin is opened, and where that is one too many, the fullest closes. What lies in the bins still open at a shard's
end goes on to a shard that several shards share, until one is left; so the whole table leaves no more bins partly filled
than one shard does. Only numbers of pieces move; texts are read once.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, scratch
from .tokens import BYTE_BPE, Remembered, byte_bpe, path_of, words_of

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 256
#: Pieces of a run; with fewer open bins than about a quarter of them, long pieces close bins before short ones come.
RUN = 1024
#: Pieces that a shard has on average, and shards whose open bins meet in one.
SHARD_PIECES = 8192
FAN_IN = 16

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def ids_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


#: By tokenizer: word -> the ids of a space and the word as little-endian 32-bit numbers.
_words: dict[str, Remembered] = {}


def text_ids(text: str, path: str) -> bytes:
    """The ids of a text; strings of special tokens are those tokens, as is the library's default."""
    bpe = byte_bpe(path, False)
    if bpe.has_special(text):
        return ids_bytes(bpe.encode(text))
    first, *rest = words_of(text)
    known = _words.setdefault(path, Remembered(lambda word: ids_bytes(bpe.encode(" " + word))))
    return ids_bytes(bpe.encode(first)) + b"".join(map(known.__getitem__, rest))


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, but for the first."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def document_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32 and row, a number of the row it comes from that isn't the same from run to run."""
    path, end = path_of(tokenizer), ids_bytes([end_id])

    def cut(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(text_ids(text or "", path) + end)
                for k, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), row))
                row += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)] if out else None
            if columns:
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int], set[int]]:
    """The bin of each length and its place there, and the bins that are still open at the end."""
    held: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    bits, n_open, n_bins = 0, 0, 0
    bins, places = [], []
    for length in lengths:
        fitting = bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = held[free].pop()
            if not held[free]:
                bits ^= 1 << free
        else:
            free, bin_ = capacity, n_bins
            n_bins += 1
            n_open += 1
        bins.append(bin_)
        places.append(capacity - free)
        left = free - length
        if left:
            held[left].append(bin_)
            bits |= 1 << left
            if n_open > open_bins:  # a bin was opened: the fullest closes
                fullest = (bits & -bits).bit_length() - 1
                held[fullest].pop(0)
                if not held[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1
        else:
            n_open -= 1
    return bins, places, {b for at in held for b in at}


def _filler(capacity: int, open_bins: int, level: int, top: bool):
    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["row", "piece"]).sample(frac=1, random_state=7, ignore_index=True)
        part = part.iloc[np.lexsort((-part["length"], np.arange(len(part)) // RUN))].reset_index(drop=True)
        bins, places, still = best_fit(part["length"].tolist(), capacity, open_bins)
        known = [top or b not in still for b in bins]
        first = (level << 56) + (int(part["shard"].iloc[0]) << 24)
        part["sequence_id"] = pd.array([first + b if k else None for b, k in zip(bins, known, strict=True)], "Int64")
        part["offset"] = pd.array([p if k else None for p, k in zip(places, known, strict=True)], "Int64")
        return part

    return fill


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES, fan_in: int = FAN_IN) -> DataFrame:
    """pieces(row, piece, length, ...) -> the same with sequence_id and offset. Lengths are 1 to capacity; (row, piece) don't repeat."""
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema]
    schema = ", ".join([*columns, "shard long", "sequence_id long", "`offset` long"])
    shards, level, done = max(1, math.ceil(pieces.count() / shard_pieces)), 0, None
    rows = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    while True:
        top = shards == 1
        filled = saved(rows.groupBy("shard").applyInPandas(_filler(capacity, open_bins, level, top), schema), keep=True)
        placed = filled.where("sequence_id is not null").drop("shard")
        done = placed if done is None else done.unionByName(placed)
        if top:
            return done
        shards, level = math.ceil(shards / fan_in), level + 1
        rows = filled.where("sequence_id is null").drop("sequence_id", "offset").withColumn("shard", F.floor(F.col("shard") / fan_in))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = BYTE_BPE, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: a vocabulary file of the byte-level kind, by name or path. Null and empty texts are the end
    token alone. Repeated rows are packed one by one, each with pieces of its own from 0; null ids stay null. Very long
    texts are cut like all others. Empty table: no rows. Other columns are ignored.
    """
    with scratch(docs.sparkSession):
        out = pack(saved(document_pieces(docs, capacity, tokenizer, end_id)), capacity, open_bins)
    return out.drop("row")


def op13_pack(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
