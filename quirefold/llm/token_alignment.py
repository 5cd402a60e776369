"""Alignment of two tokenizers over the same text, with the document frequency of every linked pair of ids.

Where tokens of both end at one byte, the text is cut into groups; tokens that share a group are linked. The first pass
encodes and aligns: words are encoded once per worker, and chunks of documents keep their words and the distinct
pairs they hold. Pairs are dealt into shards by their A id. The distinct ones of a shard are found in a
tree and get slots from a minimal perfect hash whose keys are verified; every branch of chunks counts into a dense vector by
slot, and vectors are summed up the tree. So an id's highest count is known in its shard. Each chunk is answered for its
distinct pairs alone, however often it has them, and the second pass aligns its words again and looks the counts up.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, scratch
from .perfect_hash import PerfectHash, lanes
from .rolling import mix
from .tokens import BYTE_BPE, PIECE_BPE, REMEMBERED, byte_bpe, path_of, piece_bpe, words_of

#: Bytes of text of a chunk, unless one document has more.
CHUNK_BYTES = 4 << 20
#: (chunk, pair) entries of a shard on average, and the most shards.
SHARD_ENTRIES = 2_000_000
MAX_SHARDS = 1600
#: Chunks, or vectors, that meet in a node of the tree.
FAN_IN = 32
#: Groups with more links than this are counted by distinct ids.
WIDE = 4096
#: New words that are encoded at a time, and documents whose pairs are counted at a time.
NEW_WORDS = 20_000
COUNTED_DOCS = 128
#: Rows of a batch that are turned into Python objects at a time.
TAKEN_ROWS = 256
#: A pair as one number: the A id times this and the B id.
STEP = 1 << 20

_CHUNK = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "packed binary, sizes array<long>, pairs binary, df binary, n_pairs long"
)
_NODE = "shard long, node long, pairs binary"
_VECTOR = "shard long, node long, counts binary"
_DONE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def groups_of(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every A and every B token, from their bytes, and how many groups there are; both cover the same bytes."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends), len(ends)


def links_of(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links) of all groups; a pair may come more than once, and wide groups come by distinct ids."""
    p, q = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    first_b = np.cumsum(q) - q
    wide = p * q > WIDE
    at = np.flatnonzero(~wide[a_group])
    times = q[a_group[at]]
    left = np.repeat(at, times)
    ahead = np.repeat(np.cumsum(times) - times, times)
    right = first_b[a_group[left]] + np.arange(len(left)) - ahead
    parts = [(a_group[left], a[left] * STEP + b[right], np.ones(len(left), np.int64))]
    first_a = np.cumsum(p) - p
    for g in np.flatnonzero(wide).tolist():
        x, n_x = np.unique(a[first_a[g] : first_a[g] + p[g]], return_counts=True)
        y, n_y = np.unique(b[first_b[g] : first_b[g] + q[g]], return_counts=True)
        pair = (x[:, None] * STEP + y).ravel()
        parts.append((np.full(len(pair), g), pair, (n_x[:, None] * n_y).ravel()))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


class _Aligner:
    """Both tokenizers and the words that they have encoded: (A ids, B ids, groups, links, groups as text), None where the bytes differ."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_bpe(a_path, True), piece_bpe(b_path)
        self.a_sizes, self.b_sizes = sizes_of(self.a.token_bytes), sizes_of(self.b.token_bytes)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        # an id as text with what may stand before it
        self.a_text, self.b_text = (np.array([f"{mark}{i}" for mark in marks for i in range(n)], object) for marks, n in (((",", ";", ""), len(self.a_sizes)), ((",", "|"), len(self.b_sizes))))

    def look_up(self, words: list[str]) -> list[tuple | None]:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        for i in range(0, len(new), NEW_WORDS):
            known.update(zip(new[i : i + NEW_WORDS], self._encoded(new[i : i + NEW_WORDS]), strict=True))
        return [known[w] for w in words]

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def _encoded(self, words: list[str]) -> list[tuple | None]:
        a, b = [self.a.encode(" " + w) for w in words], self.b.encode(words)
        a_bytes, b_bytes, whole = self.a.token_bytes, self.b.token_bytes, [(" " + w).encode() for w in words]
        good = [b"".join([a_bytes.get(i, b"") for i in x]) == w and b"".join([b_bytes[i] for i in y]) == w for x, y, w in zip(a, b, whole, strict=True)]
        found = iter(self._aligned([x for x, g in zip(a, good, strict=True) if g], [y for y, g in zip(b, good, strict=True) if g]))
        return [next(found) if g else None for g in good]

    def _aligned(self, a: list[list[int]], b: list[list[int]]) -> list[tuple]:
        a_n, b_n = np.array([len(x) for x in a], np.int64), np.array([len(y) for y in b], np.int64)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, a_n), (b, b_n)))
        a_group, b_group, n = groups_of(self.a_sizes[a], self.b_sizes[b])
        p, q = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        word = np.repeat(np.arange(len(a_n)), a_n)[np.cumsum(p) - p]  # of every group
        # tokens in the order of the text: a group's A ids, then its B ids
        a_mark, b_mark = np.diff(a_group, prepend=-1) > 0, np.diff(b_group, prepend=-1) > 0
        first = np.zeros(len(a), bool)
        first[np.cumsum(a_n) - a_n] = True
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + (np.cumsum(q) - q)[a_group]] = self.a_text[a + len(self.a_sizes) * (a_mark.astype(np.int64) + first)]
        text[np.arange(len(b)) + np.cumsum(p)[b_group]] = self.b_text[b + len(self.b_sizes) * b_mark]
        ends, text = np.cumsum(a_n + b_n).tolist(), text.tolist()
        groups, links = np.bincount(word, minlength=len(a_n)).tolist(), np.bincount(word, weights=p * q, minlength=len(a_n)).astype(np.int64).tolist()
        a, b, a_ends, b_ends = a.astype(np.uint16).tobytes(), b.astype(np.uint16).tobytes(), (2 * np.cumsum(a_n)).tolist(), (2 * np.cumsum(b_n)).tolist()
        starts = lambda ends: [0, *ends[:-1]]
        return [
            (a[i:j], b[k:m], g, n, "".join(text[s:e]))
            for i, j, k, m, g, n, s, e in zip(starts(a_ends), a_ends, starts(b_ends), b_ends, groups, links, starts(ends), ends, strict=True)
        ]


_aligners: dict[tuple[str, str], _Aligner] = {}


def _aligner(a_path: str, b_path: str) -> _Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = _Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def sizes_of(token_bytes: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(token_bytes) + 1, np.int64)
    for i, b in token_bytes.items():
        out[i] = len(b)
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The values in order, once each."""
    x = np.sort(x)
    return x[np.diff(x, prepend=x[0] - 1) > 0] if len(x) else x


def _word_links(aligner: _Aligner, a: np.ndarray, a_n: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, pair, links) of words whose tokens lie one after another."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    a_group, b_group, n = groups_of(aligner.a_sizes[a], aligner.b_sizes[b])
    group, pair, links = links_of(a, b, a_group, b_group, n)
    first_token = np.searchsorted(a_group, np.arange(n))
    return np.repeat(np.arange(len(a_n)), a_n)[first_token][group], pair, links


def _owned(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of things that lie by row, counts of each: for the given rows (index into rows, position) of all that they own."""
    n, starts = counts[rows], np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(rows)), n)
    return owner, starts[rows[owner]] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(*parts: bytes) -> tuple[bytes, list[int]]:
    """The parts, compressed together, and their sizes: most of a chunk's bytes are small numbers."""
    return pa.compress(b"".join(parts), "zstd", asbytes=True), [len(p) for p in parts]


def _unpacked(packed: bytes, sizes: list[int]) -> list[bytes]:
    whole, ends = pa.decompress(packed, int(sum(sizes)), "zstd", asbytes=True), np.cumsum(sizes).tolist()
    return [whole[i:j] for i, j in pairwise([0, *ends])]


def _chunk(chunk: int, docs: list[tuple[int, str | None]], aligner: _Aligner) -> dict:
    index = _Numbered()
    words = [list(map(index.__getitem__, words_of(t))) if t else [] for _, t in docs]
    known = aligner.look_up(list(index))
    bad = {i for i, k in enumerate(known) if k is None}
    if bad:  # a text whose bytes differ anywhere has no tokens
        words = [[] if bad.intersection(own) else own for own in words]
    known = [(b"", b"", 0, 0, "") if k is None else k for k in known]
    n = np.array([len(own) for own in words], np.int64)
    flat = np.fromiter(chain.from_iterable(words), np.int32, int(n.sum()))
    doc = np.repeat(np.arange(len(docs)), n)
    a_ids, b_ids, groups, links, texts = zip(*known, strict=True) if known else [()] * 5
    per_word = [np.array([len(x) // 2 for x in a_ids], np.int64), np.array([len(x) // 2 for x in b_ids], np.int64), np.array(groups, np.int64), np.array(links, np.int64)]
    sums = [np.bincount(doc, weights=w[flat], minlength=len(docs)).astype(np.int64) for w in per_word]
    digests = [hashlib.sha256(";".join([texts[i] for i in own]).encode()).hexdigest() if own else "" for own in words]
    a, b = b"".join(a_ids), b"".join(b_ids)
    word, pair, _ = _word_links(aligner, np.frombuffer(a, np.uint16), per_word[0], np.frombuffer(b, np.uint16))
    pairs = distinct(pair)
    # a number for each (word, pair) and each (document, word), to have them once
    word, number = np.divmod(distinct(word * max(1, len(pairs)) + np.searchsorted(pairs, pair)), max(1, len(pairs)))
    own_doc, own_word = np.divmod(distinct(doc * max(1, len(known)) + flat), max(1, len(known)))
    per, df = np.bincount(word, minlength=len(known)), np.zeros(len(pairs), np.int64)
    bounds = [*np.searchsorted(own_doc, np.arange(0, len(docs), COUNTED_DOCS)).tolist(), len(own_doc)]
    for i, j in pairwise(bounds):
        owner, at = _owned(own_word[i:j], per)
        held = distinct(own_doc[i:j][owner] * max(1, len(pairs)) + number[at])
        df += np.bincount(held % max(1, len(pairs)), minlength=len(pairs))
    pairs, df = pairs[df > 0], df[df > 0]
    packed, sizes = _packed(n.tobytes(), flat.tobytes(), a, per_word[0].astype(np.int32).tobytes(), b)
    columns = {"chunk": chunk, "doc_id": [d for d, _ in docs], "groups_sha256": digests, "packed": packed, "sizes": sizes}
    columns |= {name: s.tolist() for name, s in zip(("n_a", "n_b", "n_groups", "n_links"), sums, strict=True)}
    return columns | {"pairs": pairs.tobytes(), "df": df.tobytes(), "n_pairs": len(pairs)}


def _schema_of(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in text.split(", "))])


def aligned_chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, text) -> chunks of documents with figures per document, their words' tokens and their distinct pairs."""
    schema = _schema_of(_CHUNK)

    def encode(batches):
        aligner, chunk, docs, size = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32, [], 0
        for part in (b.slice(i, TAKEN_ROWS) for b in batches for i in range(0, b.num_rows, TAKEN_ROWS)):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                docs.append((doc_id, text))
                size += len(text or "")
                if size >= chunk_bytes or len(docs) >= 100_000:
                    yield pa.RecordBatch.from_pylist([_chunk(chunk, docs, aligner)], schema)
                    chunk, docs, size = chunk + 1, [], 0
        if docs:
            yield pa.RecordBatch.from_pylist([_chunk(chunk, docs, aligner)], schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, _CHUNK)


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    """By the A id, so that all pairs of an A id lie in one shard."""
    return (mix((pairs // STEP).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _longs(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64)


def _dealt(chunks: DataFrame, shards: int, width: int) -> DataFrame:
    """A row per chunk and shard that it has pairs of."""

    def deal(batches):
        for part in batches:
            for chunk, pairs, df in zip(part["chunk"], part["pairs"], part["df"], strict=True):
                pairs, df = _longs(pairs), _longs(df)
                shard = shard_of(pairs, shards)
                order = np.argsort(shard, kind="stable")
                found, first = np.unique(shard[order], return_index=True)
                own = np.split(order, first[1:]) if len(found) else []
                rows = [(int(s), chunk, pairs[i].tobytes(), df[i].tobytes()) for s, i in zip(found, own, strict=True)]
                yield pd.DataFrame(rows, columns=["shard", "chunk", "pairs", "df"])

    out = chunks.select("chunk", "pairs", "df").mapInPandas(deal, "shard long, chunk long, pairs binary, df binary")
    return out.withColumn("node", F.pmod(F.xxhash64("chunk"), F.lit(width)))


def _up(rows: DataFrame, width: int, merge, schema: str) -> DataFrame:
    """Merges the nodes of every shard, FAN_IN at a time, until each shard has one row."""
    while True:
        rows = saved(rows.groupBy("shard", "node").applyInPandas(merge, schema))
        if width == 1:
            return rows
        width = math.ceil(width / FAN_IN)
        rows = rows.withColumn("node", F.floor(F.col("node") / FAN_IN) if width > 1 else F.lit(0).cast("long"))


def _distinct(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    pairs = distinct(np.concatenate([_longs(p) for p in part["pairs"]]))
    return pd.DataFrame({"shard": [key[0]], "node": [key[1]], "pairs": [pairs.tobytes()]})


def _slotted(part: pd.DataFrame) -> pd.DataFrame:
    table = PerfectHash(lanes(_longs(part["pairs"].iloc[0])))
    return pd.DataFrame({"shard": part["shard"], "pairs": [table.keys[:, 0].tobytes()], "table": [table.dump()]})


def _table(row) -> PerfectHash:
    return PerfectHash.load(row["table"], lanes(_longs(row["pairs"])))


def _counted(key: tuple, part: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(part):
        return pd.DataFrame({"shard": [], "node": [], "counts": []})
    table = _table(index.iloc[0])
    counts = np.zeros(len(table), np.int64)
    for pairs, df in zip(part["pairs"], part["df"], strict=True):
        counts[table.slots(lanes(_longs(pairs)))] += _longs(df)
    return pd.DataFrame({"shard": [key[0]], "node": [key[1]], "counts": [counts.tobytes()]})


def _summed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    counts = np.sum([_longs(c) for c in part["counts"]], axis=0, dtype=np.int64)
    return pd.DataFrame({"shard": [key[0]], "node": [key[1]], "counts": [counts.tobytes()]})


def _answered(key: tuple, part: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """For every chunk of a node the counts of its pairs, in their order, negative where it isn't the A id's highest."""
    if not len(part):
        return pd.DataFrame({"chunk": [], "shard": [], "counts": []})
    row = index.iloc[0]
    table, counts = _table(row), _longs(row["counts"])
    a, at = np.unique(_longs(row["pairs"]) // STEP, return_inverse=True)
    highest = np.zeros(len(a), np.int64)
    np.maximum.at(highest, at, counts)
    marked = np.where(counts == highest[at], counts, -counts)
    out = [marked[table.slots(lanes(_longs(p)))].tobytes() for p in part["pairs"]]
    return pd.DataFrame({"chunk": part["chunk"], "shard": key[0], "counts": out})


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by ``at``, which doesn't fall."""
    before = np.r_[0, np.cumsum(values)]
    bounds = np.searchsorted(at, np.arange(n + 1))
    return before[bounds[1:]] - before[bounds[:-1]]


def _finished(a_path: str, b_path: str, shards: int):
    def finish(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row, aligner = own.iloc[0], _aligner(a_path, b_path)
        aligner.forget()  # a worker that has encoded has no use for the words here
        n, flat, a, a_n, b = (np.frombuffer(x, t) for x, t in zip(_unpacked(row["packed"], row["sizes"]), (np.int64, np.int32, np.uint16, np.int32, np.uint16), strict=True))
        pairs = _longs(row["pairs"])
        shard, marked = shard_of(pairs, shards), np.zeros(len(pairs), np.int64)
        for s, counts in zip(answers["shard"], answers["counts"], strict=True):
            marked[shard == s] = _longs(counts)
        word, pair, links = _word_links(aligner, a, a_n, b)
        at = np.searchsorted(pairs, pair)
        at[at == len(pairs)] = 0
        # pairs only of words whose text has no tokens count for no document
        here = marked[at] if len(pairs) else np.zeros(len(pair), np.int64)
        best, total = (_sums(word, links * x, len(a_n)) for x in (here > 0, np.abs(here)))
        doc = np.repeat(np.arange(len(n)), n)
        n_best, count_sum = (_sums(doc, x[flat], len(n)) for x in (best, total))
        out = {c: pd.array(list(row[c]), "Int64") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pd.DataFrame(out | {"n_best": n_best, "count_sum": count_sum, "groups_sha256": list(row["groups_sha256"])})

    return finish


def align_tokenizers(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, chunk_bytes: int = CHUNK_BYTES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a, b: vocabulary files of a byte-level BPE and of a BPE over pieces, by name or path. Null and empty texts and those
    whose bytes the tokens don't give back have no tokens: zeros and an empty hash. Repeated rows count one by one. Null ids stay null.
    Very long texts are aligned whole. Empty table: no rows. Other columns are ignored.
    """
    a_path, b_path = path_of(a), path_of(b)
    with scratch(docs.sparkSession):
        chunks = saved(aligned_chunks(docs, a_path, b_path, chunk_bytes), large=True)
        n, entries = chunks.agg(F.count("*"), F.coalesce(F.sum("n_pairs"), F.lit(0))).first()
        shards, width = min(MAX_SHARDS, max(8, math.ceil(entries / shard_entries))), max(1, math.ceil(n / FAN_IN))
        dealt = saved(_dealt(chunks, shards, width))
        distinct = _up(dealt.select("shard", "node", "pairs"), width, _distinct, _NODE)
        index = saved(distinct.select("shard", "pairs").mapInPandas(lambda parts: (_slotted(p.iloc[[i]]) for p in parts for i in range(len(p))), "shard long, pairs binary, table binary"))
        by = ["shard", "node"]
        at_nodes = lambda t: t.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
        leaves = dealt.groupBy(*by).cogroup(at_nodes(index).groupBy(*by)).applyInPandas(_counted, _VECTOR)
        counts = _up(leaves, width, _summed, _VECTOR).select("shard", "counts")
        filled = at_nodes(index.join(counts, "shard"))
        answers = dealt.groupBy(*by).cogroup(filled.groupBy(*by)).applyInPandas(_answered, "chunk long, shard long, counts binary")
        done = chunks.drop("df", "n_pairs").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_finished(a_path, b_path, shards), _DONE)
        return saved(done, keep=True)


def op12_align(spark, sf_dir):
    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
