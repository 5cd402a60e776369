"""Near-duplicate documents by HyperMinHash.

A document's set holds the 64-bit hashes of its distinct shingles of ``SHINGLE`` words. Documents with
equal sets are one node from the start. A node's sketch has REGISTERS buckets; a bucket keeps, for its
smallest hash, the number of leading zeros and the next MANTISSA bits. For banding alone, empty
registers borrow from full ones. Bands of ROWS registers name candidates: at a similarity of 0.75 two sets
share none of the 73 bands with a probability of 3e-5, at 0.8 with one of 4e-8; at 0.4 they
share one with 11 %.

No group is expanded into pairs. Buckets of equal node sets are one. In each bucket every node is held
against one other, the bucket's pivot. Candidates pass the estimate from their sketches, corrected
for chance collisions, before their full sets are compared.

What is then left are buckets with several components. Their sketches are dealt in blocks of
bounded size, block against block (nodes of the largest component only against the others), and close
ones join into families; each block sends fewer edges than it has nodes. Families, of close pairs and
of links together, are dealt in blocks in the same way, now with full sets, and the links found
there again are sent as a forest. Links join into components by the smallest id. So every pair
that shares a band is compared, in memory, unless links already join it. A bucket or family of n nodes
that few links join is sent about n / BLOCK times, block against block: there the work grows with n * n.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quirefold.operators.folds import fold_sorted

from .common import hinted, row_key, saved, scratch
from .rolling import Ranges, buffers, chunks, mix, signed

SHINGLE = 5
SIMILARITY = (75, 100)
REGISTERS = 512
ROWS = 7
MANTISSA = 10
#: Nodes in a block of sketches.
BLOCK = 512
#: Registers that are looked at before all of them.
QUICK = 32
#: Nodes, and bytes of their sets, in a block of full sets.
FAMILY_BLOCK, FAMILY_BYTES = 256, 16 << 20
CHUNK = 1 << 20
#: A candidate is compared in full unless its estimate is this many standard deviations short.
DEVIATIONS = 6.0
MAX_BROADCAST = 48 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TIMES = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """Per text, the sorted distinct hashes of its shingles; a shorter text is one shingle."""
    data, offsets = buffers(texts)
    for first, last in chunks(offsets, CHUNK):
        a, b = int(offsets[first]), int(offsets[last])
        part = _LOWER[data[a:b]]
        edges = offsets[first : last + 1] - a
        space = np.r_[True, _SPACE[part], True]
        bound = np.zeros(len(part) + 1, bool)
        bound[edges] = True
        starts = np.flatnonzero(~space[1:-1] & (space[:-2] | bound[:-1]))
        ends = np.flatnonzero(~space[1:-1] & (space[2:] | bound[1:])) + 1
        words = Ranges(part).hash(starts, ends - starts) if len(starts) else np.empty(0, np.uint64)
        owner = np.searchsorted(edges, starts, side="right") - 1
        n = len(words) - size + 1
        rolled = np.zeros(max(0, n), np.uint64)
        for k in range(size):
            rolled += words[k : k + max(0, n)] * _TIMES[k]
        rolled = mix(rolled)
        at = np.searchsorted(owner, np.arange(last - first + 1))
        for i in range(last - first):
            f, l = int(at[i]), int(at[i + 1])
            if l - f >= size:
                yield np.unique(rolled[f : l - size + 1])
            elif l > f:
                yield mix(np.array([(words[f:l] * _TIMES[: l - f]).sum() + np.uint64(l - f)], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers per sorted set; 0 is an empty bucket."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    shift = np.uint64(64 - int(REGISTERS).bit_length() + 1)
    bucket = (every >> shift).astype(np.int64)
    first = np.r_[True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]
    rest = (every[first] & ((np.uint64(1) << shift) - np.uint64(1))) >> (shift - np.uint64(53))
    zeros = 53 - np.frexp(rest.astype(np.float64))[1]
    zeros = np.where(rest == 0, 53, zeros)
    tail = ((rest << zeros.astype(np.uint64)) >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out[row[first], bucket[first]] = (zeros << MANTISSA) + tail.astype(np.int64) + 1
    return out


def set_hash(s: np.ndarray) -> int:
    """64 bits that name a set."""
    x = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    return int(signed(mix(np.array([x.sum() + np.uint64(len(s))], np.uint64) ^ mix(np.array([np.bitwise_xor.reduce(x)], np.uint64))))[0]) if len(s) else 0


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of paired sketches without chance collisions, and its standard deviation at 0.75.

    Two different sets agree in a register with the chance that their minima have the same zeros and
    mantissa, about 2**-MANTISSA / 1.5; in a brief one with that of equal bytes.
    """
    used = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    chance = 1 / 255 if a.dtype == np.uint8 else 2.0**-MANTISSA / 1.5
    raw = same / np.maximum(1, used)
    return (raw - chance) / (1 - chance), np.sqrt(0.1875 / np.maximum(1, used))


def _brief(regs: np.ndarray) -> np.ndarray:
    """Every other register in one byte; 0 is empty."""
    x = regs[:, ::2].astype(np.uint32)
    return np.where(x == 0, 0, 1 + ((x * np.uint32(0x9E3779B1)) >> np.uint32(8)) % 255).astype(np.uint8)


@F.pandas_udf(BinaryType())
def _brief_udf(regs: pd.Series) -> pd.Series:
    return pd.Series([_brief(np.frombuffer(x, np.uint16)[None]).tobytes() for x in regs], dtype=object)


def _far(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    value, deviation = estimate(a, b)
    return value < threshold - DEVIATIONS * deviation


def sketches(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, node (hash of the set), n, regs. n = 0: no words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, held = batch.column("doc_id"), []
            at = 0

            def out(at, held):
                regs = sketch(held)
                return pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(held)), pa.array([set_hash(s) for s in held], pa.int64()), pa.array([len(s) for s in held], pa.int64()),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["doc_id", "node", "n", "regs"],
                )

            for s in shingle_sets(batch.column("text")):
                held.append(s)
                if len(held) == 512:
                    yield out(at, held)
                    at, held = at + len(held), []
            if held:
                yield out(at, held)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, n long, regs binary")


def _orders() -> np.ndarray:
    """For each register, all registers in an order of its own: row t holds everyone's t-th."""
    every = np.arange(REGISTERS * REGISTERS, dtype=np.uint64).reshape(REGISTERS, REGISTERS)
    return np.ascontiguousarray(np.argsort(mix(every + np.uint64(1)), axis=1).T)


def filled(regs: np.ndarray) -> np.ndarray:
    """Sketches whose empty registers have the value of the first one in their order that has one.

    Two sets then agree in every register with a chance of their similarity, however few of its
    registers a short text has filled; empty registers that agree would name false candidates.
    """
    out, orders = regs.copy(), _orders()
    row, col = np.nonzero((regs == 0) & (regs != 0).any(1)[:, None])
    for order in orders:
        if not len(row):
            break
        value = regs[row, order[col]]
        got = value != 0
        out[row[got], col[got]] = value[got]
        row, col = row[~got], col[~got]
    return out


def bands(made: DataFrame) -> DataFrame:
    """(node, regs) -> (band, node): a row per band; rows that repeat within a batch count once."""
    n_bands = REGISTERS // ROWS
    times = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for b in batches:
            node, first = np.unique(b.column("node").to_numpy(), return_index=True)
            held = b.column("regs").take(pa.array(first)).to_pylist()
            for start in range(0, len(node), 1024):
                regs = filled(np.stack([np.frombuffer(x, np.uint16) for x in held[start : start + 1024]]))
                some = regs[:, : n_bands * ROWS].reshape(-1, n_bands, ROWS)
                keys = mix((some.astype(np.uint64) * times).sum(-1) + (np.arange(n_bands, dtype=np.uint64) << np.uint64(56)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), pa.array(np.repeat(node[start : start + 1024], n_bands))], ["band", "node"])

    return made.select("node", "regs").mapInArrow(run, "band long, node long")


def _close(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) pairs that pass the sizes and the estimate."""
    n = nodes.select("node", "n", "regs")
    left = n.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = n.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    both = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))

    @F.pandas_udf("boolean")
    def near(ra: pd.Series, rb: pd.Series) -> pd.Series:
        if not len(ra):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (ra, rb))
        return pd.Series(~_far(a, b, threshold))

    return both.where(near("ra", "rb")).select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes): full sets of the wanted nodes, made from the texts once more and written out."""
    wanted = saved(wanted.distinct().join(nodes.select("node", "tk"), "node"))
    texts = docs.select(row_key().alias("tk"), "text")
    some = texts.join(hinted(wanted, 24, MAX_BROADCAST), "tk").dropDuplicates(["node"])

    def run(batches):
        for b in batches:
            made = [s.tobytes() for s in shingle_sets(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(made, pa.binary())], ["node", "hashes"])

    return saved(some.select("node", "text").mapInArrow(run, "node long, hashes binary"))


def _linked(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) pairs whose full sets are similar enough."""
    num, den = similarity
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))

    @F.pandas_udf("boolean")
    def alike(ha: pd.Series, hb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(ha, hb, strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = int((np.searchsorted(b, a, side="right") - np.searchsorted(b, a, side="left")).sum())
            out.append(den * common >= num * (len(a) + len(b) - common))
        return pd.Series(out, dtype=bool)

    return pairs.join(left, "a").join(right, "b").where(alike("ha", "hb")).select("a", "b")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, comp): the smallest node that can be reached, for nodes with an edge.

    Each round hooks a node to the first of itself and its neighbours, in an order that changes from
    round to round, follows the hook once more, and puts the hooks in the place of the nodes. Edges within
    a tree go, so the graph shrinks by a factor a round, whatever its shape is; hooks are written out
    between rounds, and composed at the end.
    """
    left = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    hooks: list[DataFrame] = []
    while not left.isEmpty():
        if len(hooks) == most_rounds:
            raise RuntimeError("components did not settle")
        turn = F.lit(int(signed(mix(np.array([len(hooks) + 1], np.uint64)))[0]))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(turn)).alias("m"))
        one = saved(first.select(F.col("a").alias("node"), F.least("m", F.col("a").bitwiseXOR(turn)).bitwiseXOR(turn).alias("top")))
        up = one.select(F.col("node").alias("top"), F.col("top").alias("next"))
        hook = saved(one.join(up, "top").select("node", F.col("next").alias("top")))
        hooks.append(hook)
        of = lambda c: hook.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}"))  # noqa: E731, B023
        on = left.join(of("a"), "a").join(of("b"), "b").where("top_a <> top_b")
        left = saved(on.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct())
    if not hooks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    labels = hooks[0]
    for hook in hooks[1:]:
        up = hook.select(F.col("node").alias("top"), F.col("top").alias("next"))
        labels = labels.join(up, "top", "left").select("node", F.coalesce("next", "top").alias("top"))
    labels = saved(labels)
    smallest = saved(labels.groupBy("top").agg(F.min("node").alias("comp")))
    return saved(labels.join(hinted(smallest, 16, MAX_BROADCAST), "top").select("node", "comp"))


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what a symmetric matrix joins: fewer than its rows, however dense it is."""
    left, a, b = np.ones(len(linked), bool), [], []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(linked[x] & left)
            left[new] = False
            a += [x] * len(new)
            b += new.tolist()
            todo += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _dealt(rows: DataFrame, key: str, size: int, weight: Column | None = None) -> DataFrame:
    """(key, node, comp, ...) -> the same with group: pairs of blocks of each key's nodes.

    The nodes of the key's largest component are paired with the others alone, which keeps a key with
    one large component linear; the others are paired with each other. A block holds about ``size``
    nodes, fewer if ``weight`` (a column of units of work) adds up to more.
    """
    load = F.sum(weight if weight is not None else F.lit(1.0))
    comps = saved(rows.groupBy(key, "comp").agg(F.count("*").alias("c"), load.alias("u")))
    totals = comps.groupBy(key).agg(F.sum("c").alias("rows"), F.sum("u").alias("units"), F.max(F.struct("c", "comp", "u")).alias("big"))
    blocks = lambda c, u: F.greatest(F.lit(1), F.ceil(F.greatest(c, u) / size)).cast("long")
    plan = saved(totals.select(
        key, F.col("big.comp").alias("big"), blocks(F.col("big.c"), F.col("big.u")).alias("nb"), blocks(F.col("rows") - F.col("big.c"), F.col("units") - F.col("big.u")).alias("nr"),
    ))
    at = rows.join(plan, key).withColumn("is_big", F.col("comp") == F.col("big"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_big"), F.col("nb")).otherwise(F.col("nr")))
    at = at.withColumn("own", own)
    seq = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # of a big block: every block of the others; of another: every big block, and every block of the others
    name = lambda kind, x, y: F.xxhash64(F.col(key), F.lit(kind), x, y)
    big = F.transform(seq(F.col("nr")), lambda j: name("b", F.col("own"), j))
    rest = F.concat(
        F.transform(seq(F.col("nb")), lambda i: name("b", i, F.col("own"))),
        F.transform(seq(F.col("nr")), lambda j: name("r", F.least(F.col("own"), j), F.greatest(F.col("own"), j))),
    )
    group = F.explode(F.when(F.col("is_big"), big).otherwise(rest))
    return at.select("*", group.alias("group")).drop("big", "nb", "nr", "is_big", "own", key)


def _families(left: DataFrame, threshold: float) -> DataFrame:
    """(band, node, comp, n, brief) -> (a, b): edges that join close sketches of different components within a bucket."""

    def close(g):
        node, first = np.unique(g["node"], return_index=True)
        comp, n = g["comp"][first], g["n"][first]
        if (comp == comp[0]).all():
            return {"a": node[:0], "b": node[:0]}
        regs = np.frombuffer(b"".join(g["brief"][first]), np.uint8).reshape(-1, REGISTERS // 2)
        near = np.zeros((len(node), len(node)), bool)
        step = max(1, (1 << 20) // (len(node) * QUICK))
        quick, held = regs[:, :QUICK], (regs[:, :QUICK] != 0).astype(np.float32)
        own = held.sum(1)
        for r in range(0, len(node), step):
            some = slice(r, r + step)
            fit = (comp[some, None] != comp) & (np.minimum(n[some, None], n) >= threshold * np.maximum(n[some, None], n))
            fit &= np.arange(r, r + len(fit))[:, None] < np.arange(len(node))
            same = ((quick[some, None, :] == quick) & (quick[some, None, :] != 0)).sum(-1, dtype=np.int32)
            used = np.maximum(1, own[some, None] + own - held[some] @ held.T)
            fit &= same / used >= threshold - DEVIATIONS * np.sqrt(0.1875 / used)
            i, j = np.nonzero(fit)
            good = ~_far(regs[i + r], regs[j], threshold)
            near[i[good] + r, j[good]] = True
        a, b = _forest(near | near.T)
        return {"a": node[a], "b": node[b]}

    dealt = _dealt(left, "band", BLOCK).select("group", "node", "comp", "n", "brief")
    return fold_sorted(dealt, "group", ["node"], close, "group long, a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links_within(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(family, node, comp, hashes) -> (a, b): edges that join sets that are similar enough, of different components, within a family.

    Common shingles of all pairs of two blocks are counted by a product of incidence matrices over the
    shingles that two sets at least hold, some thousand at a time.
    """
    num, den = similarity

    def links(g):
        node, first = np.unique(g["node"], return_index=True)
        comp = g["comp"][first]
        sets = [np.frombuffer(x, np.uint64) for x in g["hashes"][first]]
        n = np.array([len(s) for s in sets])
        if (comp == comp[0]).all():
            return {"a": node[:0], "b": node[:0]}
        row = np.repeat(np.arange(len(sets)), n)
        _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        held = count[back] > 1
        row, col = row[held], number[back[held]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        common = np.zeros((len(sets), len(sets)), np.float64)
        width = 4096
        for start in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            lo, hi = np.searchsorted(col, (start, start + width))
            part = np.zeros((len(sets), width), np.float32)
            part[row[lo:hi], col[lo:hi] - start] = 1
            common += part @ part.T
        union = n[:, None] + n - common
        a, b = _forest((den * common >= num * union) & (comp[:, None] != comp))
        return {"a": node[a], "b": node[b]}

    dealt = _dealt(members, "family", FAMILY_BLOCK, F.length("hashes") / F.lit(FAMILY_BYTES / FAMILY_BLOCK)).select("group", "node", "comp", "hashes")
    return fold_sorted(dealt, "group", ["node"], links, "group long, a long, b long").select("a", "b").distinct()


def _shared(made: DataFrame) -> DataFrame:
    """(band, node) of the buckets that hold two nodes or more.

    The rows are dealt by band once and sorted there; a row stays if one beside it has the same band and
    another node, so a task holds one batch, however full a bucket is.
    """

    def run(batches):
        held = np.empty((2, 0), np.int64)  # the last row, and whether the row before it has its band
        open_ = False
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("band", "node")])], axis=1)
            new = np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)] if rows.shape[1] else np.empty(0, bool)
            rows = rows[:, new]
            if not rows.shape[1]:
                continue
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.r_[open_ and held.shape[1] > 0, same] | np.r_[same, False]
            last, open_ = rows[:, -1:], bool(same[-1]) if len(same) else open_ and held.shape[1] > 0
            keep[-1], held = False, last
            yield pa.RecordBatch.from_arrays([pa.array(rows[0, keep]), pa.array(rows[1, keep])], ["band", "node"])
        if held.shape[1] and open_:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["band", "node"])

    return bands(made).repartition("band").sortWithinPartitions("band", "node").mapInArrow(run, "band long, node long")


def _buckets(shared: DataFrame) -> DataFrame:
    """(band, node) -> (band, node, pivot), once for each set of nodes that a bucket holds.

    A bucket's pivot is the node that stands in the fullest buckets: where copies were made from one
    original, that is the original, and a bucket's links come together through it.
    """
    names = shared.groupBy("band").agg(F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"), F.count("*").alias("rows"))
    once = saved(names.groupBy("x", "y", "rows").agg(F.min("band").alias("band")).select("band", "rows"))
    at = saved(shared.join(hinted(once, 16, MAX_BROADCAST), "band"))
    weight = at.groupBy("node").agg(F.sum("rows").alias("weight"))
    weighed = at.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot"))
    return saved(at.join(weighed, "band").select("band", "node", "pivot"))


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, key: str | None = None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id, kept, one row per row.

    Null and wordless texts have no shingles and are linked with nothing. Texts with fewer words than
    a shingle have one. Repeated ids share a component only if their texts do; component_id is the
    smallest id of the component, kept holds where that is the row's own. Rows with a null id take
    part; an all-null component has a null id and its rows are not kept. Empty table: no rows. Other
    columns are ignored. ``key`` names a column of ``row_key`` to add.
    """
    with scratch(docs.sparkSession):
        made, named = _components(docs, similarity)
    out = made.join(hinted(named, 32, MAX_BROADCAST), "node", "left")
    comp = F.when((F.col("n") > 0) & F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    more = [F.col("tk").alias(key)] if key else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"), *more)


def _components(docs: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tk, node, n) of every row, and (node, component_id) of the nodes that have links or copies."""
    threshold = similarity[0] / similarity[1]
    texts = docs.select("doc_id", "text")
    keyed = texts.select(F.struct("doc_id", row_key().alias("tk")).alias("doc_id"), "text")
    made = saved(sketches(keyed).select("doc_id.doc_id", "doc_id.tk", "node", "n", "regs"))
    full = made.where("n > 0")
    nodes = saved(full.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("tk").alias("tk"), F.min("n").alias("n"), F.count("*").alias("copies")))
    buckets = _buckets(saved(_shared(full)))
    wanted = saved(buckets.select("node").distinct().join(nodes.select("node", "tk"), "node"))
    # one sketch of each node with company; rows that repeat are the only ones left to drop
    company = full.join(hinted(wanted, 24, MAX_BROADCAST), ["node", "tk"]).dropDuplicates(["node"])
    company = saved(company.select("node", "n", "regs", _brief_udf("regs").alias("brief")))
    cand = buckets.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    close = saved(_close(cand, company, threshold))
    links = saved(_linked(close, _sets(docs, nodes, close.select(F.col("a").alias("node")).union(close.select("b"))), similarity))
    labels = components(links)
    # buckets of three nodes or more that are not one component yet
    at = saved(buckets.join(labels, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp")))
    open_ = saved(at.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("rows")).where("c0 <> c1 and rows > 2").select("band"))
    edges = saved(_families(at.join(open_, "band").join(company.select("node", "n", "brief"), "node"), threshold))
    if not edges.isEmpty():
        # families by close pairs and by links: nodes of one component that were not compared meet here
        families = components(edges.unionByName(links)).withColumnRenamed("comp", "family")
        members = saved(families.join(labels, "node", "left").select("family", "node", F.coalesce("comp", "node").alias("comp")))
        several = members.groupBy("family").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("family")
        members = saved(members.join(several, "family"))
        found = _links_within(members.join(_sets(docs, nodes, members.select("node")), "node"), similarity)
        links = saved(links.unionByName(found))
        labels = components(links)
    # only nodes that have links or copies need an id that isn't their row's own
    joined = nodes.join(labels, "node", "left").where("comp is not null or copies > 1").select("node", "first_id", F.coalesce("comp", "node").alias("comp"))
    smallest = joined.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = saved(joined.join(smallest, "comp").select("node", "component_id", F.lit(True).alias("named")), keep=True)
    return saved(made.select("doc_id", "tk", "node", "n"), keep=True), named


def op8_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Common shingles of all pairs of documents, and the transitive closure of their links.
OP8_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as x from d, unnest(range(1, greatest(1, len(w) - 4) + 1)) as u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * c >= 75 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
reach as (select a as doc_id, b as other from e union select reach.doc_id, e.b from reach join e on reach.other = e.a),
m as (select doc_id, min(other) as m from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(least(m, d.doc_id), d.doc_id) as component_id, coalesce(m >= d.doc_id, true) as kept from d left join n using (doc_id) left join m using (doc_id)
"""
