"""Prefix trie of conversations by perfectly hashed node tables.

A node is a depth and the 128 bits of its prefix: turn digests times powers of an odd base, summed modulo 2**64 in two lanes. Such
sums can be split anywhere, so turns are sorted by range, cut into pieces wherever a batch ends, and a conversation that
spans tasks gets the sums of what comes before. Texts never move, only 16 bytes a turn do.

Shards are runs of neighbouring conversations with a bounded number of turns; in a shard, depths are cut into bands, so
one endless conversation is many groups. Each group enumerates its distinct prefixes, gives them slots of a minimal
perfect hash (a lookup compares the whole key), scatters its counts into flat arrays by slot, and, once every node knows its first
member in all shards, adds them up along the parents' slots from the deepest nodes upwards. What a node has in the groups is
summed. Subtrees stay additive because every node counts where its first member is, and the words a member saves where
that member is. What a conversation brings from beyond a band follows from where it first owns a node, without a walk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, saved, scratch
from .perfect_hash import PerfectHash, lanes

#: Turns of a shard, and depths of a band.
SHARD_TURNS = 100_000
BAND = 4096
#: Turns of a piece at most.
PIECE = 1024
#: Turns that a conversation may share with another by ``shared``.
MAX_SHARED = 3
#: Bases of the two lanes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
NOTHING = hashlib.sha256(b"").hexdigest()

_MASK = 2**64 - 1
_PIECE = "conv_id long, at long, shard long, n long, s1 long, s2 long, n_words long, digests binary, words binary"
_PLACE = "conv_id long, at long, first_shard long, ahead long, d1 long, d2 long, words_ahead long, total long, total_words long, head_t binary, head_w binary"
_LOCAL = "shard long, band long, depth long, d1 long, d2 long, p1 long, p2 long, w long, cw long, m long, e long, first long, ends string, cut long, cut_end long"
_SUMS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _powers(bases, exponents: list[int]) -> np.ndarray:
    return np.array([[pow(b, e, 2**64) for b in bases] for e in exponents], np.uint64).reshape(-1, 2)


_POWER = _powers(BASES, list(range(PIECE + 1)))
_INVERSE = _powers([pow(b, -1, 2**64) for b in BASES], list(range(MAX_SHARED + 1)))


def _digests(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, 2)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(SPACED_WORD)).cast("long").alias("words"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _cut(shard_turns: int):
    """Turns in order -> pieces: runs of one conversation within a batch, of at most PIECE turns."""

    def cut(batches):
        part, at, seen = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            conv, words, digest = b["conv_id"].to_numpy(), b["words"].to_numpy(np.int64), b["digest"].tolist()
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]) if len(conv) else np.empty(0, np.int64)
            rows = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(conv)], strict=True):
                for i in range(s, e, PIECE):
                    j = min(i + PIECE, e)
                    t = _digests(digest[i:j])
                    s1, s2 = (t * _POWER[1 : j - i + 1]).sum(axis=0, dtype=np.uint64).view(np.int64).tolist()
                    rows.append((int(conv[i]), (part << 40) + at, (part << 32) + seen // shard_turns, j - i, s1, s2, int(words[i:j].sum()), t.tobytes(), words[i:j].tobytes()))
                    at, seen = at + 1, seen + j - i
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _PIECE.split(", ")])

    return cut


def _placed(batches):
    """Pieces in order -> what lies before each; the last one of a conversation has its totals and first turns."""
    conv, ahead, d, words, head_t, head_w, shard, row = None, 0, (0, 0), 0, b"", b"", 0, None
    columns = [c.split(" ")[0] for c in _PLACE.split(", ")]
    for b in batches:
        rows = []
        for c, at, own_shard, n, s1, s2, n_words, t, w in zip(*[b[k].tolist() for k in ("conv_id", "at", "shard", "n", "s1", "s2", "n_words", "first_t", "first_w")], strict=True):
            if c != conv:
                if row:
                    rows.append((*row, ahead, words, head_t, head_w))
                conv, ahead, d, words, head_t, head_w, shard = c, 0, (0, 0), 0, b"", b"", own_shard
            elif row:
                rows.append((*row, None, None, None, None))
            row = (c, at, shard, ahead, _signed(d[0]), _signed(d[1]), words)
            d = tuple((x + s * (pow(base, ahead, 2**64) if ahead else 1)) & _MASK for x, s, base in zip(d, (s1, s2), BASES, strict=True))
            ahead, words, head_t, head_w = ahead + n, words + n_words, (head_t + t)[: 16 * MAX_SHARED], (head_w + w)[: 8 * MAX_SHARED]
        yield _nullable(rows, columns)
    if row:
        yield _nullable([(*row, ahead, words, head_t, head_w)], columns)


def _nullable(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    return out.astype({c: "Int64" for c in columns if c not in ("head_t", "head_w", "ends")})


def _padded(column: pd.Series, kind, width: int) -> np.ndarray:
    """Byte strings of up to MAX_SHARED items as an array with zeros behind them."""
    size = MAX_SHARED * width
    return np.frombuffer(b"".join([(x or b"").ljust(size, b"\0") for x in column]), kind).reshape(len(column), MAX_SHARED, -1)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = keys[np.lexsort(keys.T[::-1])]
    return keys[np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]] if len(keys) else keys


def _local(band_depth: int):
    """The pieces of a group -> its distinct nodes with local counts, and the cuts at its band's end."""

    def nodes(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        shard, band = key
        column = lambda c: p[c].to_numpy(np.int64)
        conv, ahead, n, h, total = (column(c) for c in ("conv_id", "ahead", "n", "h", "total"))
        own_w, base_w = _padded(p["own_w"], np.int64, 8)[:, :, 0], _padded(p["base_w"], np.int64, 8)[:, :, 0]
        powers = _POWER[1 : MAX_SHARED + 1]
        d_own = (_padded(p["own_t"], np.uint64, 16) * powers).sum(axis=1, dtype=np.uint64)
        d_base = np.cumsum(np.concatenate([np.zeros((len(p), 1, 2), np.uint64), _padded(p["base_t"], np.uint64, 16) * powers], axis=1), axis=1, dtype=np.uint64)
        cw_base = np.cumsum(np.concatenate([np.zeros((len(p), 1), np.int64), base_w], axis=1), axis=1)
        hb = np.array([len(x or b"") // 16 for x in p["base_t"]], np.int64)
        shift, here = h - hb, np.arange(len(p))
        end = hb + np.maximum(0, total - h)
        cw_grafted = cw_base[here, hb] - own_w.sum(axis=1)  # what the graft changes in the words so far

        # every own turn: its place in the rebuilt conversation and the prefix that ends there
        t, w = _digests(p["digests"].tolist()), np.frombuffer(b"".join(p["words"]), np.int64)
        of, first = np.repeat(here, n), np.cumsum(n) - n
        inside = np.arange(len(of)) - first[of]
        own = t * _powers(BASES, ahead.tolist())[of] * _POWER[inside + 1]
        sums = np.cumsum(own, axis=0, dtype=np.uint64)
        sums += (np.stack([column("d1"), column("d2")], axis=1).view(np.uint64) - (sums - own)[first])[of]
        grafted = lambda x: d_base[of, hb[of]] + _INVERSE[shift[of]] * (x - d_own[of])
        prefix, before = grafted(sums), grafted(sums - own)
        cw = np.cumsum(w)
        cw += (column("words_ahead") - (cw - w)[first] + cw_grafted)[of]
        depth = ahead[of] + inside + 1 - shift[of]
        used = (depth > hb[of]) & ((depth - 1) // band_depth == band)

        parts = [(depth[used], prefix[used], before[used], w[used], cw[used], conv[of[used]])]
        for i in range(MAX_SHARED + 1) if band == 0 else ():
            at = np.flatnonzero((ahead == 0) & (hb >= i))
            parts.append((np.full(len(at), i), d_base[at, i], d_base[at, max(0, i - 1)], base_w[at, i - 1] if i else np.zeros(len(at), np.int64), cw_base[at, i], conv[at]))
        depths, prefixes, parents, ws, cws, convs = (np.concatenate(c) for c in zip(*parts, strict=True))

        last = np.flatnonzero((ahead + n == total) & (np.maximum(0, end - 1) // band_depth == band))
        to = (first + n - 1)[last]
        end_keys = lanes(end[last], *np.where((total > h)[last, None], prefix[to], d_base[last, hb[last]]).view(np.int64).T)
        ghosts = depths == band * band_depth + 1 if band else np.zeros(len(depths), bool)
        keys, parent_keys = lanes(depths, *prefixes.view(np.int64).T), lanes(depths - 1, *parents.view(np.int64).T)
        found = _distinct(np.concatenate([keys, end_keys, parent_keys[ghosts]]))
        table = PerfectHash(found)
        slot, size = table.slots(keys), len(table)
        m, e = np.bincount(slot, minlength=size), np.bincount(table.slots(end_keys), minlength=size)
        first_conv = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(first_conv, slot, convs)
        flat = {c: np.zeros(size, np.int64) for c in ("p1", "p2", "w", "cw")}
        for c, x in (("p1", parents[:, 0].view(np.int64)), ("p2", parents[:, 1].view(np.int64)), ("w", ws), ("cw", cws)):
            flat[c][slot] = x
        ends: dict[int, list[int]] = {}
        order = np.argsort(conv[last], kind="stable")
        for s, c in zip(table.slots(end_keys)[order].tolist(), conv[last][order].tolist(), strict=True):
            ends.setdefault(s, []).append(c)
        out = pd.DataFrame(dict(zip(("depth", "d1", "d2"), table.keys.view(np.int64).T, strict=True)) | flat | {"m": m, "e": e})
        out["first"] = pd.array(first_conv, "Int64")
        out.loc[m == 0, "first"] = pd.NA
        out["ends"] = [",".join(map(str, ends[s])) if s in ends else None for s in range(size)]

        on = used & (depth % band_depth == 0) & (depth < end[of])
        cuts = pd.DataFrame({"depth": depth[on], "d1": prefix[on, 0].view(np.int64), "d2": prefix[on, 1].view(np.int64), "cw": cw[on], "cut": conv[of[on]], "cut_end": (column("total_words") + cw_grafted)[of[on]]})
        columns = [c.split(" ")[0] for c in _LOCAL.split(", ")]
        kinds = {c: "Int64" for c in columns if c != "ends"}  # not floats where a column is missing
        both = [x.assign(shard=shard, band=band).reindex(columns=columns).astype(kinds) for x in (out, cuts)]
        return pd.concat(both, ignore_index=True) if len(cuts) else both[0]

    return nodes


def _accumulated(band_depth: int):
    """The nodes of a group, with what is known of them everywhere -> what their subtrees have in the group."""

    def accumulate(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        band, tail = key[1], (p["m"] < 0).to_numpy()
        own, tails = p[~tail], p[tail]
        number = lambda c, of=own: of[c].to_numpy(np.int64)
        depth, m = number("depth"), number("m")
        table = PerfectHash(lanes(depth, number("d1"), number("d2")))
        slot, size = table.slots(lanes(depth, number("d1"), number("d2"))), len(table)
        flat = lambda x: (out := np.zeros(size, np.int64), out.__setitem__(slot, x))[0]
        owned = (m > 0) & (number("first") == number("conv_id"))
        conv, at, n_convs, mine = flat(number("conv_id")), flat(depth), flat(number("n_convs")), flat(owned)
        leaves = flat(owned & (number("n_ends") == number("n_convs")))
        saves = flat((m - owned) * number("w"))
        ghost = at == band * band_depth if band else np.zeros(size, bool)
        parent = flat(table.slots(lanes(depth - 1, number("p1"), number("p2"))))
        parent[ghost | (at == 0)] = -1
        if len(tails):
            to = table.slots(lanes(*(number(c, tails) for c in ("depth", "d1", "d2"))))
            np.add.at(leaves, to, number("tail_leaf", tails))
            np.add.at(saves, to, number("tail_saved", tails))
        children = np.zeros(size, np.int64)
        has = parent >= 0
        np.add.at(children, parent[has], mine[has])
        order = np.argsort(at, kind="stable")
        for level in reversed(np.split(order, np.flatnonzero(np.diff(at[order])) + 1)):
            level = level[has[level]]
            np.add.at(leaves, parent[level], leaves[level])
            np.add.at(saves, parent[level], saves[level])
        leaves[ghost], saves[ghost] = 0, 0  # the band above has them as its tails
        up = pd.array(conv[parent], "Int64")
        up[~has] = pd.NA
        return pd.DataFrame({"conv_id": conv, "depth": at, "parent_conv_id": up, "n_convs": n_convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saves})

    return accumulate


def _hashed(batches):
    """(conv_id, depth, ends) in order of node and shard -> the hash of each node's ends, fed a shard at a time."""
    key, digest = None, None
    for b in batches:
        rows = []
        for c, d, ends in zip(b["conv_id"].tolist(), b["depth"].tolist(), b["ends"], strict=True):
            if (c, d) != key:
                if key:
                    rows.append((*key, digest.hexdigest()))
                key, digest = (c, d), hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pd.DataFrame(rows, columns=["conv_id", "depth", "ends_sha256"])
    if key:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])


def conversation_trie(conversations: DataFrame, base: Column | None = None, shared: Column | None = None, shard_turns: int = SHARD_TURNS, band: int = BAND) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row per distinct prefix: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    base, shared: Columns over conv_id. A conversation then begins with the first ``shared`` turns (at most MAX_SHARED) of conversation
    ``base`` in place of as many of its own; where that has fewer, with those. Turns are in order of turn, null first; those with one
    turn are in order of an md5 of role and text, so repeated rows stay, one after another. Null role or text: empty. Rows without a
    conv_id take no part. Very long conversations are cut and their sums carried on. Empty table: no rows. Other columns are ignored.
    """
    spark = conversations.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    with scratch(spark):
        ranged = saved(_turns(conversations)).repartitionByRange(*order).sortWithinPartitions(*order)
        pieces = saved(ranged.select("conv_id", "words", "digest").mapInPandas(_cut(shard_turns), _PIECE))
        heads = pieces.withColumns({"first_t": F.substring("digests", 1, 16 * MAX_SHARED), "first_w": F.substring("words", 1, 8 * MAX_SHARED)}).drop("digests", "words")
        placed = saved(heads.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInPandas(_placed, _PLACE))
        convs = placed.where("total is not null").select("conv_id", "total", "total_words", "head_t", "head_w")
        h = (shared if shared is not None else F.lit(0)).cast("long")
        bases = convs.select(F.col("conv_id").alias("base_id"), F.col("head_t").alias("base_t"), F.col("head_w").alias("base_w"))
        convs = convs.withColumns({"h": h, "base": base if base is not None else F.col("conv_id")}).join(bases, F.col("base") == F.col("base_id"), "left")
        up_to = lambda c, width: F.substring(F.col(c), F.lit(1), (F.col("h") * width).cast("int"))
        convs = convs.select("conv_id", "total", "total_words", "h", up_to("base_t", 16).alias("base_t"), up_to("base_w", 8).alias("base_w"), up_to("head_t", 16).alias("own_t"), up_to("head_w", 8).alias("own_w"))
        where = placed.drop("total", "total_words", "head_t", "head_w").join(convs, "conv_id").drop("conv_id")
        hb = F.coalesce(F.octet_length("base_t") / 16, F.lit(0)).cast("long")
        lowest = F.when(F.col("ahead") == 0, 0).otherwise(F.greatest(F.lit(0), F.floor((F.greatest("ahead", "h") - F.col("h") + hb) / band)))
        highest = F.floor((F.col("ahead") + F.col("n") - F.col("h") + hb - 1) / band)
        full = pieces.select("conv_id", "at", "n", "digests", "words").join(where, "at")
        full = full.withColumn("band", F.explode(F.sequence(lowest.cast("long"), F.greatest(lowest, highest).cast("long"))))
        local = saved(full.groupBy("first_shard", "band").applyInPandas(_local(band), _LOCAL))

        node = ["depth", "d1", "d2"]
        nodes, cuts = local.where("cut is null").drop("cut", "cut_end"), local.where("cut is not null")
        everywhere = nodes.groupBy(*node).agg(F.min("first").alias("conv_id"), F.sum("m").alias("n_convs"), F.sum("e").alias("n_ends"))
        known = saved(nodes.join(everywhere, node))
        owners = known.where("first = conv_id").join(cuts.select(F.col("cut").alias("conv_id")).distinct(), "conv_id", "left_semi")
        owners = owners.groupBy("conv_id").agg(F.min_by(F.col("cw") - F.col("w"), "depth").alias("before"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"))
        tails = cuts.join(owners, cuts["cut"] == owners["conv_id"], "left")
        tails = tails.select("shard", "band", *node, F.coalesce("leaf", F.lit(0)).alias("tail_leaf"), F.greatest(F.lit(0), F.coalesce("before", "cut_end") - F.col("cw")).alias("tail_saved"))
        tails = tails.groupBy("shard", "band", *node).agg(F.sum("tail_leaf").alias("tail_leaf"), F.sum("tail_saved").alias("tail_saved"))
        # no nulls, as they would turn whole columns into floats
        fields = ["p1", "p2", "w", "m", "first", "conv_id", "n_convs", "n_ends", "tail_leaf", "tail_saved"]
        filled = lambda t: t.select("shard", "band", *node, *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in t.columns else F.lit(-1 if c == "m" else 0).cast("long").alias(c) for c in fields])
        both = filled(known).unionByName(filled(tails))
        parts = both.groupBy("shard", "band").applyInPandas(_accumulated(band), _SUMS)
        out = parts.groupBy("conv_id", "depth").agg(F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
        ends = known.where("ends is not null").select("conv_id", "depth", "shard", "ends").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "shard")
        hashes = ends.mapInPandas(_hashed, "conv_id long, depth long, ends_sha256 string")
        out = out.join(hashes, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
        return saved(out, keep=True)


def op11_trie(spark, sf_dir):
    conv = F.col("conv_id")
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4)


OP11_SQL = rf"""
with t as (
  select conv_id, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as turn_id,
    row_number() over (partition by conv_id order by turn nulls first, turn_id) as j, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as words
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 20 as base, xor(4294967295, list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint),
    lambda r, x: list_reduce([xor(r, x), 1, 2, 3, 4, 5, 6, 7, 8], lambda s, i: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end), 4294967295)) % 4 as h
  from (select distinct conv_id from t)),
r as (
  select c.conv_id, t.j as pos, t.turn_id, t.words from c join t on t.conv_id = c.base and t.j <= c.h
  union all
  select c.conv_id, t.j - c.h + (select count(*) from t b where b.conv_id = c.base and b.j <= c.h), t.turn_id, t.words from c join t on t.conv_id = c.conv_id and t.j > c.h),
p as (
  select conv_id, 0 as depth, '' as path, 0 as words from c
  union all
  select conv_id, pos, string_agg(turn_id, '' order by pos) over (partition by conv_id order by pos), words from r),
n as (select depth, path, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from p group by depth, path),
k as (select a.depth, a.path, count(b.path) as n_children from n a left join n b on b.depth = a.depth + 1 and left(b.path, length(a.path)) = a.path group by a.depth, a.path),
s as (
  select a.depth, a.path, count(*) filter (k.n_children = 0) as n_leaves, sum((d.n_convs - 1) * d.words) as saved_tokens
  from n a join n d on d.depth >= a.depth and left(d.path, length(a.path)) = a.path join k on k.depth = d.depth and k.path = d.path group by a.depth, a.path),
e as (
  select depth, path, string_agg(conv_id::varchar, ',' order by conv_id) as ends
  from (select conv_id, arg_max(depth, depth) as depth, arg_max(path, depth) as path from p group by conv_id) group by depth, path)
select n.conv_id, n.depth::bigint as depth, up.conv_id as parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens::bigint as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from n join k using (depth, path) join s using (depth, path) left join e using (depth, path)
left join n up on up.depth = n.depth - 1 and up.path = left(n.path, 32 * (n.depth - 1))
"""
