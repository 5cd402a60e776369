"""Perfect hashing, conversation tries, tokenizer alignment and packing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyarrow.parquet import ParquetFile
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirefold.llm import packing
from quirefold.llm.conversation_trie import conversation_trie, op11_trie
from quirefold.llm.packing import best_fit, cuts, op13_pack, pack, pack_documents
from quirefold.llm.perfect_hash import PerfectHash, lanes
from quirefold.llm.token_alignment import align_tokenizers, op12_align
from quirefold.llm.tokens import BYTE_BPE, PIECE_BPE, byte_bpe, path_of

TRICKY = [
    "", None, " a", "a ", "a  b", "a \n b", "a\n b\n \n  c", "x▁y", "<|endoftext|> hi", "hi <|endoftext|>", "<s> a </s>", "日本語 テキスト です", "a  b", "é ñ 🎉🎉 \U00030000",
    "a" * 5000, "\x00 \x01", "tab\t\tx \t y", "'s don't  it's", "1234567 89", "ab " * 2000, "İstanbul ɐɐ", "\x1c \x1d a", " ", "  ", "\n", "a\r\n b", "<0x0A> ▁", "word " * 3000 + "end",
]


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(lanes(rng.integers(-5, 10**6, n), rng.integers(-(2**62), 2**62, n)), axis=0)
        table = PerfectHash(keys)
        slots = table.slots(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        again = PerfectHash.load(table.dump(), table.keys)
        assert (again.slots(keys) == slots).all()
        assert (again.slots(lanes(rng.integers(10**7, 10**8, 100), rng.integers(0, 9, 100))) == -1).all()
    with pytest.raises(ValueError):
        PerfectHash(lanes(np.array([3, 3]), np.array([4, 4])))


# conversations


def trie(rows, graft):
    """Every node by walking whole prefixes."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    paths = {c: tuple(p) for c, p in own.items()}
    if graft:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 4
            paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in children[p])
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONVERSATION = "conv_id long, turn long, role string, text string"


def grafts():
    conv = F.col("conv_id")
    return {"base": conv - conv % 20, "shared": F.crc32(conv.cast("string").cast("binary")) % 4}


def test_trie_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    same(op11_trie(spark, sf).select(NODE).collect(), trie(rows, True))


@pytest.mark.parametrize(("seed", "graft", "shard_turns", "band"), [(1, True, 7, 4), (2, False, 40, 6), (3, True, 10**5, 5), (4, False, 10**5, 4096)])
def test_trie_brute_force(spark, seed, graft, shard_turns, band):
    """Shared prefixes, ties, nulls, repeats, conversations over many bands, shards and pieces."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-30, 70), 60):
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 9, 30])):
            text = rng.choice(["a b", "a b", "c", None, "", "x y z"]) if rng.random() < 0.3 else "the same text"
            rows.append((c if rng.random() > 0.02 else None, rng.choice([None, t, t, t]), rng.choice(["user", None, ""]) if rng.random() < 0.1 else "u", text))
    rng.shuffle(rows)
    clashing = spark.createDataFrame(rows, CONVERSATION).repartition(5).withColumns({"depth": F.lit("x"), "digest": F.lit(1), "shard": F.lit(2)})
    got = conversation_trie(clashing, shard_turns=shard_turns, band=band, **(grafts() if graft else {})).select(NODE).collect()
    same(got, trie(rows, graft))


def test_trie_of_one_long_conversation_and_its_copies(spark):
    rows = [(c, t, "u", f"turn {t}") for c in (1, 2, 3) for t in range(3000 if c < 3 else 2500)] + [(9, 0, "u", "turn 0")]
    got = conversation_trie(spark.createDataFrame(rows, CONVERSATION), band=256, shard_turns=500).select(NODE).collect()
    same(got, trie(rows, False))


def test_trie_of_nothing(spark):
    assert conversation_trie(spark.createDataFrame([], CONVERSATION), **grafts()).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "u", "x")], CONVERSATION)).collect() == []


# alignment


def aligned(rows):
    whole, pieces = Tokenizer.from_file(path_of(BYTE_BPE)), sentencepiece.SentencePieceProcessor(model_file=path_of(PIECE_BPE))
    whole.encode_special_tokens = True
    letters, found, df = byte_bpe(path_of(BYTE_BPE), True).token_bytes, [], Counter()
    for doc, text in rows:
        a, b = (whole.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        x = [letters[i] for i in a]
        y = [bytes([int(p[1:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        groups, links = [], Counter()
        if text and b"".join(x) == b"".join(y) == (" " + text).encode():
            a_ends, b_ends = np.cumsum([len(t) for t in x]).tolist(), np.cumsum([len(t) for t in y]).tolist()
            before = 0
            for end in sorted({*a_ends} & {*b_ends}):
                groups.append(tuple([i for i, e in zip(ids, ends, strict=True) if before < e <= end] for ids, ends in ((a, a_ends), (b, b_ends))))
                before = end
            for p, q in groups:
                links.update((i, j) for i in p for j in q)
            df.update(links.keys())
        else:
            a, b = [], []
        found.append((doc, len(a), len(b), groups, links))
    best = Counter()
    for (i, _), n in df.items():
        best[i] = max(best[i], n)
    for doc, n_a, n_b, groups, links in found:
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        n_best = sum(n for k, n in links.items() if df[k] == best[k[0]])
        yield doc, n_a, n_b, len(groups), sum(links.values()), n_best, sum(n * df[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""


def test_alignment_of_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(align_tokenizers(frame.repartition(3), chunk_bytes=20_000, shard_entries=2000).collect(), aligned(rows))
    assert op12_align(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_alignment_edge_texts(spark, monkeypatch):
    monkeypatch.setattr("quirefold.llm.token_alignment.FAN_IN", 2)
    rows = [*enumerate(TRICKY), (3, "a "), (None, "hello world"), (3, "a ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit(1), "pairs": F.lit("x")}).repartition(3)
    same(align_tokenizers(frame, chunk_bytes=300).collect(), aligned(rows))
    assert align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in align_tokenizers(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_chunks_are_held_one_at_a_time(spark, monkeypatch):
    """A chunk has megabytes, so it is a row group of its own: who writes or reads the file holds one, however many a task makes."""
    from quirefold.llm import token_alignment

    real, groups = token_alignment.saved, []

    def saved(df, **how):
        out = real(df, **how)
        if {"doc_id", "pairs"} <= set(out.columns):
            for f in out.inputFiles():
                meta = ParquetFile(f.removeprefix("file://")).metadata
                groups.extend(meta.row_group(i).num_rows for i in range(meta.num_row_groups))
        return out

    monkeypatch.setattr(token_alignment, "saved", saved)
    rows = [(i, f"a few words {i} of a text {'x' * i}") for i in range(40)]
    same(align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), chunk_bytes=100).collect(), aligned(rows))
    assert len(groups) > 10 and set(groups) == {1}


def test_words_outlast_their_generation(spark, monkeypatch):
    from quirefold.llm import token_alignment

    monkeypatch.setattr(token_alignment, "REMEMBERED", 3)
    aligner = token_alignment._Aligner(path_of(BYTE_BPE), path_of(PIECE_BPE))
    first = aligner.look_up(["alpha", "beta", "gamma", "x▁"])
    assert first[3] is None
    assert aligner.look_up(["beta", "delta", "x▁"])[0] == first[1]
    assert aligner.look_up(["alpha", "beta"]) == first[:2]


# packing


def pieces_of(rows):
    whole = Tokenizer.from_file(path_of(BYTE_BPE))
    for doc, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for k, start in enumerate([0, *range(first, len(ids), 2048)]):
            piece = ids[start : start + (2048 if k else first)]
            yield doc, k, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())


def assert_packed(rows):
    fill = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert all(n <= 2048 for n in fill.values())
    return len(fill), -(-sum(fill.values()) // 2048)


def test_packing_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_pack(spark, sf).collect()
    same([r[:5] for r in got], pieces_of(docs))
    used, least = assert_packed(got)
    assert used <= 1.03 * least + 1


def test_packing_edge_texts(spark):
    rows = [*enumerate(TRICKY), (3, "a "), (None, "hello world"), (3, "a ")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "shard": F.lit("x"), "offset": F.lit(2)}).repartition(3)).collect()
    same([r[:5] for r in got], pieces_of(rows))
    assert_packed(got)
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_cuts():
    assert cuts(1, 4) == [(0, 1)] and cuts(4, 4) == [(0, 4)] and cuts(5, 4) == [(0, 1), (1, 4)] and cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


def slow_fit(lengths, capacity, open_bins):
    """The same choices over a plain list of open bins; of equally full ones the last filled, of the fullest to close the first."""
    free, live, out = [], [], []
    for n in lengths:
        fit = [b for b in live if free[b] >= n]
        if fit:
            least = min(free[b] for b in fit)
            b = [b for b in fit if free[b] == least][-1]
            live.remove(b)
        else:
            b = len(free)
            free.append(capacity)
        out.append((b, capacity - free[b]))
        free[b] -= n
        if free[b]:
            live.append(b)
        if len(live) > open_bins:
            least = min(free[b] for b in live)
            live.remove(next(b for b in live if free[b] == least))
    return out, set(live)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_brute_force(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 50), rng.randint(1, 8), 50]) for _ in range(400)]
    bins, places, still = best_fit(lengths, 50, 5)
    want, live = slow_fit(lengths, 50, 5)
    assert list(zip(bins, places, strict=True)) == want and still == live and len(still) <= 5


def test_packing_over_many_levels(spark, monkeypatch):
    """Shards pass on their open bins until one is left; no piece is lost, and no more bins stay partly filled than one shard leaves."""
    rng = random.Random(3)
    rows = [(r, 0, rng.randint(1, 40)) for r in range(3000)]
    got = pack(spark.createDataFrame(rows, "row long, piece int, length long"), capacity=64, open_bins=30, shard_pieces=100, fan_in=3).collect()
    assert sorted(r["row"] for r in got) == list(range(3000))
    fill = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 64
    assert len(fill) <= 1.06 * sum(r[2] for r in rows) / 64
    assert packing.SHARD_PIECES and packing.FAN_IN
