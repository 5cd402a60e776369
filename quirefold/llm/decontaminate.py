"""Benchmark decontamination with a hash set of test n-grams, in built-in functions alone.

A window is ``n`` consecutive words of a benchmark item, or the whole item if it is shorter. Of a
window of L words, every occurrence in a document holds a gram of g words that starts at a
multiple of ``step`` (step + g = L + 1), so the scan hashes one gram per step and looks it up in
the set of all grams of the windows. Only around hits are windows cut out of the document and
compared with the items' windows, word by word, in a join. The set is part of the plan while
it holds at most ``max_inline`` grams (8 bytes each); a larger one is written and broadcast up to
MAX_BROADCAST, and beyond that the grams of the documents are shuffled to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, row_key, saved, words

N = 13
MAX_INLINE = 200_000
#: Grams, and windows of items by the bytes of their text, are broadcast up to this size.
MAX_BROADCAST = 32 << 20


def benchmark_windows(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, text) -> (item, n_win, win): each distinct window; null or wordless items give none."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - n))
    cut = F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, n))
    return w.select("item", F.explode(cut).alias("x")).select("item", F.size("x").alias("n_win"), F.array_join("x", " ").alias("win")).distinct()


def _steps(length: int) -> tuple[int, int]:
    step = (length + 1) // 2
    return step, length - step + 1


def _grams(windows: DataFrame, length: int) -> DataFrame:
    """(h): the hash of every gram that a document's scan could meet in a window of this length."""
    step, g = _steps(length)
    w = F.split("win", " ")
    at = F.sequence(F.lit(0), F.lit(step - 1))
    return (
        windows.where(F.col("n_win") == length)
        .select(F.explode(F.transform(at, lambda i: F.xxhash64(F.slice(w, i + 1, g)))).alias("h"))
        .distinct()
    )


def _anchors(w: Column, length: int) -> Column:
    """array<struct<p, h>>: the grams at every step of a document."""
    step, g = _steps(length)
    at = F.sequence(F.lit(0), F.floor((F.size(w) - g) / step).cast("int"))
    grams = F.transform(at, lambda j: F.struct((j * step).alias("p"), F.xxhash64(F.slice(w, j * step + 1, g)).alias("h")))
    return F.when(F.size(w) >= length, grams)


def _around(w: Column, p: Column, length: int) -> Column:
    """struct<s, x>: the words that the windows holding the gram at p span, and where they start."""
    step, _ = _steps(length)
    first = F.greatest(F.lit(0), p - step + 1)
    return F.struct(first.alias("s"), F.slice(w, first + 1, p + length - first).alias("x"))


def _windows(near: Column, length: int) -> Column:
    """array<struct<s, n, win>>: all windows of one such span."""
    at = F.sequence(F.lit(0), F.size(near["x"]) - length)
    cut = F.transform(
        at,
        lambda i: F.struct(
            (near["s"] + i).alias("s"), F.lit(length).alias("n"), F.array_join(F.slice(near["x"], i + 1, length), " ").alias("win")
        ),
    )
    return F.when(F.size(near["x"]) >= length, cut).otherwise(F.array().cast(WINDOWS))


def _windows_of(w: Column, length: int):
    return lambda a: _windows(_around(w, a["p"], length), length)


def _with_context(w: Column, length: int):
    return lambda a: F.struct(a["h"].alias("h"), _around(w, a["p"], length).alias("near"))


WINDOWS = "array<struct<s:int,n:int,win:string>>"


def _merged(words: Column) -> Column:
    """Sorted distinct word positions -> array<struct<s, e>> of the runs that they make."""
    numbered = F.transform(words, lambda p, i: F.struct(p.alias("p"), (p - i).alias("run")))
    starts = F.filter(F.arrays_zip(numbered.alias("x"), F.concat(F.array(F.lit(None).cast("int")), F.transform(words, lambda p, i: p - i)).alias("before")), lambda z: z["x"].isNotNull() & ~z["x"]["run"].eqNullSafe(z["before"]))
    ends = F.filter(F.arrays_zip(numbered.alias("x"), F.slice(F.transform(words, lambda p, i: p - i), 2, F.size(words)).alias("after")), lambda z: ~z["x"]["run"].eqNullSafe(z["after"]))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["x"]["p"].alias("s"), (b["x"]["p"] + 1).alias("e")))


def contamination(docs: DataFrame, items: DataFrame, n: int = N, max_inline: int = MAX_INLINE, key: str | None = None) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> one row per document: doc_id, n_words,
    n_hit, n_items, items (sorted strings), items_sha256, spans (array<struct<s, e>> of words,
    merged), contaminated.

    A null or wordless text has no words and no hit. An item is matched by any of its windows; one
    with a null id counts its words as hit but not as an item. Repeated documents are judged one
    by one. Contaminated: n_hit > 0 and 20 * n_hit >= n_words. Empty documents: no rows; empty
    benchmark: no hits. Other columns are ignored. ``key`` names a column of ``row_key`` to add.
    """
    windows = benchmark_windows(items, n)
    sizes = {r[0]: (r[1], r[2]) for r in windows.groupBy("n_win").agg(F.count("*"), F.sum(F.length("win") + 16)).collect()}
    base = docs.select(F.struct(F.monotonically_increasing_id().alias("i"), row_key().alias("key")).alias("row"), "doc_id", words(F.col("text")).alias("w"))
    w, inline, parts = F.col("w"), [], []
    for length, (count, _) in sorted(sizes.items()):
        if count * _steps(length)[0] <= max_inline:
            held = ",".join(f"{r[0]}L" if r[0] > -(2**63) else "-9223372036854775807L - 1" for r in _grams(windows, length).collect())
            base = base.withColumn(f"a{length}", F.coalesce(_anchors(w, length), F.array()))
            hits = F.expr(f"filter(a{length}, a -> a.h in ({held}))")
            inline.append(F.flatten(F.transform(hits, _windows_of(w, length))))
    found = F.flatten(F.array(*inline)) if inline else F.array().cast(WINDOWS)
    parts.append(base.select("row", "doc_id", F.size(w).alias("n_words"), F.explode_outer(found).alias("c")))
    for length, (count, _) in sorted(sizes.items()):
        if count * _steps(length)[0] > max_inline:
            near = base.select(
                "row", "doc_id", F.size(w).alias("n_words"),
                F.explode(F.transform(_anchors(w, length), _with_context(w, length))).alias("a"),
            ).select("row", "doc_id", "n_words", F.col("a.h").alias("h"), F.col("a.near").alias("near"))
            near = near.join(hinted(saved(_grams(windows, length)), 16, MAX_BROADCAST), "h", "left_semi")
            parts.append(near.select("row", "doc_id", "n_words", F.explode(_windows(F.col("near"), length)).alias("c")))
    cand = parts[0]
    for more in parts[1:]:
        cand = cand.unionByName(more)
    small = sum(b for _, b in sizes.values()) <= MAX_BROADCAST
    cand = cand.select("row", "doc_id", "n_words", "c.s", "c.n", "c.win")
    hit = cand.join(F.broadcast(windows) if small else windows, "win", "left")
    is_hit = F.col("n_win").isNotNull()
    span = F.struct(F.col("s"), (F.col("s") + F.col("n")).alias("e"))
    per_doc = hit.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set(F.when(is_hit, span))).alias("all_spans")
    )
    hit_words = F.array_sort(F.array_distinct(F.flatten(F.transform("all_spans", lambda x: F.sequence(x["s"], x["e"] - 1)))))
    per_doc = per_doc.withColumn("hit_words", hit_words).withColumn("spans", _merged(F.col("hit_words")))
    per_doc = per_doc.withColumn("n_hit", F.size("hit_words").cast("long"))
    return per_doc.select(
        *([F.col("row.key").alias(key)] if key else []),
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "spans",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op5_decontaminate(spark, sf_dir):
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP5_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item, least(len(w), 13) as n, array_to_string(w[i + 1:i + 13], ' ') as win
  from b, unnest(range(0, greatest(1, len(w) - 12))) as u(i) where len(w) > 0),
dw as (
  select doc_id, i as s, k.n, array_to_string(w[i + 1:i + k.n], ' ') as win
  from d, (select distinct n from bw) k, unnest(range(0, len(w) - k.n + 1)) as u(i)),
h as (select doc_id, s, n, item from dw join bw using (n, win)),
p as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + n)) as pos from h) group by 1),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join p using (doc_id) left join i using (doc_id)
"""
