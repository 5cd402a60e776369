"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of all words by its weight, at most ``max_epochs`` times its own size;
the excess goes to the sources below their cap, by weight. A source first takes all of its
documents as many whole times as its target allows. The rest of the target is filled with
documents in the order of their exponential keys -ln(u) / w, where u is a hash of the document's
id and w the document's quality weight, until the running sum of sizes meets the budget; the
document at the boundary gives the words still missing.

A source may hold most rows, so its rows are never sorted in one place. Sizes are summed by bins of the
key, of which an octave has BINS: whatever the weights are, no bin then holds more than about one in
4,000 of a source's rows of one weight. The bins are prefix-summed, and only the rows of the bin in which
the budget ends are sorted. What is left is one cut per source, against which every row is held
on its own: no row moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, fresh, hinted, saved, scratch

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Bins of the key in an octave.
BINS = 1024
SEED = "mix-1"
#: The cuts, a row per source, are broadcast up to this many bytes, and joined beyond it.
MAX_BROADCAST = 32 << 20
#: Characters that prose rarely holds.
SYMBOLS = "#$%&*|<>{}[]\\^~=_@+!"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to 0.1 as the share of SYMBOLS grows to a quarter."""
    n = F.length(text)
    share = (n - F.length(F.translate(text, SYMBOLS, ""))) / n
    return F.when(n > 0, F.greatest(F.lit(0.1), F.lit(1.0) - 4 * share)).otherwise(F.lit(1.0))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 13 hex digits of an md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(src, source_size) -> the same with target: shares by weight, capped, excess reshared.

    Sources fill up in the order of cap / weight. With the sources in that order, a source is
    capped exactly if the level that the rest would share, were it open, exceeds its ratio.
    One row per source is all that meets in the ordered windows here.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    pos = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (pos % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        t.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(rest))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open_weight"))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    # the level of the first open source holds for all open ones
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("src").isNull(), "src", "level")))
    t = t.withColumn("open_level", level.over(everything)["level"])
    return t.select(
        "src", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("open_level") * F.col("weight")).alias("target")
    )


def _measures(weight: Column | None, seed: str) -> list[Column]:
    """doc_id, src, size and key of a row."""
    w = F.coalesce(weight if weight is not None else quality_weight(F.col("text")), F.lit(1.0))
    key = -F.ln(uniform(F.col("doc_id"), seed)) / F.greatest(w, F.lit(1e-6))
    return [F.col("doc_id"), F.col("source").cast("string").alias("src"), n_words(F.col("text")).alias("size"), key.alias("key")]


def _edges(rows: DataFrame, plan: DataFrame, bins: int) -> DataFrame:
    """(src_, edge, part): the first row in order that the budget doesn't cover, and the words that it gives.

    Rows that agree in key, id and size stand at one place and give equally many words.
    """
    keyed = rows.where("size > 0").withColumn("bin", F.floor(F.log2("key") * bins).cast("long"))
    ahead = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("src", "bin").agg(F.sum("size").alias("in_bin")).withColumn("ahead", F.coalesce(F.sum("in_bin").over(ahead), F.lit(0)))
    budget = plan.select("src_", "budget")
    last = sums.join(hinted(budget, 64, MAX_BROADCAST), F.col("src").eqNullSafe(F.col("src_"))).where("budget >= ahead and budget < ahead + in_bin")
    last = saved(last.select("src_", F.col("bin").alias("bin_"), (F.col("budget") - F.col("ahead")).alias("left")))
    near = keyed.join(hinted(last, 64, MAX_BROADCAST), F.col("src").eqNullSafe(F.col("src_")) & (F.col("bin") == F.col("bin_")))
    places = near.groupBy("src_", "left", "key", "doc_id", "size").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("src_").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("room", F.col("left") - F.coalesce(F.sum(F.col("size") * F.col("rows")).over(before), F.lit(0)))
    here = places.where("room >= 0 and room < size * rows")
    return here.select("src_", F.struct("key", "doc_id", "size").alias("edge"), F.floor(F.col("room") / F.col("rows")).cast("long").alias("part"))


def source_cuts(rows: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, bins: int = BINS) -> DataFrame:
    """(doc_id, src, size, key) -> one row per source: src_, source_size, target, epochs, edge, part.

    A row before edge in (key, doc_id, size) is taken once more than ``epochs`` times, one at it gives
    ``part`` words more, one after it none; without an edge, all are taken once more if the budget is theirs.
    """
    per_source = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.select(F.col("src").alias("src_"), "source_size", "target", epochs.alias("epochs"))
    plan = saved(plan.withColumn("budget", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")))
    edges = _edges(rows, plan, bins).withColumnRenamed("src_", "at")
    out = plan.join(edges, F.col("src_").eqNullSafe(F.col("at")), "left")
    full = F.when(F.col("edge").isNull() & (F.col("budget") >= F.col("source_size")), 1).otherwise(0)
    return saved(out.select("src_", "source_size", "target", (F.col("epochs") + full).alias("epochs"), "edge", F.coalesce("part", F.lit(0)).cast("long").alias("part")), keep=True)


def _taken() -> Column:
    here = F.struct("key", "doc_id", "size")
    more = F.when(here < F.col("edge"), F.col("size")).when(here == F.col("edge"), F.col("part")).otherwise(0)
    return (F.col("epochs") * F.col("size") + more).cast("long")


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, weight: Column | None = None, seed: str = SEED, bins: int = BINS
) -> DataFrame:
    """documents(doc_id, text, source) -> doc_id, source, size, source_size, target, epochs, taken.

    weight: quality weight per document (default: quality_weight of the text). Null text: size 0,
    taken 0. Null source: a source of its own, last in order. Repeated rows count one by one; where the
    budget ends among rows that agree in key, id and size, each gives equally many words (so fewer
    words than there are such rows may be missing), and reruns agree. Empty table: no rows.
    Sources without words have target 0. Other columns are ignored.
    """
    # the texts are read once: what follows needs a few numbers per document
    rows = saved(docs.select(*_measures(weight, seed)))
    cuts = source_cuts(rows, weights, max_epochs, bins)
    done = rows.join(hinted(cuts, 256, MAX_BROADCAST), F.col("src").eqNullSafe(F.col("src_")))
    return done.select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", "epochs", _taken().alias("taken"))


def drawn(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target and taken after their own columns.

    The texts are read twice and never move: sizes and keys are measured again beside the cuts of the
    sources. A column of docs by one of those names keeps it, and the new one gets underscores before
    its name. Null and repeated rows as in mix_sources; rows of which nothing is taken go. Empty table: no rows.
    """
    with scratch(docs.sparkSession):
        cuts = source_cuts(saved(docs.select(*_measures(None, seed))), weights, max_epochs)
    held = docs.select(F.struct("*").alias("own"), *_measures(None, seed))
    rows = held.join(hinted(cuts, 256, MAX_BROADCAST), F.col("src").eqNullSafe(F.col("src_"))).withColumn("taken", _taken()).where("taken > 0")
    return rows.select("own.*", *[F.col(c).alias(fresh(docs, c)) for c in ("size", "source_size", "target", "taken")])


def op9_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = rf"""
with d as (
  select doc_id, source as src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    case when length(text) > 0 then greatest(0.1::double, 1.0::double - 4 *
      ((length(text) - length(translate(text, '{SYMBOLS}', '')))::double / length(text))) else 1.0::double end as w,
    ((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0::double as u
  from documents),
s as (select src, sum(size)::bigint as source_size from d group by src),
p as (select *, [5.0::double, 2, 1][((row_number() over (order by src nulls last) - 1) % 3 + 1)::int] as weight, source_size * 3.0::double as cap from s),
q as (select *, sum(source_size) over () as total,
    coalesce(sum(cap) over (order by cap / weight, src nulls last rows between unbounded preceding and 1 preceding), 0) as fulls,
    sum(weight) over (order by cap / weight, src nulls last rows between current row and unbounded following) as open_weight,
    row_number() over (order by cap / weight, src nulls last) as pos from p),
l as (select *, (total - fulls) / open_weight as level, (total - fulls) / open_weight * weight >= cap as capped from q),
o as (select arg_min(level, pos) as open_level from l where not capped),
t as (select src, source_size, case when capped then cap else open_level * weight end as target from l left join o on true),
b as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
r as (select doc_id, size, source_size, target, epochs, round(target)::bigint - epochs * source_size as budget,
    coalesce(sum(size) over (partition by d.src order by -ln(u) / greatest(w, 1e-6), doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead
  from d join b on d.src is not distinct from b.src)
select doc_id, size::bigint as size, source_size, target,
  (epochs * size + least(size, greatest(0, budget - ahead)))::bigint as taken from r
"""
