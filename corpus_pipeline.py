"""A training-corpus pipeline: quality, near-duplicates, decontamination, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them again; what the next stage
does not read any more is deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import checkpoint_dir, deleted, fresh, hinted, row_key, saved, scratch
from quirefold.llm.decontaminate import contamination
from quirefold.llm.mixing import drawn
from quirefold.llm.near_dedup import near_duplicates
from quirefold.llm.quality import fit_quality, score_quality
from quirefold.llm.secrets import redact

#: Rows to leave out are broadcast up to this many bytes; beyond it the join shuffles.
MAX_BROADCAST = 64 << 20


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rejected (doc_id, key) rows; texts stay where they are while those rows are few."""
    own = [f"`{c}`" for c in docs.columns]
    gone = saved(rejected.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct())
    held = docs.select(F.struct("*").alias("own"), F.col("doc_id").alias("id"), row_key().alias("key"))
    on = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key"))
    return held.join(hinted(gone, 40, MAX_BROADCAST), on, "left_anti").select("own.*").select(*own)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.5) go.

    A null or empty text has the score of an empty one. Repeated rows share their fate. Columns of any name pass.
    Without labels of both classes all rows share one score. Empty table: no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = fresh(docs, "quality_score")
    scored = score_quality(docs, fit_quality(docs, labels), name)
    return scored.where(F.col(name) >= 0.5).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Rows that agree in id and text count as one document and are kept once. Where an id has several
    texts each is judged on its own. Null ids come after all others: such a row goes if its group
    has a row with an id, and stays otherwise. Null and wordless texts have no group and stay. Columns
    of any name pass. Empty table: no rows.
    """
    found = near_duplicates(docs, key="key")
    left = _without(docs, found.where(~F.col("kept") & F.col("component_id").isNotNull()))
    repeated = docs.select("doc_id", row_key().alias("key")).groupBy("doc_id", "key").count().where("count > 1").limit(1).count()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go.

    Null, empty and wordless texts stay. Rows are judged one by one by their text, so repeated rows share
    their fate and texts of one id do not. Columns of any name pass. Empty table: no rows.
    """
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="key")
    return _without(docs, found.where("contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is replaced; all documents stay, with n_chars as their text now is.

    Null texts stay null and keep their n_chars. Repeated rows stay, each redacted. Columns of any name
    pass. Empty table: no rows.
    """
    out = redact(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(length, "n_chars"))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size, their source's size and target, and the words taken.

    Null, empty and wordless texts have no words to take and go. A null source is a source of its own.
    Repeated rows are drawn one by one; at the budget's edge those that repeat give equally many words. A
    column of documents by one of the new names keeps it, and the new one gets an underscore. Empty
    table: no rows.
    """
    return drawn(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

#: No SQL gives the classifier's rows; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        if last:
            deleted(spark, last)
        last = f"{at}/{name}"
        docs = spark.read.parquet(last)
    return docs
