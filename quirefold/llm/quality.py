"""Quality scores from compression with zstandard dictionaries of good and bad labelled text.

A bounded sample of labelled rows is split in two: one half trains a dictionary per class, the
other calibrates. A text is compressed with either dictionary in blocks of BLOCK bytes, so short that a
dictionary says more about a block than the block's own repeats do. The difference of the two sizes, as a share
of the text's bytes, is all that a score comes from: a logistic curve over it, fitted with weights that give
the labels' own class shares. Scoring is one map over the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most about this many labelled rows of either class are gathered to fit on.
SAMPLE_PER_CLASS = 1500
#: Texts of the sample have at most this many characters (scored texts may have any).
SAMPLE_CHARS = 16_384
DICT_BYTES = 65_536
BLOCK = 512
LEVEL = 3
#: Differences this many deviations from the mean and further count alike.
FAR = 5.0
OPTIONS = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 3, is 1 (null id: not)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; with too little text for training, the text itself."""
    joined = b"\n".join(texts)
    try:
        if len(texts) >= 8:
            return zstandard.train_dictionary(min(DICT_BYTES, max(256, len(joined) // 4)), texts).as_bytes()
    except zstandard.ZstdError:
        pass
    return joined[-DICT_BYTES:] or b"\n" * 8


class Scorer:
    """Compressors and calibration; pickles as plain bytes and numbers."""

    def __init__(self, good: bytes, bad: bytes):
        self.dicts, self.mean, self.scale, self.curve = (good, bad), 0.0, 1.0, np.zeros(2)
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """Bytes that the dictionary of good text saves over that of bad text, a byte of text."""
        if self._tools is None:
            made = []
            for d in self.dicts:
                loaded = zstandard.ZstdCompressionDict(d)
                loaded.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=loaded, **OPTIONS).compress)
            self._tools = made
        good, bad = self._tools
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            pieces = [t[at : at + BLOCK] for at in range(0, len(t), BLOCK)]
            out[i] = sum(len(bad(p)) - len(good(p)) for p in pieces) / max(1, len(t))
        return out

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -FAR, FAR)
        return np.stack([np.ones(len(z)), z], axis=1)

    def calibrate(self, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> None:
        x = self.differences(texts)
        self.mean, self.scale = x.mean(), x.std() + 1e-9
        a, w = self._design(x), np.zeros(2)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
            w = w + np.linalg.solve(slope, a.T @ (weight * (label - p)) - 1e-2 * w)
        self.curve = w

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(self.differences(texts)) @ self.curve, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, learn=None) -> Scorer | float:
    """Fits on documents(doc_id, text) and labels(doc_id, quality) outside the held-out rows.

    Only the bounded sample is gathered. Without labelled texts of both classes the result is the
    share of label 1 (0.5 without any label): every text then has that score. Rows with a null or
    other label, or labels that contradict each other for one id, are not learnt from.
    """
    ids = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    ids = ids.where(~held_out(F.col("doc_id")) if learn is None else learn)
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    counts = {r["quality"]: r["count"] for r in ids.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return float(next(iter(counts))) if counts else 0.5
    share = F.lit(0.0)
    for q, n in counts.items():
        share = F.when(F.col("quality") == q, F.lit(min(1.0, sample_per_class / n))).otherwise(share)
    drawn = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text").toPandas()  # at most about twice sample_per_class rows
    rows = rows.sort_values(["doc_id", "text"]).reset_index(drop=True)
    rows["bytes"] = [t.encode() for t in rows["text"]]
    by = {q: rows[rows["quality"] == q] for q in (0, 1)}
    if min(map(len, by.values())) < 2:
        return counts.get(1, 0) / total
    model = Scorer(_dictionary(list(by[1]["bytes"][::2])), _dictionary(list(by[0]["bytes"][::2])))
    rest = pd.concat([x.iloc[1::2] for x in by.values()])
    label = rest["quality"].to_numpy(dtype=float)
    seen = {q: max(1, int((label == q).sum())) for q in (0, 1)}
    weight = np.array([counts[int(q)] / total / seen[int(q)] * len(label) for q in label])
    model.calibrate(list(rest["bytes"]), label, weight)
    return model


def score_quality(docs: DataFrame, model: Scorer | float, name: str = "score") -> DataFrame:
    """docs(doc_id, text, ...) plus a column of scores; null and empty texts are scored as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = held.value
        if isinstance(m, float):
            return pd.Series(np.full(len(texts), m))
        return pd.Series(m.score([t.encode() if t is not None else b"" for t in texts]))

    return docs.withColumn(name, score(F.col("text")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted, one row per document row.

    Null and empty texts get the score of an empty text. Repeated rows get equal scores. Empty
    documents: no rows. Other columns are ignored.
    """
    model = fit_quality(docs, labels)
    out = score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark, sf_dir):
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
