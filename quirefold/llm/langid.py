"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A trigram's vector binds (multiplies) those of
its letters, each permuted (rotated) by its place. A text's vector bundles (adds) its trigrams'
vectors, and a language's prototype bundles those of its training texts. The language is that of
the prototype with the largest cosine.

The cosine needs no vector per text: the product with a prototype is the sum over trigrams of
count times the trigram's product with it, kept per worker once computed, and the text's norm is
sqrt(dims * sum of squared counts), what the near-orthogonality of random vectors gives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out

DIMS = 2048
CLASSES = 4096
SEED = 20240
#: Values of lang that are learnt at most.
MAX_LANGS = 1000
#: At most about this many texts of a language are bundled into its prototype.
SAMPLE_PER_LANG = 3000
#: Characters handled at once.
CHUNK = 1 << 20
#: Trigrams whose products a worker keeps.
CACHE = 1 << 18


def _letter_table() -> np.ndarray:
    """The class of each code point: 0 for what isn't a letter, else 1 to CLASSES - 1."""
    points = range(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in points), bool, len(points))
    mixed = (np.arange(len(letter), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return np.where(letter, 1 + mixed % np.uint64(CLASSES - 1), 0).astype(np.int64)


class Profiles:
    """Prototypes and what a worker derives from the seed; pickles without the derived tables."""

    def __init__(self, languages: list[str], prototypes: np.ndarray):
        self.languages, self.prototypes, self._tables = languages, prototypes, None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def _derived(self):
        if self._tables is None:
            rng = np.random.default_rng(SEED)
            letters = rng.integers(0, 2, size=(CLASSES, DIMS), dtype=np.int8) * 2 - 1
            self._tables = {
                "class": _letter_table(), "v": (np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters),
                "keys": np.empty(0, np.int64), "products": np.empty((0, len(self.languages)), np.float32),
            }
        return self._tables

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        a, b, c = self._derived()["v"]
        return a[keys >> 24] * b[(keys >> 12) & 4095] * c[keys & 4095]

    def trigrams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, trigram, count) of lower-cased texts; non-letters are one boundary."""
        found = []
        for first, last in _slices(texts):
            part = pc.utf8_lower(pc.fill_null(texts.slice(first, last - first), ""))
            flat = "\n".join(part.to_pylist())
            points = np.frombuffer(f"\n{flat}\n".encode("utf-32-le", "replace"), np.uint32)
            lengths = pc.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths + 1)
            for at in range(0, len(points), CHUNK):
                some = points[max(0, at - 2) : at + CHUNK]
                cls = self._derived()["class"][some]
                doc = np.searchsorted(ends, np.arange(max(0, at - 2), at + len(some) - min(at, 2)), side="left")
                keep = np.r_[True, (cls[1:] != 0) | (cls[:-1] != 0)]
                cls, doc = cls[keep], np.minimum(doc[keep], last - first - 1)
                if len(cls) < 3:
                    continue
                key = (cls[:-2] << 24) | (cls[1:-1] << 12) | cls[2:]
                inside = ((cls[:-2] != 0) | (cls[1:-1] != 0)) & ((cls[1:-1] != 0) | (cls[2:] != 0)) & (cls[1:-1] != 0)
                found.append(((doc[1:-1][inside] + first) << 36) | key[inside])
        if not found:
            return (np.empty(0, np.int64),) * 3
        every = np.sort(np.concatenate(found))
        start = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
        counts = np.diff(np.r_[start, len(every)])
        return every[start] >> 36, every[start] & ((1 << 36) - 1), counts

    def products(self, keys: np.ndarray) -> np.ndarray:
        """The inner product of each trigram's vector with each prototype."""
        t = self._derived()
        unique, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(t["keys"], unique), max(0, len(t["keys"]) - 1))
        known = t["keys"][at] == unique if len(t["keys"]) else np.zeros(len(unique), bool)
        out = np.empty((len(unique), len(self.languages)), np.float32)
        if known.any():
            out[known] = t["products"][at[known]]
        new = unique[~known]
        fresh = [self.vectors(new[i : i + 1024]).astype(np.float32) @ self.prototypes.T for i in range(0, len(new), 1024)]
        if fresh:
            out[~known] = np.concatenate(fresh)
            if len(t["keys"]) + len(new) > CACHE:
                t["keys"], t["products"] = unique, out
            else:
                merged = np.concatenate([t["keys"], new])
                order = np.argsort(merged)
                t["products"] = np.concatenate([t["products"], out[~known]])[order]
                t["keys"] = merged[order]
        return out[back]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        doc, keys, counts = self.trigrams(texts)
        n = len(texts)
        sums = np.zeros((n, len(self.languages)))
        if len(doc):
            weighted = self.products(keys) * counts[:, None]
            for i in range(len(self.languages)):
                sums[:, i] = np.bincount(doc, weighted[:, i], minlength=n)
        norm = np.sqrt(DIMS * np.bincount(doc, counts.astype(float) ** 2, minlength=n))
        cosine = sums / np.where(norm > 0, norm, 1)[:, None]
        best = cosine.argmax(1) if self.languages else np.zeros(n, int)
        seen = norm > 0
        names = [self.languages[b] if s and self.languages else "und" for b, s in zip(best, seen, strict=True)]
        top = cosine[np.arange(n), best] if self.languages else np.zeros(n)
        return names, np.where(seen, np.clip(top, 0, 1), 0.0)


def _slices(texts: pa.Array):
    """Runs of texts of about CHUNK characters, one at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, size = 0, 0
    for i, x in enumerate(sizes):
        if size and size + x > CHUNK:
            yield first, i
            first, size = i, 0
        size += x
    if first < len(texts):
        yield first, len(texts)


def fit_languages(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Profiles:
    """Prototypes from documents(doc_id, text, lang) outside the held-out rows.

    Partitions bundle their sampled texts; one vector per partition and language is added up. Of more than MAX_LANGS
    distinct values the most frequent are learnt, ties by name, so that a dirty column doesn't fill the driver.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_per_lang / n))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def bundle(batches):
        tool, sums = Profiles([], np.zeros((0, DIMS))), {}
        for b in batches:
            doc, keys, n = tool.trigrams(b.column("text"))
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            for lang in set(langs):
                mine = (langs == lang)[doc]
                unique, back = np.unique(keys[mine], return_inverse=True)
                total = np.bincount(back, n[mine], minlength=len(unique))
                v = sums.setdefault(lang, np.zeros(DIMS))
                for i in range(0, len(unique), 1024):
                    v += total[i : i + 1024] @ tool.vectors(unique[i : i + 1024]).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [x.tolist() for x in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    parts = drawn.mapInArrow(bundle, "lang string, v array<double>")
    # sums of whole numbers below 2**53: the order of adding doesn't matter
    exact = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    made = exact.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    languages = [r["lang"] for r in made]
    p = np.array([[x["x"] for x in r["v"]] for r in made]).reshape(len(made), DIMS)
    p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    return Profiles(languages, p.astype(np.float32))


def predict_languages(docs: DataFrame, model: Profiles) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score: a map over the rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            names, score = held.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_ids(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text, lang) -> doc_id, held_out, lang_pred, score, one row per row.

    Null texts and texts without a letter: ``und`` and 0; so is everything when no row can be
    learnt from. Ties go to the language first in order. Repeated rows get equal results. Empty
    table: no rows. Other columns are ignored.
    """
    out = predict_languages(docs, fit_languages(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_langid(spark, sf_dir):
    return language_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
