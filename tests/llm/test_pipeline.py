"""Each stage of the corpus pipeline on its own input, and all of them in a row."""

import re

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from test_llm import WORD, UP, base_spans, classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]


def test_near_duplicates_stage(spark, sf, docs):
    out = P.drop_near_duplicates(spark, docs, sf)
    want = classes([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert out.columns == COLUMNS
    assert {r["doc_id"] for r in out.collect()} == {i for i, (_, c) in want.items() if c == i}
    twice = P.drop_near_duplicates(spark, docs.union(docs.where("doc_id < 20")), sf)
    assert twice.count() == out.count()


def test_decontamination_stage(spark, sf, docs):
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = WORD.findall((r["text"] or "").translate(UP))
        windows |= {tuple(w[a : a + 13]) for a in range(max(1, len(w) - 12) if w else 0)}
    keep = set()
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").translate(UP))
        hit = {p for a in range(len(w)) for n in {len(x) for x in windows} if tuple(w[a : a + n]) in windows for p in range(a, a + n)}
        if not hit or 20 * len(hit) < len(w):
            keep.add(r["doc_id"])
    out = P.drop_contaminated(spark, docs, sf)
    assert out.columns == COLUMNS and {r["doc_id"] for r in out.collect()} == keep


def test_secrets_stage(spark, sf, docs):
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = P.redact_secrets(spark, docs, sf)
    assert out.columns == COLUMNS
    rows = out.collect()
    assert len(rows) == len(before)
    for r in rows:
        spans = base_spans(before[r["doc_id"]] or "")
        assert not base_spans(re.sub(r"\[REDACTED\]", "\n", r["text"]))
        assert r["n_chars"] == len(r["text"])
        if not spans and "[REDACTED]" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]


def test_run(spark, sf, docs):
    out = P.run(spark, sf).cache()
    ids = {r["doc_id"] for r in out.collect()}
    assert 0 < len(ids) <= docs.count()
    sums = out.groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 1 for r in sums)
    good = {r["doc_id"] for r in P.keep_quality(spark, docs, sf).collect()}
    assert ids <= good


def test_stages_take_empty_tables(spark, sf, docs):
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, one id with two texts, and columns by the stages' own names."""
    rng = __import__("random").Random(3)
    words = [["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)] for _ in range(8)]
    text = [" ".join(w) for w in words]
    near = " ".join([*words[0][:39], "changed"])
    rows = [
        (1, text[0], "en", "a", None), (2, near, "en", "a", 5), (3, text[1], None, None, 5), (3, text[1], None, None, 5), (4, text[2], "en", "a", 1), (4, text[3], "en", "a", 1),
        (5, None, "en", "a", 7), (6, "", "en", None, 0), (None, text[0], None, None, None), (None, text[4], None, "b", 3), (7, " ".join(words[5] * 3000), "en", "b", 1), (8, text[6] + " password=hunter2222", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("size", "source_size", "target", "taken", "id_", "key_", "key", "own", "id", "gone_id", "gone_key", "score", "quality_score", "spans", "node", "row", "text_key"):
        df = df.withColumn(c, F.concat(F.lit("mine "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return df, text, near


def _mine(rows):
    return all(r[c] == f"mine {'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in ("size", "source_size", "target", "taken", "id_", "key", "own", "id"))


def test_near_duplicates_of_odd_rows(spark, sf, odd):
    df, text, _ = odd
    rows = P.drop_near_duplicates(spark, df, sf).collect()
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in rows)
    want = sorted([(1, text[0]), (3, text[1]), (4, text[2]), (4, text[3]), (5, ""), (6, ""), (0, text[4])] + [(r["doc_id"], r["text"]) for r in df.where("doc_id in (7, 8)").collect()])
    assert got == want and _mine(rows)


def test_decontamination_of_odd_rows(spark, sf, odd, monkeypatch):
    df, text, _ = odd
    bench = spark.createDataFrame([("x", text[3])], "item_id string, text string")
    monkeypatch.setattr(P, "contamination", lambda d, _, key: __import__("quirefold.llm.decontaminate", fromlist=["contamination"]).contamination(d, bench, key=key))
    rows = P.drop_contaminated(spark, df, sf).collect()
    assert len(rows) == 11 and _mine(rows) and text[3] not in {r["text"] for r in rows} and text[2] in {r["text"] for r in rows}


def test_secrets_and_quality_of_odd_rows(spark, sf, odd):
    df, text, _ = odd
    rows = P.redact_secrets(spark, df, sf).collect()
    assert len(rows) == 12 and _mine(rows)
    assert {r["doc_id"]: r["text"] for r in rows}[8] == text[6] + " [REDACTED]"
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows}[5] == (None, 7)
    kept = P.keep_quality(spark, df, sf)
    assert kept.columns == df.columns and _mine(kept.collect())
    both = [r["text"] for r in kept.where("doc_id = 3").collect()]
    assert len(both) in (0, 2)


def test_mixing_of_odd_rows(spark, sf, odd):
    df, text, _ = odd
    out = P.mix(spark, df, sf)
    assert out.columns == [*df.columns, "_size", "_source_size", "_target", "_taken"]
    rows = out.collect()
    assert _mine(rows) and all(r["_taken"] > 0 and r["_taken"] <= 3 * r["_size"] for r in rows)
    assert all(r["_size"] == len((r["text"] or "").split()) for r in rows)
    again = P.mix(spark, df.repartition(5), sf).collect()
    key = lambda r: (r["doc_id"] or 0, r["text"], r["_taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_quality_and_mixing_stage_brute_force(spark, sf, docs):
    """The rows that stay are those that the scorer gives half or more; the mix is that of mix_sources."""
    from quirefold.llm import mixing, quality

    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.collect()
    good = {r["doc_id"] for r in rows if (model if isinstance(model, float) else model.score([(r["text"] or "").encode()])[0]) >= 0.5}
    assert {r["doc_id"] for r in P.keep_quality(spark, docs, sf).collect()} == good
    want = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).where("taken > 0").collect()}
    assert {r["doc_id"]: r["taken"] for r in P.mix(spark, docs, sf).collect()} == want
