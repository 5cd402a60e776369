"""Files that tasks write themselves."""

import os

from compare import assert_same, connection

from quirefold.plans import registered
from quirefold.sources import files

QUERIES, ORACLE = registered()


def test_parts_are_files_of_their_shards_folder(spark, tmp_path):
    """A shard's folder holds a file for each part and no other folder, whatever batches its rows come in; a second run replaces them."""
    rows = [(s, i, None if i == 4 else "x" * (30 + 10 * i)) for s in ("a/b", "c") for i in range(20)]
    df = spark.createDataFrame(rows, "shard string, id long, text string").selectExpr("*", "octet_length(text) as size").repartition(4)
    out = str(tmp_path / "shards")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for some in ("true", "id < 15"):
            files.split_shards(df.where(some), out, "shard", ["id"], "size", 6, 400)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(r["shard"], r["id"]): r["part"] for r in files.numbered(df.where("id < 15"), "shard", ["id"], "size", 6, 400).collect()}
    got = spark.read.parquet(out).selectExpr("*", "input_file_name() as file").collect()
    assert {(r["shard"], r["id"]): r["part"] for r in got} == want and len(got) == 30
    assert {(r["shard"], r["id"]): r["text"] for r in got} == {(s, i): t for s, i, t in rows if i < 15}
    parts = {k: sorted(os.listdir(f"{out}/{k}")) for k in os.listdir(out)}
    assert parts == {f"shard={k}": [f"part-{n:08d}.parquet" for n in sorted({p for (s, _), p in want.items() if s == of})] for k, of in (("a%2Fb", "a/b"), ("c", "c"))}
    assert len({(r["part"], r["file"]) for r in got}) == len({r["file"] for r in got}) == len({(s, p) for (s, _), p in want.items()})
    files.split_shards(df.limit(0), out, "shard", ["id"], "size", 6, 400)
    assert spark.read.schema(df.schema).parquet(out).count() == 0


def test_pages_are_files_of_one_folder(spark, sf, tmp_path):
    """Pages need no folder each, a page that is written again takes the place of the first, and no task a page looks them up."""
    pages = spark.range(40).selectExpr("concat('page_id=', id, '.txt') as name", "concat(id, '\n', repeat('é', id)) as content")
    out = str(tmp_path / "pages")
    for rows in (pages, pages.where("name like '%7.txt'")):
        files.write_files(rows, out)
    assert sorted(os.listdir(out)) == sorted(f"page_id={i}.txt" for i in range(40))
    assert all(open(f"{out}/page_id={i}.txt", encoding="utf-8").read() == f"{i}\n{'é' * i}" for i in range(40))
    files.write_files(pages.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []
    # 40 pages a run, more than the 32 that Spark lists without tasks
    for f in os.listdir(sf):
        if f != "embeddings.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    spark.range(640).selectExpr("id as vec_id", "transform(sequence(0, 63), i -> cast(sin(id * 64 + i) as float)) as embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    name = "st6_ingest_once"
    before = _tasks(spark)
    assert_same(QUERIES[name](spark, str(tmp_path)), connection(tmp_path), ORACLE[name])
    assert max(n for k, n in _tasks(spark).items() if k not in before) < 40


def _tasks(spark) -> dict:
    """Tasks of every stage so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).numTasks() for i in range(stages.size())}
