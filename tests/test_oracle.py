"""Every registered query of the library against its SQL, at the smallest scale."""

import os
import re

import pytest
from compare import assert_same, connection

from quirefold.plans import registered

QUERIES, ORACLE = registered()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).columns
    assert QUERIES[name](spark, sf).limit(5).collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["box_id", "text"]
    assert out.count() > 0


def test_heights_of_a_page_cut_short(spark, sf, tmp_path):
    """The last page has 16 rows, so its second slice has 7 of 9."""
    for f in os.listdir(sf):
        if f != "embeddings.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 10").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["src18_check_heights"](spark, str(tmp_path))
    assert found.where("expected = 7 and actual = 7 and ok").count() == 1
    assert_same(found, connection(tmp_path), ORACLE["src18_check_heights"])


def without_adaption(spark, f, mode="simple"):
    """The plan of f()."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return spark._jvm.PythonSQLUtils.explainString(f()._jdf.queryExecution(), mode)
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


@pytest.mark.parametrize("name", ["j6_merge_passes", "j8_pick_box", "a3_ocr_stats", "a3_w6_ocr_lines"])
def test_lines_are_shuffled_once(spark, sf, name):
    """Boxes and tokens are numbered from one shuffle of the table's own columns; a second one may stand where null keys are left out before."""
    plan = without_adaption(spark, lambda: QUERIES[name](spark, sf))
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in x and "ReusedExchange" not in x]) <= 2


@pytest.mark.parametrize("name", ["j11_layout_inputs", "p11_comfort_clamp", "p12_short_text_relax", "p13_fit_area"])
def test_bubbles_are_numbered_once(spark, sf, name):
    assert "l_orderkey" not in without_adaption(spark, lambda: QUERIES[name](spark, sf))


def test_fit_area_is_compiled(spark, sf):
    """No generated method is longer than the 8,000 bytes beyond which the JVM only interprets it."""
    text = without_adaption(spark, lambda: QUERIES["p13_fit_area"](spark, sf), "codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_candidates_add_up_once(spark, sf):
    """Segments are added up from lines in one hash table a task, beside that of the partial sums before the shuffle."""
    plan = without_adaption(spark, lambda: QUERIES["g11_candidates"](spark, sf))
    assert len([x for x in plan.splitlines() if "HashAggregate" in x and "sum(" in x]) <= 2


def test_few_rectangles_stay_in_their_row(spark):
    """Areas of keys with few and with many rectangles against painted pixels; those with few need no table of edges and no join."""
    import numpy as np

    from quirefold.operators import ordering

    draws, rows, want = np.random.default_rng(3), [], {}
    for k, n in enumerate([1, 2, 4, 15, 16, 17, 40]):
        painted = np.zeros((64, 64), bool)
        for _ in range(n):
            (x0, y0), (w, h) = draws.integers(0, 40, 2).tolist(), draws.integers(0, 20, 2).tolist()
            rows.append((k, x0, y0, x0 + w, y0 + h))
            painted[y0 : y0 + h, x0 : x0 + w] = True
        if painted.any():
            want[k] = int(painted.sum())
    df = spark.createDataFrame([*rows, (None, 0, 0, 1, 1)], "k long, x0 long, y0 long, x1 long, y1 long")
    for kind in ("long", "int", "double"):
        typed = df.select("k", *[df[c].cast(kind).alias(c) for c in ("x0", "y0", "x1", "y1")])
        assert {r["k"]: r["area"] for r in ordering.union_area(typed, "k").collect()} == want
    plan = without_adaption(spark, lambda: ordering.union_area(df, "k"))
    assert "Join" not in plan and "collect_set" not in plan
