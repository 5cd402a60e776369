"""User functions: batch models with errors as rows, retry ladders, metric and mask registries, chapter runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """df plus a model's result columns and ``error``.

    load() runs once per task and returns predict(batch) -> result columns. A batch that fails is
    halved and tried again; a single row that fails keeps null results and its message.
    """
    results = [c.strip().split(" ", 1) for c in schema.split(",")]
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        names = [n for n, _ in results]
        for b in batches:
            b = b.reset_index(drop=True)
            done, todo = [], [b] if len(b) else []
            while todo:
                part = todo.pop()
                try:
                    out = predict(part)[names].reset_index(drop=True)
                    out["error"] = None
                except Exception as e:
                    if len(part) > 1:
                        todo += [part.iloc[len(part) // 2 :], part.iloc[: len(part) // 2]]
                        continue
                    out = pd.DataFrame([[*[None] * len(names), f"{type(e).__name__}: {e}"]], columns=[*names, "error"])
                done.append(pd.concat([part.reset_index(drop=True), out], axis=1))
            if done:
                yield pd.concat(done)

    return df.mapInPandas(run, f"{given}, {schema}, error string")


def retry_ladder(df: DataFrame, key: str, attempts: list[Callable[[DataFrame], DataFrame]], result: str) -> DataFrame:
    """key, result, attempt: each attempt runs on the rows whose result is still null or blank."""
    todo, done = df, None
    for i, attempt in enumerate(attempts):
        out = attempt(todo).select(key, result)
        good = out.where(F.trim(F.coalesce(result, F.lit(""))) != "").withColumn("attempt", F.lit(i))
        done = good if done is None else done.unionByName(good)
        todo = todo.join(good.select(key), key, "left_anti")
    return df.select(key).distinct().join(done, key, "left")


#: Metrics by name: (value of a row, how the values of a group are finished).
METRICS: dict[str, tuple[Callable[[], Column], Callable[[Column], Column]]] = {
    "mean_ssim": (lambda: F.col("ssim"), F.avg),
    "worst_lpips": (lambda: F.col("lpips"), F.max),
    "hole_share": (lambda: F.col("hole_frac"), F.sum),
}


def run_metrics(df: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """A column per metric of the registry, by group, from one scan."""
    return df.groupBy(*by).agg(*[METRICS[n][1](METRICS[n][0]()).alias(n) for n in names])


def run_chapters(chapters: DataFrame, work: Callable[[pd.DataFrame], int], key: str = "folder") -> DataFrame:
    """key, status, n, error: work on the rows of each chapter; an exception is a failed row, not a failed job.

    Chapters are dealt to tasks by key and sorted there; a task streams through its chapters and holds one of them and one Arrow batch.
    """

    def one(name, parts: list[pd.DataFrame]) -> tuple:
        try:
            return (name, "done", work(pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)), None)
        except Exception as e:
            return (name, "failed", 0, f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, []
        made = lambda out: pd.DataFrame(out, columns=[key, "status", "n", "error"])
        for b in batches:
            if not len(b):
                continue
            keys, out = b[key].to_numpy(object), []
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(b)]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if held and name != keys[s]:
                    out.append(one(name, held))
                    held = []
                name = keys[s]
                held.append(b.iloc[s:e])
            if out:
                yield made(out)
        if held:
            yield made([one(name, held)])

    return chapters.repartition(key).sortWithinPartitions(key).mapInPandas(run, f"{key} string, status string, n long, error string")
