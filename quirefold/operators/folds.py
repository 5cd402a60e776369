"""Order-dependent folds over sorted groups, many groups per task, one group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, key: str, order: list[str], fold: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Calls fold on the columns of each group, rows in the given order, and returns its columns.

    Groups are dealt to tasks by key and sorted there; a task streams through its groups and holds
    one group and one Arrow batch. The order must end in a unique column for results to be stable.
    """
    dealt = df.repartition(key).sortWithinPartitions(key, *order)

    def run(batches):
        held: list[dict[str, np.ndarray]] = []  # the parts of the group that a batch ends in
        for b in batches:
            if not len(b):
                continue
            columns = {c: b[c].to_numpy() for c in b.columns}
            keys = columns[key]
            if held and held[0][key][0] == keys[0] == keys[-1]:
                held.append(columns)
                continue
            if held:
                columns = {c: np.concatenate([*[h[c] for h in held], x]) for c, x in columns.items()}
                keys = columns[key]
            starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
            yield from _folded(columns, starts)
            held = [{c: x[starts[-1] :] for c, x in columns.items()}]
        if held:
            last = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            yield from _folded(last, np.array([0, len(last[key])]))

    def _folded(columns: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pd.DataFrame]:
        keys, made = [], []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            out = fold({c: x[s:e] for c, x in columns.items()})
            n = len(next(iter(out.values())))
            if n:
                keys.append(np.repeat(columns[key][s], n))
                made.append(out)
        if not made:
            return
        out = {key: np.concatenate(keys)} | {c: np.concatenate([m[c] for m in made]) for c in made[0]}
        yield pd.DataFrame({c: pd.Series(x, dtype=object if x.dtype.kind in "OU" else x.dtype) for c, x in out.items()})

    return dealt.mapInPandas(run, schema)
