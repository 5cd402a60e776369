"""Pieces of SQL that several oracles share."""

from __future__ import annotations


def first_fit(rows: str) -> str:
    """A recursive table ff(key, i, m, n, r) over rows(key, i, y, tol), i from 1: the line r that takes each row, and the lines' means so far."""
    put = lambda c, old, new: f"case when p = 0 then list_append({c}, {new}) else list_concat(list_append({c}[1:p - 1], {old}), {c}[p + 1:]) end"
    return f"""ff as (select key, i, [y] as m, [1] as n, 1::bigint as r from {rows} where i = 1 union all
      select key, i, {put('m', '(m[p] * n[p] + y) / (n[p] + 1)', 'y')}, {put('n', 'n[p] + 1', '1')}, case when p = 0 then len(m) + 1 else p end
      from (select z.key, z.i, z.y, m, n, coalesce(list_position(list_transform(m, lambda k: abs(z.y - k) <= z.tol), true), 0) as p from ff join {rows} z on z.key = ff.key and z.i = ff.i + 1) q)"""


def norm_token(s: str) -> str:
    """Lower-cased without punctuation around it."""
    return rf"""lower(trim({s}, ' ' || chr(9) || chr(10) || '.,!?:;"''()[]{{}}<>-_*/\|~`«»„“”‚‘’…–—'))"""
