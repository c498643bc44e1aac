"""Look-back features: lags and shifted rolling statistics.

All features asked for in one call share one exchange and one sort.  A rolling
window is built in levels: statistics over 1, 4, 16, ... rows are each merged from four
neighbours of the level below, and a window of ``n`` rows is the merge of a few such
pieces.  The work per row grows with log(n) instead of n, and since nothing is ever
taken out of a running total (counts, means and squared deviations of disjoint pieces
are merged) a spike leaves no rounding error behind once it has left the window.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, POS, drop_halo, in_series, key_list, with_halo, with_positions
from .cleaning import reindex_with_halo


# Pieces merged into one of the next level.
RADIX = 4


@dataclass(frozen=True)
class Lag:
    column: str
    periods: int
    name: str


@dataclass(frozen=True)
class Rolling:
    column: str
    window: int
    stat: str  # mean, std, min or max
    name: str
    shift: int = 1

    @property
    def min_periods(self) -> int:
        return max(1, self.window // 4)


def _add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns given as SQL text (one call per column, however long the text)."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def _merge(df: DataFrame, groups: dict[str, list[Sequence[str]]]) -> DataFrame:
    """Merge counts, means and sums of squared deviations of disjoint sets of rows.

    ``groups`` maps an output pattern with one ``{}`` for n, m or q to the column names
    (n, m, q) of its parts.
    """
    counts, means, squares = {}, {}, {}
    for out, parts in groups.items():
        n, m, q = (out.format(k) for k in "nmq")
        total = " + ".join(f"{pn} * {pm}" for pn, pm, _ in parts)
        counts[n] = " + ".join(pn for pn, _, _ in parts)
        means[m] = f"CASE WHEN {n} > 0 THEN ({total}) / {n} ELSE 0D END"
        squares[q] = " + ".join(f"{pq} + {pn} * ({pm} - {m}) * ({pm} - {m})" for pn, pm, pq in parts)
    for step in (counts, means, squares):
        df = _add(df, step)
    return df


def _pieces(n: int) -> list[tuple[int, int]]:
    """Window of ``n`` rows as (level, offset) pieces of RADIX ** level rows."""
    out, offset, level = [], 0, 0
    while RADIX ** (level + 1) <= n:
        level += 1
    for j in range(level, -1, -1):
        while n - offset >= RADIX**j:
            out.append((j, offset))
            offset += RADIX**j
    return out


def _moments(df: DataFrame, specs: list[Rolling], over: str) -> DataFrame:
    """Mean and standard deviation for every spec, level by level."""
    windows: dict[tuple[str, int], set[int]] = {}
    for s in specs:
        windows.setdefault((s.column, s.shift), set()).add(s.window)
    tag = {src: f"__r{i}" for i, src in enumerate(windows)}

    # Pieces end at their own row; the shift is part of the look-back that finds a window's pieces.
    df = _add(df, {f"{t}_v": f"CAST(`{column}` AS DOUBLE)" for (column, _), t in tag.items()})
    first = {}
    for t in tag.values():
        first[f"{t}_n0"] = f"CASE WHEN {t}_v IS NULL THEN 0D ELSE 1D END"
        first[f"{t}_m0"] = f"coalesce({t}_v, 0D)"
        first[f"{t}_q0"] = "0D"
    df = _add(df, first)

    top = {src: _pieces(max(sizes))[0][0] for src, sizes in windows.items()}
    for j in range(max(top.values())):
        live = [tag[src] for src in windows if top[src] > j]
        back = {
            f"{t}_{k}p{i}": f"lag({t}_{k}{j}, {i * RADIX**j}, 0D) {over}"
            for t in live
            for k in "nmq"
            for i in range(1, RADIX)
        }
        groups = {
            f"{t}_{{}}{j + 1}": [
                [f"{t}_{k}{j}" for k in "nmq"],
                *[[f"{t}_{k}p{i}" for k in "nmq"] for i in range(1, RADIX)],
            ]
            for t in live
        }
        df = _merge(_add(df, back), groups).drop(*back)

    found, groups = {}, {}
    for src, sizes in windows.items():
        shift = src[1]
        for n in sizes:
            name = f"{tag[src]}_{n}"
            groups[f"{name}_{{}}"] = [
                [f"{name}_{k}at{offset}" for k in "nmq"] for _, offset in _pieces(n)
            ]
            for j, offset in _pieces(n):
                for k in "nmq":
                    level = f"{tag[src]}_{k}{j}"
                    found[f"{name}_{k}at{offset}"] = (
                        f"lag({level}, {offset + shift}, 0D) {over}" if offset + shift else level
                    )
    df = _merge(_add(df, found), groups)

    out = {}
    for s in specs:
        n, m, q = (f"{tag[s.column, s.shift]}_{s.window}_{k}" for k in "nmq")
        if s.stat == "mean":
            out[s.name] = f"CASE WHEN {n} >= {s.min_periods} THEN {m} END"
        else:
            out[s.name] = f"CASE WHEN {n} >= {max(2, s.min_periods)} THEN sqrt({q} / ({n} - 1)) END"
    return _add(df, out)


def _extremes(df: DataFrame, specs: list[tuple[Rolling, str]], over: str) -> DataFrame:
    """Minimum and maximum by doubling; the two pieces of a window may overlap.

    Each spec comes with the name of a rolling mean over the same rows, which is
    null exactly where too few values are known.
    """
    out = {}
    for i, (s, gate) in enumerate(specs):
        pick = "least" if s.stat == "min" else "greatest"
        t = f"__x{i}"
        df = _add(df, {f"{t}_0": f"lag(CAST(`{s.column}` AS DOUBLE), {s.shift}) {over}"})
        levels = s.window.bit_length() - 1
        for j in range(levels):
            df = _add(df, {f"{t}_b": f"lag({t}_{j}, {1 << j}) {over}"})
            df = _add(df, {f"{t}_{j + 1}": f"{pick}({t}_{j}, {t}_b)"})
        last, rest = f"{t}_{levels}", s.window - (1 << levels)
        if rest:
            df = _add(df, {f"{t}_e": f"lag({last}, {rest}) {over}"})
            last = f"{pick}({last}, {t}_e)"
        out[s.name] = f"CASE WHEN {gate} IS NOT NULL THEN {last} END"
    return _add(df, out)


def add_lookback(
    df: DataFrame,
    specs: Iterable[Lag | Rolling],
    keys: str | Sequence[str] = "site_id",
    ts: str = "timestamp",
    grid: str | None = None,
    reindex: bool = False,
) -> DataFrame:
    """Add every lag and rolling column in ``specs`` in one pass over the panel.

    Rows without a site or a time belong to no series: they are kept, with nulls.  With ``reindex``
    the table holds readings, which ``reindex_to_grid`` would put on ``grid``, and is put there in the
    same pass; readings are then dealt, not the instants between them.
    """
    specs = list(specs)
    if not specs:
        return df
    for s in specs:
        if isinstance(s, Rolling) and s.stat not in ("mean", "std", "min", "max"):
            raise ValueError(f"Unknown rolling statistic {s.stat!r}")
    lookback = max(
        s.periods if isinstance(s, Lag) else s.window + s.shift - 1 for s in specs
    )
    names = [s.name for s in specs]
    keep = [c for c in df.columns if c not in names]
    keys = key_list(keys)
    if reindex:
        if grid is None or (keys, ts) != (["site_id"], "timestamp"):
            raise ValueError("reindex needs a grid, and the keys site_id and timestamp")
        out, rows = reindex_with_halo(df, grid, lookback)
    else:
        out, rows = with_halo(with_positions(df, keys, ts, grid), lookback)
    over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in [*keys, BLOCK])} ORDER BY {POS})"
    lags = {
        s.name: f"lag(`{s.column}`, {s.periods}) {over}" for s in specs if isinstance(s, Lag)
    }
    rolling = [s for s in specs if isinstance(s, Rolling)]
    moments = [s for s in rolling if s.stat in ("mean", "std")]
    extremes = [
        (s, f"__gate{i}") for i, s in enumerate(s for s in rolling if s.stat in ("min", "max"))
    ]
    moments += [Rolling(s.column, s.window, "mean", gate, s.shift) for s, gate in extremes]
    if lags:
        out = _add(out, lags)
    if moments:
        out = _moments(out, moments, over)
    if extremes:
        out = _extremes(out, extremes, over)
    sound = in_series(keys, ts)
    return drop_halo(out, rows).select(*keep, *[F.when(sound, F.col(n)).alias(n) for n in names])
