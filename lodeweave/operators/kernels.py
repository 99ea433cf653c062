"""Per-group algorithms that no expression says: assignment, allocation, logistic fit, alignment."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compare
from ..functions.compare import monge_elkan  # noqa: F401


def least_cost(cost: np.ndarray) -> list[int | None]:
    """Column of each row at the least total cost, inf being no option; a row may stay unplaced where none is left.

    Shortest augmenting paths with potentials; among equal costs the earlier column.
    """
    rows, cols = cost.shape
    big = 1.0 + np.abs(cost[np.isfinite(cost)]).sum() * 2 if np.isfinite(cost).any() else 1.0
    wide = np.concatenate([np.where(np.isfinite(cost), cost, big * 4), np.full((rows, rows), big)], axis=1)  # a place to stay out for each row
    n = wide.shape[1]
    u, v, owner = np.zeros(rows + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for r in range(1, rows + 1):
        owner[0], at = r, 0
        dist, back, done = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while True:
            done[at] = True
            free = np.flatnonzero(~done[1:]) + 1
            step = wide[owner[at] - 1, free - 1] - u[owner[at]] - v[free]
            nearer = step < dist[free] - 1e-12
            dist[free[nearer]], back[free[nearer]] = step[nearer], at
            nxt = free[int(np.argmin(dist[free]))]
            d = dist[nxt]
            u[owner[done]] += d
            v[done] -= d
            dist[~done] -= d
            at = int(nxt)
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    out: list[int | None] = [None] * rows
    for c in range(1, cols + 1):
        if owner[c] and math.isfinite(cost[owner[c] - 1, c - 1]):
            out[owner[c] - 1] = c - 1
    return out


def assign(costs: DataFrame, group: str, row: str, col: str, cost: str) -> DataFrame:
    """group, row, col, cost of the cheapest assignment within each group; pairs not listed are no option.

    A group is a small matrix (the songs of one album by the tracks of one release); rows and columns go in their order.
    """
    schema = costs.select(group, row, col, cost).schema

    def one(df: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(df[row].unique()), sorted(df[col].unique())
        m = np.full((len(rows), len(cols)), np.inf)
        at_r, at_c = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
        for r, c, w in zip(df[row], df[col], df[cost], strict=True):
            m[at_r[r], at_c[c]] = min(m[at_r[r], at_c[c]], float(w))
        got = [(df[group].iloc[0], rows[i], cols[j], m[i, j]) for i, j in enumerate(least_cost(m)) if j is not None]
        return pd.DataFrame(got, columns=[group, row, col, cost])

    return costs.select(group, row, col, cost).groupBy(group).applyInPandas(one, schema)


def hull(points: list[tuple[float, float]]) -> list[int]:
    """Indices of the lower convex hull of (saved bytes, loss), from the first point on; points given by rising savings."""
    keep: list[int] = []
    for i, (x, y) in enumerate(points):
        if keep and x <= points[keep[-1]][0]:
            continue
        while len(keep) > 1:
            (x1, y1), (x0, y0) = points[keep[-1]], points[keep[-2]]
            if (y1 - y0) * (x - x1) >= (y - y1) * (x1 - x0):
                keep.pop()
            else:
                break
        keep.append(i)
    return keep


def allocate(items: list[list[tuple[float, float, float]]], most: float, sigmas: float = 0.0) -> list[int] | None:
    """Rung of each item so that all fit at the least loss; None where even the last rungs don't.

    items: rungs of (bytes, loss, sigma), the first the best. Hull steps are taken by loss per byte until
    bytes + ceil(sigmas * sqrt(variance)) fits. Then the items so lowered are raised to the best rung that fits, those
    whose last step lost most for each byte first, ties by item, and again until none rises.
    """
    choice = [0] * len(items)
    total = sum(i[0][0] for i in items)
    var = sum(i[0][2] ** 2 for i in items)
    over = lambda t, v: t + math.ceil(sigmas * math.sqrt(max(v, 0.0))) > most
    steps = []
    for n, rungs in enumerate(items):
        h = hull([(rungs[0][0] - b, loss) for b, loss, _ in rungs])
        for a, b in zip(h, h[1:], strict=False):
            slope = (rungs[b][1] - rungs[a][1]) / (rungs[a][0] - rungs[b][0])
            steps.append((slope, n, b))
    heapq.heapify(steps)
    last = [0.0] * len(items)
    while over(total, var) and steps:
        slope, n, b = heapq.heappop(steps)
        last[n] = slope
        old, new = items[n][choice[n]], items[n][b]
        total, var, choice[n] = total - old[0] + new[0], var - old[2] ** 2 + new[2] ** 2, b
    if over(total, var):
        return None
    order = sorted((n for n in range(len(items)) if choice[n]), key=lambda n: (-last[n], n))
    rose = True
    while rose:
        rose = False
        for n in order:
            now = items[n][choice[n]]
            for c in range(choice[n]):
                new = items[n][c]
                t, v = total - now[0] + new[0], var - now[2] ** 2 + new[2] ** 2
                if (c == 0 or new[0] < items[n][0][0]) and not over(t, v):
                    total, var, choice[n], rose = t, v, c, True
                    break
    return choice


def allocate_groups(rungs: DataFrame, group: str, item: str, rung: str, size: str, loss: str, most: float) -> DataFrame:
    """group, item, rung, bytes, loss chosen under a budget for each group of items; a group that can't fit gives no rows."""
    out = f"{group} {rungs.schema[group].dataType.simpleString()}, {item} {rungs.schema[item].dataType.simpleString()}, {rung} bigint, {size} double, {loss} double"

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values([item, rung])
        keys, items = [], []
        for k, part in df.groupby(item, sort=True):
            keys.append(k)
            items.append(list(zip(part[size].astype(float), part[loss].astype(float), [0.0] * len(part), strict=True)))
        chosen = allocate(items, most)
        rows = [] if chosen is None else [(df[group].iloc[0], k, c, i[c][0], i[c][1]) for k, i, c in zip(keys, items, chosen, strict=True)]
        return pd.DataFrame(rows, columns=[group, item, rung, size, loss])

    return rungs.select(group, item, rung, size, loss).groupBy(group).applyInPandas(one, out)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray | None:
    """Intercept and weights by Newton steps with a ridge on all but the intercept; None with one label alone."""
    if len(set(y.tolist())) < 2:
        return None
    a = np.column_stack([np.ones(len(x)), x])
    w, r = np.zeros(a.shape[1]), np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + r, a.T @ (y - p) - r @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic_fit(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """name, weight of a ridge logistic fit over the counts of equal rows: features are few-valued evidence, so the
    counts that reach the driver don't grow with the rows."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label, *features).agg(F.count("*").alias("_n")).toPandas()
    names = ["intercept", *features]
    if counts.empty or counts[label].nunique() < 2:
        return df.sparkSession.createDataFrame([], "name string, weight double")
    x, y, n = counts[features].to_numpy(float), counts[label].to_numpy(float), counts["_n"].to_numpy(float)
    a = np.column_stack([np.ones(len(x)), x])
    w, r = np.zeros(a.shape[1]), np.diag([0.0] + [1.0] * len(features))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a.T * (n * p * (1 - p))) @ a + r, a.T @ (n * (y - p)) - r @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in zip(names, w, strict=True)], "name string, weight double")


def name_distance(a: str | None, b: str | None) -> float | None:
    """compare.compared() in thousandths; none where a name is missing or the two can't be told."""
    found = compare.compared(compare.Name(a), compare.Name(b)) if a and b else None
    return None if found is None else round(found[0], 3)


def name_distances(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with distance, conflicts and agrees of two name columns; null says nothing. Each different pair of a batch is compared once."""

    def series(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known: dict = {}
        for p, q in zip(x, y, strict=True):
            if (p, q) not in known:
                m, n = (compare.Name(p), compare.Name(q)) if p and q else (None, None)
                found = compare.compared(m, n) if m else None
                known[p, q] = (None, None, None) if found is None else (round(found[0], 3), ",".join(sorted(found[1])), compare.agree(m, n))
        rows = [known[k] for k in zip(x, y, strict=True)]
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("distance", "conflicts", "agrees"))})

    d = F.pandas_udf(series, "distance double, conflicts string, agrees boolean")(a, b)
    return df.withColumn("_d", d).select(*[df[c] for c in df.columns], "_d.distance", "_d.conflicts", "_d.agrees")


def best_shift(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[int, float]:
    """Shift of b against a with the greatest correlation, and the correlation; the nearest to 0 of equals."""
    best = (0, -2.0)
    for lag in sorted(range(-reach, reach + 1), key=lambda k: (abs(k), k)):
        x, y = (a[lag:], b[: len(a) - lag]) if lag >= 0 else (a[: len(b) + lag], b[-lag:])
        n = min(len(x), len(y))
        if n < 8:
            continue
        x, y = x[:n] - x[:n].mean(), y[:n] - y[:n].mean()
        den = math.sqrt(float((x * x).sum() * (y * y).sum()))
        r = float((x * y).sum() / den) if den else 0.0
        if r > best[1] + 1e-12:
            best = (lag, r)
    return best


def envelope_shifts(frames: DataFrame, group: str, side: str, pos: str, value: str, reach: int) -> DataFrame:
    """group, shift, score of the two sides ('a' and 'b') of each group's envelopes."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(pos)
        a, b = df[df[side] == "a"][value].to_numpy(float), df[df[side] == "b"][value].to_numpy(float)
        shift, score = best_shift(a, b, reach) if len(a) and len(b) else (0, 0.0)
        return pd.DataFrame([(df[group].iloc[0], shift, round(score, 6))], columns=[group, "shift", "score"])

    return frames.groupBy(group).applyInPandas(one, f"{group} {frames.schema[group].dataType.simpleString()}, shift bigint, score double")


def perceptual_hashes(pixels: np.ndarray) -> tuple[int, int]:
    """64-bit hashes of a gray picture: signs of low cosine terms against their median, and of differences of neighbours."""
    def shrink(h: int, w: int) -> np.ndarray:
        ys, xs = np.linspace(0, pixels.shape[0], h + 1).astype(int), np.linspace(0, pixels.shape[1], w + 1).astype(int)
        return np.array([[pixels[ys[i] : max(ys[i] + 1, ys[i + 1]), xs[j] : max(xs[j] + 1, xs[j + 1])].mean() for j in range(w)] for i in range(h)])

    small = shrink(32, 32)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ small @ basis.T)[:8, :8].ravel()
    dct = sum(1 << i for i, x in enumerate(low) if x > np.median(low[1:]))
    edge = shrink(8, 9)
    diff = sum(1 << i for i, x in enumerate((edge[:, 1:] > edge[:, :-1]).ravel()) if x)
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    return signed(dct), signed(diff)
