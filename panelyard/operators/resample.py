"""Wild bootstraps with weights that depend on seed, replicate and row alone."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from . import rank


def sign(seed: int, j: Column, t: Column) -> Column:
    """Rademacher weight: -1 or 1 by the first hex digit of a digest, the same on any partitioning."""
    digit = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), j.cast("string"), t.cast("string"))), 1, 1)
    return F.when(digit < "8", 1).otherwise(-1)


def signs(seed: int, js: list[int], n: int) -> np.ndarray:
    """The same weights as `sign` for rows 1 to n, a line a replicate."""
    return np.array([[1.0 if hashlib.md5(f"{seed}|{j}|{t}".encode()).hexdigest()[0] < "8" else -1.0 for t in range(1, n + 1)] for j in js])


def normal(seed: int, j: Column, t: Column) -> Column:
    """Standard normal weight from two 48-bit parts of a digest (Box and Muller)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), j.cast("string"), t.cast("string")))
    part = lambda at: (F.conv(F.substring(digest, at, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    return F.sqrt(-2 * F.ln(part(1))) * F.cos(2 * math.pi * part(13))


def replicates(df: DataFrame, b: int) -> DataFrame:
    """Every row with every replicate number 1 to b; rows are narrow and b is a parameter."""
    return df.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(b))))


SCHEMES = {"rademacher": sign, "normal": normal}


def wild_weights(df: DataFrame, b: int, seed: int, t: str = "t", scheme: str = "rademacher") -> DataFrame:
    return replicates(df, b).withColumn("s", SCHEMES[scheme](seed, F.col("j"), F.col(t)))


def wild_fixed(rows: DataFrame, keys: list[str], residual: str, regressor: str, b: int, seed: int, t: str = "t") -> DataFrame:
    """Slopes of replicates with fixed regressors: sum s e x / sum x x; sums only, no rows kept."""
    each = wild_weights(rows, b, seed, t)
    x = F.col(regressor)
    return each.groupBy(*keys, "j").agg((F.sum(F.col("s") * F.col(residual) * x) / F.sum(x * x)).alias("slope"))


def recursive_ar1(rows: DataFrame, keys: list[str], value: str, b: int, seed: int, order: str = "t") -> DataFrame:
    """(keys, j, n, slope, last): first-order autoregressions of replicates rebuilt from the
    first value, the fitted coefficients and sign-weighted residuals (row t uses sign t).

    A replicate is a recursion over one series, so a series is a task's unit; all its
    replicates advance together.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        x, base = part[value].to_numpy(float), {c: part[c].iloc[0] for c in keys}
        if len(x) < 4 or np.ptp(x[:-1]) == 0:
            return pd.DataFrame([], columns=[*keys, "j", "n", "slope", "last"])
        lag = x[:-1] - x[:-1].mean()
        slope = float(lag @ x[1:] / (lag @ lag))
        start = float(x[1:].mean() - slope * x[:-1].mean())
        e = x[1:] - start - slope * x[:-1]
        js = list(range(1, b + 1))
        s = signs(seed, js, len(x))
        path = np.empty((b, len(x)))
        path[:, 0] = x[0]
        for t in range(1, len(x)):
            path[:, t] = start + slope * path[:, t - 1] + s[:, t] * e[t - 1]
        lag = path[:, :-1] - path[:, :-1].mean(1, keepdims=True)
        slopes = (lag * path[:, 1:]).sum(1) / (lag * lag).sum(1)
        return pd.DataFrame({**{c: [v] * b for c, v in base.items()}, "j": js, "n": len(x) - 1, "slope": slopes, "last": path[:, -1]})

    head = rank._head(rows, keys)
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(filter(None, [head, "j int, n bigint, slope double, last double"])))


def bootstrap_rank(levels: DataFrame, columns: list[str], system: list[str], r0: int, b: int, seed: int, order: str = "d", chunk: int = 100) -> DataFrame:
    """Trace statistics of replicates with rank r0 imposed, rebuilt recursively from observed
    first values; (system, j, lr). The parallel axis is (system, block of replicates); a
    block's replicates advance, and are decomposed, together.
    """
    p = len(columns)
    s = rank.Shape(p, p, p + 1)
    blocks = levels.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((b - 1) // chunk))))
    keys = [*system, "block"]
    blocks = blocks.repartition(tables.partitions(levels.sparkSession), *keys)  # a block is long work on few rows

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order)[columns].to_numpy(float)
        base = {c: rows[c].iloc[0] for c in system}
        d = np.diff(x, axis=0)
        n = len(d) - 1
        y, lx, z = d[1:], x[1:-1], np.hstack([d[:-1], np.ones((n, 1))])
        w = np.hstack([y, lx, z])
        g = w.T @ w
        # With free relations the eigenvectors are the best, and loadings follow by least squares.
        beta = rank.johansen(g, n, s)[1][:, :r0]
        loadings = rank.loadings_of([g], s, beta)
        pi, psi = loadings[:, :r0] @ beta.T, loadings[:, r0:]
        e = y - lx @ pi.T - z @ psi.T
        first = int(rows["block"].iloc[0]) * chunk
        js = list(range(first + 1, min(first + chunk, b) + 1))
        weights = signs(seed, js, n)
        path = np.empty((len(js), n + 2, p))
        path[:, :2] = x[:2]
        for t in range(n):
            step = path[:, t + 1] @ pi.T + (path[:, t + 1] - path[:, t]) @ psi[:, :p].T + psi[:, p] + weights[:, t, None] * e[t]
            path[:, t + 2] = path[:, t + 1] + step
        dq = np.diff(path, axis=1)
        lam = rank.eigenvalues(np.concatenate([dq[:, 1:], path[:, 1:-1], dq[:, :-1], np.ones((len(js), n, 1))], 2), s)
        trace = -n * np.log(1 - lam[:, r0:]).sum(1)
        return pd.DataFrame({**{c: [v] * len(js) for c, v in base.items()}, "j": js, "lr": trace})

    head = rank._head(levels, system)
    return blocks.groupBy(*keys).applyInPandas(run, ", ".join(filter(None, [head, "j int, lr double"])))


def bootstrap_lr(levels: DataFrame, columns: list[str], system: list[str], breaks: list[int], b: int, seed: int, order: str = "d", chunk: int = 250, only: DataFrame | None = None) -> DataFrame:
    """(system, j, lr, b): LR of b = 1 in replicates drawn under b = 1, one covariance a segment.

    breaks [] is the iid model. Each task holds one system's rows and a block of replicates,
    whose paths advance together. A replicate is fitted from three free starts (the system's
    own fit, its closed form, the replicate's restricted fit) and two restricted ones (the
    system's own, the closed form's loadings), so LR is not negative but for rounding. A
    replicate whose algebra fails has null lr. only: (system, block) to draw, blocks of
    `chunk` replicates from 0.
    """
    p = len(columns)
    s = rank.Shape(p, p, p + 1)
    free_basis = rank.basis_restriction(p - 1)
    ones = rank.spread_basis(np.ones(p - 1))
    blocks = levels.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((b - 1) // chunk))))
    if only is not None:
        blocks = tables.joined(blocks, only, [*system, "block"], "left_semi")
    blocks = blocks.repartition(tables.partitions(levels.sparkSession), *system, "block")

    def grams_of(x: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """One Gram a segment for each path: paths, rows, series."""
        d = np.diff(x, axis=1)
        n = d.shape[1] - 1
        w = np.concatenate([d[:, 1:], x[:, 1:-1], d[:, :-1], np.ones((len(x), n, 1))], 2)
        parts = np.split(w, [k for k in breaks if k < n], 1)
        return [q.transpose(0, 2, 1) @ q for q in parts], [q.shape[1] for q in parts]

    def fitted(path: np.ndarray, free: rank.Fit, one: rank.Fit) -> tuple[np.ndarray, np.ndarray]:
        """LR and b of each path."""
        grams, counts = grams_of(path)
        j = len(path)
        same = lambda m: np.broadcast_to(m, (j, *m.shape))
        null_of = lambda beta: np.linalg.svd(beta.transpose(0, 2, 1))[2][:, -1]
        direction = null_of(rank.decomposed(sum(grams), s)[1][:, :, : p - 1])
        closed = np.concatenate([-(direction[:, 1:] / direction[:, :1])[:, None, :], same(np.eye(p - 1))], 1)
        pinned = rank.many_loadings(sum(grams), s, closed)
        nulls = [rank.many_fits(grams, counts, s, same(ones), None, a) for a in (same(one.loadings), pinned)]
        better = nulls[1][2] > nulls[0][2]
        null = np.where(better, nulls[1][2], nulls[0][2])
        own = np.where(better[:, None, None], nulls[1][1], nulls[0][1])
        frees = [rank.many_fits(grams, counts, s, beta, free_basis, a) for beta, a in ((same(free.beta), same(free.loadings)), (closed, None), (same(ones), own))]
        values = np.stack([f[2] for f in frees])
        best = values.argmax(0)
        direction = null_of(np.stack([f[0] for f in frees])[best, np.arange(j)])
        return 2 * (values.max(0) - null), direction[:, 1:] / direction[:, :1]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order)[columns].to_numpy(float)
        base = {c: rows[c].iloc[0] for c in system}
        try:
            grams, counts = grams_of(x[None])
            own_free, own_one = rank.both_fits([g[0] for g in grams], counts, s)
        except (np.linalg.LinAlgError, ValueError):
            return pd.DataFrame([], columns=[*system, "j", "lr", "b"], dtype=object)
        pi, psi = own_one.alpha @ own_one.beta.T, own_one.psi
        d = np.diff(x, axis=0)
        n = len(d) - 1
        e = d[1:] - x[1:-1] @ pi.T - np.hstack([d[:-1], np.ones((n, 1))]) @ psi.T
        first = int(rows["block"].iloc[0]) * chunk
        js = list(range(first + 1, min(first + chunk, b) + 1))
        weights, path = signs(seed, js, n), np.empty((len(js), *x.shape))
        path[:, :2] = x[:2]
        for t in range(n):
            path[:, t + 2] = path[:, t + 1] + path[:, t + 1] @ pi.T + (path[:, t + 1] - path[:, t]) @ psi[:, :p].T + psi[:, p] + weights[:, t, None] * e[t]
        out = []
        try:
            parts = [(js, *fitted(path, own_free, own_one))]
        except np.linalg.LinAlgError:  # one path at a time, so that only its own fails
            parts = []
            for j, q in zip(js, path, strict=True):
                try:
                    parts.append(([j], *fitted(q[None], own_free, own_one)))
                except np.linalg.LinAlgError:
                    out.append(base | {"j": j, "lr": None, "b": None})
        for own, lr, bs in parts:
            out += [base | {"j": j, "lr": float(v) if np.isfinite(v) else None, "b": x.tolist()} for j, v, x in zip(own, lr, bs, strict=True)]
        return pd.DataFrame(out, columns=[*system, "j", "lr", "b"], dtype=object)

    head = rank._head(levels, system)
    return blocks.groupBy(*system, "block").applyInPandas(run, ", ".join(filter(None, [head, "j int, lr double, b array<double>"])))


def normals(seed: int, js: list[int], n: int) -> np.ndarray:
    """The same weights as `normal` for rows 1 to n, a line a replicate."""
    out = np.empty((len(js), n))
    for k, j in enumerate(js):
        for t in range(1, n + 1):
            digest = hashlib.md5(f"{seed}|{j}|{t}".encode()).hexdigest()
            one, two = ((int(digest[a : a + 12], 16) + 0.5) / 2.0**48 for a in (0, 12))
            out[k, t - 1] = math.sqrt(-2 * math.log(one)) * math.cos(2 * math.pi * two)
    return out


DRAWS = {"rademacher": signs, "normal": normals}


def rebuilt(levels: np.ndarray, pi: np.ndarray, gamma: np.ndarray, fixed: np.ndarray, shocks: np.ndarray) -> np.ndarray:
    """Paths (replicates, rows, series) from two observed levels: each change is pi x + gamma dx + the
    row's deterministic part + its shock; all replicates advance together."""
    j, n, p = shocks.shape
    path = np.empty((j, n + 2, p))
    path[:, :2] = levels[:2]
    for t in range(n):
        path[:, t + 2] = path[:, t + 1] + path[:, t + 1] @ pi.T + (path[:, t + 1] - path[:, t]) @ gamma.T + fixed[t] + shocks[:, t]
    return path
