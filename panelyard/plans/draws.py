"""Wild bootstrap draws of every covariance model, under b = 1 or under the free fit.

A fit's row (with its parameters) is joined to its system's rows and to blocks of replicate
numbers; a task holds one system's rows and one block, whose replicates are rebuilt and
fitted together as arrays. A draw depends on seed, replicate and row alone, so it is the
same on any partitioning, and draws kept in a table can be gone on with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batched, panel, rank, replication, resample
from ..sources import results, tables
from . import compare, driven, fits

#: Specification: how its covariance is fitted, and how its driver is made.
MODELS = {
    "iid": ("segments", None), "regime": ("segments", None), "quadratic": ("quadratic", "level"), "quadratic-factor": ("quadratic-factor", "level"),
    "scale": ("scale", "level"), "scale-log": ("scale", "log"), "log-precision": ("log-precision", "level"), "log-precision-log": ("log-precision", "log"),
}


def driver_of(changes: np.ndarray, kind: str | None) -> np.ndarray | None:
    """Each row's driver from the changes before it: (samples, rows), over its mean, or its centred log."""
    if kind is None:
        return None
    v = np.abs(changes).mean(2)
    v = v / v.mean(1, keepdims=True)
    if kind == "log":
        v = np.log(np.maximum(v, 1e-300))
        v = v - v.mean(1, keepdims=True)
    return v


class Estimator:
    """Fits of many samples (w, v) of one model: their log-likelihoods, relations and parameters."""

    def __init__(self, model: str, s: rank.Shape, breaks: list[int], tol: float, most: int) -> None:
        self.how, self.s, self.breaks, self.tol, self.most = MODELS[model][0], s, breaks, tol, most
        r = s.p1 - 1
        self.basis, self.ones = rank.basis_restriction(r), rank.spread_basis(np.ones(r))

    def _grams(self, w: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        parts = np.split(w, [k for k in self.breaks if k < w.shape[1]], 1)
        return [q.transpose(0, 2, 1) @ q for q in parts], [q.shape[1] for q in parts]

    def closed(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Relations of the eigenvalue solution, in the spread basis, and their loadings."""
        g = w.transpose(0, 2, 1) @ w
        r = self.s.p1 - 1
        null = np.linalg.svd(rank.decomposed(g, self.s)[1][:, :, :r].transpose(0, 2, 1))[2][:, -1]
        beta = np.concatenate([-(null[:, 1:] / null[:, :1])[:, None, :], np.broadcast_to(np.eye(r), (len(w), r, r))], 1)
        return beta, rank.many_loadings(g, self.s, beta)

    def start(self, w: np.ndarray, beta: np.ndarray, loadings: np.ndarray, theta: batched.State | None = None) -> batched.State:
        """Where an ascent begins; without theta the covariance is that of the residuals, constant."""
        r, p = beta.shape[2], self.s.p
        state = {"beta": beta, "alpha": loadings[:, :, :r], "psi": loadings[:, :, r:]}
        if theta is not None or self.how in ("segments", "scale"):
            return state | (theta or {})
        e = batched.residuals(w, state)
        precision = np.linalg.inv(np.einsum("ajt,bjt->jab", e, e) / w.shape[1])
        if self.how == "log-precision":
            return state | {"b": np.zeros((len(w), p)), "m": precision}
        d = np.zeros((len(w), p + 1, p + 1))
        d[:, :p, :p] = precision
        if self.how == "quadratic-factor":
            d[:, p, p] = 1e-3 * np.einsum("jii->j", precision) / p
            return state | {"d": d, "l": np.stack([driven.factor(x) for x in d])}
        return state | {"d": d}

    def fit(self, w: np.ndarray, v: np.ndarray | None, start: batched.State, free: bool) -> tuple[np.ndarray, batched.State]:
        if self.how == "segments":
            grams, counts = self._grams(w)
            first = np.concatenate([start["alpha"], start["psi"]], 2)
            beta, a, value = rank.many_fits(grams, counts, self.s, start["beta"], self.basis if free else None, first, self.tol, self.most)
            r = beta.shape[2]
            return np.where(np.isfinite(value), value, -np.inf), {"beta": beta, "alpha": a[:, :, :r], "psi": a[:, :, r:]}
        if self.how == "scale":  # one search finds the highest profile, whatever the start
            value, _, b = batched.scale_search(w, v, self.s, free)
            return np.where(np.isfinite(value), value, -np.inf), {"beta": np.stack([rank.spread_basis(x) for x in b]) if free else start["beta"]}
        return batched.search(self.how, w, v, self.s, start, self.basis if free else None, self.tol, self.most)

    def theta(self, at: dict) -> batched.State | None:
        """A fitted covariance as a start for many samples."""
        lists = lambda x: np.array([list(y) for y in x], float)
        if self.how.startswith("quadratic"):
            d = lists(at["d"])
            return {"d": d[None]} | ({"l": driven.factor(d)[None]} if self.how == "quadratic-factor" else {})
        if self.how == "log-precision":
            return {"b": np.array(at["b"], float)[None], "m": lists(at["precisions"][0])[None]}
        return None


def _best(found: list[tuple[np.ndarray, batched.State]]) -> tuple[np.ndarray, batched.State]:
    values = np.stack([f[0] for f in found])
    best, j = values.argmax(0), np.arange(values.shape[1])
    return values.max(0), {k: np.stack([f[1][k] for f in found])[best, j] for k in found[0][1]}


def replicate(est: Estimator, kind: str | None, w: np.ndarray, levels: np.ndarray, at: dict[str, dict], under: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LR (null under the free fit) and b of each replicate with these weights.

    w, levels: the observed design and series; at: the free and the restricted parameters.
    """
    s, p = est.s, est.s.p
    matrix = lambda x: np.array([list(y) for y in x], float)
    own = {k: (matrix(x["beta"]), np.hstack([matrix(x["alpha"]), matrix(x["psi"])])) for k, x in at.items()}
    beta, a = own["free" if under == "free" else "one"]
    r = beta.shape[1]
    pi, psi = a[:, :r] @ beta.T, a[:, r:]
    e = w[:, s.y] - w[:, s.x] @ pi.T - w[:, s.z] @ psi.T
    fixed = w[:, s.z][:, p:]
    path = resample.rebuilt(levels, pi, psi[:, :p], fixed @ psi[:, p:].T, weights[:, :, None] * e)
    changes = np.diff(path, axis=1)
    j = len(weights)
    ww = np.concatenate([changes[:, 1:], path[:, 1:-1], changes[:, :-1], np.broadcast_to(fixed, (j, *fixed.shape))], 2)
    v = driver_of(changes[:, :-1], kind)
    same = lambda x: np.broadcast_to(x, (j, *x.shape))
    theta = lambda k: {n: np.broadcast_to(x, (j, *x.shape[1:])) for n, x in (est.theta(at[k]) or {}).items()} or None
    closed, closed_a = est.closed(ww)
    starts = [est.start(ww, same(own["free"][0]), same(own["free"][1]), theta("free"))]
    if est.how != "scale":
        starts.append(est.start(ww, closed, closed_a))
    b_of = lambda state: -state["beta"][:, 0]
    if under == "free":
        value, state = _best([est.fit(ww, v, x, True) for x in starts])
        return np.full(j, np.nan), np.where(np.isfinite(value)[:, None], b_of(state), np.nan)
    pinned = [est.start(ww, same(est.ones), same(own["one"][1]), theta("one"))]
    if est.how != "scale":
        pinned.append(est.start(ww, same(est.ones), rank.many_loadings(ww.transpose(0, 2, 1) @ ww, s, same(est.ones))))
    null, at_null = _best([est.fit(ww, v, x, False) for x in pinned])
    frees = [est.fit(ww, v, x, True) for x in starts]
    if est.how != "scale":
        frees.append(est.fit(ww, v, at_null, True))
    frees.append((null, at_null))  # the restricted optimum is a point of the free model, so LR isn't negative
    value, state = _best(frees)
    lr = 2 * (value - null)
    return np.where(np.isfinite(lr), lr, np.nan), np.where(np.isfinite(value)[:, None], b_of(state), np.nan)


def draws(df: DataFrame, columns: list[str], system: list[str], fitted: DataFrame, model: str, b: int, seed: int, under: str = "one", breaks: panel.Breaks | None = None, scheme: str = "rademacher", date: str = "d", fixed: list[str] | None = None, chunk: int = 125, tol: float = 1e-7, most: int = 60, only: DataFrame | None = None) -> DataFrame:
    """(system, j, lr, b) of replicates 1 to b of one of MODELS.

    fitted: the system's fit with params_free and params_one. under "one" the data are drawn
    with b = 1 and lr is the replicate's; under "free" they are drawn from the free fit, two
    free starts are tried, and lr is null. Deterministic terms (`fixed`, columns of df) stay
    with their dates; the driver is made anew from each replicate's own changes. A replicate
    whose fit fails has nulls. only: (system, block) to draw, blocks of `chunk` from 0.
    """
    rows, names, s = fits.design(df, columns, system, date, fixed)
    kind = MODELS[model][1]
    own = fitted.select(*system, F.col("params_free").alias("__free"), F.col("params_one").alias("__one")).where("__free IS NOT NULL AND __one IS NOT NULL")
    keys = [*system, "__block"]
    data = rows.select(*system, date, *names)
    # Parameters come once a block, not with every row.
    plan = own.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((b - 1) // chunk))))
    if only is not None:
        plan = tables.joined(plan, only.withColumnRenamed("block", "__block"), keys, "left_semi")
    plan = panel.with_breaks(plan, system, [] if breaks is None else breaks)
    blocks = data.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((b - 1) // chunk))))

    def run(part: pd.DataFrame, who: pd.DataFrame) -> pd.DataFrame:
        out_names = [*system, "j", "lr", "b"]
        if not len(part) or not len(who):
            return pd.DataFrame([], columns=out_names, dtype=object)
        part = part.sort_values(date)
        w, base = part[names].to_numpy(float), {c: part[c].iloc[0] for c in system}
        first = int(part["__block"].iloc[0]) * chunk
        js = list(range(first + 1, min(first + chunk, b) + 1))
        at = {"free": who["__free"].iloc[0], "one": who["__one"].iloc[0]}
        levels = np.vstack([w[0, s.x] - w[0, s.z][: s.p], w[0, s.x]])  # the two rows before the first change
        weights = resample.DRAWS[scheme](seed, js, len(w))
        est, out = Estimator(model, s, [int(k) for k in who["__breaks"].iloc[0]] if model == "regime" else [], tol, most), []
        try:
            lr, bs = replicate(est, kind, w, levels, at, under, weights)
        except np.linalg.LinAlgError:  # one at a time, so that only its own fails
            lr, bs = np.full(len(js), np.nan), np.full((len(js), s.p1 - 1), np.nan)
            for k in range(len(js)):
                try:
                    lr[k : k + 1], bs[k : k + 1] = replicate(est, kind, w, levels, at, under, weights[k : k + 1])
                except np.linalg.LinAlgError:
                    continue
        for j, value, row in zip(js, lr, bs, strict=True):
            out.append(base | {"j": j, "lr": float(value) if np.isfinite(value) else None, "b": row.tolist() if np.isfinite(row).all() else None})
        return pd.DataFrame(out, columns=out_names, dtype=object)

    head = rank._head(df, system)
    schema = ", ".join(filter(None, [head, "j int, lr double, b array<double>"]))
    return blocks.groupBy(*keys).cogroup(plan.groupBy(*keys)).applyInPandas(run, schema)


def fitted_models(df: DataFrame, columns: list[str], system: list[str], models: list[str], breaks: panel.Breaks, date: str = "d", fixed: list[str] | None = None) -> DataFrame:
    """(system, spec, loglik_free, loglik_one, lr, params_free, params_one) of the models."""
    return _fitted_models(tables.written(df, "panel"), columns, system, models, breaks, date, fixed)


def _fitted_models(df: DataFrame, columns: list[str], system: list[str], models: list[str], breaks: panel.Breaks, date: str, fixed: list[str] | None) -> DataFrame:
    """fitted_models of rows that are cheap to read many times."""
    drivers = {k: panel.volatility_driver(df, columns, system, date, k) for k in ("level", "log")}
    out = None
    for name in models:
        spec = compare.SPECS[name]
        one = spec.fit(drivers[spec.driver] if spec.driver else df, columns, system, breaks, date, fixed)
        one = one.select(*system, F.lit(name).alias("spec"), "loglik_free", "loglik_one", "lr", "params_free", "params_one")
        out = one if out is None else out.unionByName(one)
    return out


def pvalues(df: DataFrame, columns: list[str], system: list[str], models: list[str], breaks: panel.Breaks, b: int, seed: int, date: str = "d", fixed: list[str] | None = None, **more) -> DataFrame:  # noqa: ANN003
    """P-values of each system's LR of b = 1 under each model, from draws under b = 1."""
    df = tables.written(df, "panel")
    found = tables.written(_fitted_models(df, columns, system, models, breaks, date, fixed), "fits")
    all_draws = None
    for name in models:
        one = draws(df, columns, system, found.where(F.col("spec") == name), name, b, seed, "one", breaks, date=date, fixed=fixed, **more).withColumn("spec", F.lit(name))
        all_draws = one if all_draws is None else all_draws.unionByName(one)
    kept = tables.written(all_draws.where("lr IS NOT NULL"), "draws")
    keys = [*system, "spec"]
    observed = found.select(*keys, F.col("lr").alias("observed"))
    out = replication.bootstrap_pvalue(tables.joined(kept, observed, keys), [*keys, "observed"], "observed")
    return out


def standard_errors(df: DataFrame, columns: list[str], system: list[str], models: list[str], breaks: panel.Breaks, b: int, seed: int, date: str = "d", fixed: list[str] | None = None, **more) -> DataFrame:  # noqa: ANN003
    """(system, spec, component, n, se): deviations of b over draws from each model's free fit."""
    df = tables.written(df, "panel")
    found = tables.written(_fitted_models(df, columns, system, models, breaks, date, fixed), "fits")
    out = None
    for name in models:
        one = draws(df, columns, system, found.where(F.col("spec") == name), name, b, seed, "free", breaks, date=date, fixed=fixed, **more).withColumn("spec", F.lit(name))
        out = one if out is None else out.unionByName(one)
    each = out.where("b IS NOT NULL").select(*system, "spec", F.posexplode("b").alias("component", "value"))
    return each.groupBy(*system, "spec", "component").agg(F.count("*").alias("n"), F.stddev_samp("value").alias("se"))


def resumed(df: DataFrame, columns: list[str], system: list[str], fitted: DataFrame, model: str, b: int, seed: int, path: str, under: str = "one", chunk: int = 125, **more) -> DataFrame:  # noqa: ANN003
    """The draws kept as a table: only blocks with missing replicates are drawn and appended."""
    plan = fitted.select(*system).distinct().withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(b))))

    def job(missing: DataFrame) -> DataFrame:
        only = missing.select(*system, F.floor((F.col("j") - 1) / chunk).cast("int").alias("block")).distinct()
        found = draws(df, columns, system, fitted, model, b, seed, under, chunk=chunk, only=only, **more)
        return tables.joined(found, missing, [*system, "j"], "left_semi")

    return results.resume_append(plan, path, [*system, "j"], job, [])
