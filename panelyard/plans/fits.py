"""Jobs that compute a fit's Gram tables and hand them to the algebra.

Each specification declares which moments it needs; everything else is shared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..operators import batched, moments, panel, rank
from ..operators.unitroot import square
from ..sources import tables
from ..sources.tables import LONG, by_length


def design(df: DataFrame, columns: list[str], system: list[str], date: str = "d", fixed: list[str] | None = None) -> tuple[DataFrame, list[str], rank.Shape]:
    """Rows of the VECM with one lagged difference: y, x, then z = lagged difference, constant, fixed."""
    rows = panel.lag_design(df, columns, 2, system, date).withColumn("one", F.lit(1.0))
    names = [*(f"y_{c}" for c in columns), *(f"x_{c}" for c in columns), *(f"z1_{c}" for c in columns), "one", *(fixed or [])]
    rows = rows.na.drop(subset=names)
    p = len(columns)
    return panel.numbered(rows, system, date), names, rank.Shape(p, p, p + 1 + len(fixed or []))


def iid(df: DataFrame, columns: list[str], system: list[str], date: str = "d", fixed: list[str] | None = None) -> DataFrame:
    rows, names, s = design(df, columns, system, date, fixed)
    return rank.spec_fits(moments.gram_rows(rows, names, system), system, s)


def regime(df: DataFrame, columns: list[str], system: list[str], breaks: panel.Breaks, date: str = "d", fixed: list[str] | None = None) -> DataFrame:
    """One covariance a segment; breaks: a list for all systems, or a table (system, breaks)."""
    rows, names, s = design(df, columns, system, date, fixed)
    grams = moments.gram_rows(panel.with_segments(rows, system, breaks), names, [*system, "segment"])
    return rank.segment_fits(grams, system, s)


def break_grid(df: DataFrame, columns: list[str], system: list[str], breaks: panel.Breaks, reach: int, date: str = "d", fixed: list[str] | None = None) -> DataFrame:
    """(system, s1, s2, loglik_free, loglik_one, lr, error): both breaks moved by up to `reach` rows.

    breaks: two for all systems, or a table (system, breaks) with two of each one's own. One
    pass sums the rows between neighbouring edges. A task takes a system's pieces and one
    place of the first break, cumulates them, and fits every place of the second.
    """
    rows, names, s = design(df, columns, system, date, fixed)
    near = F.flatten(F.transform("__breaks", lambda k: F.sequence(k - reach, k + reach)))
    rows = panel.with_breaks(rows, system, breaks).where(F.size("__breaks") == 2).withColumn("__edges", F.array_sort(F.array_distinct(near)))
    pieces = moments.gram_rows(rows.withColumn("piece", panel.segment(F.col("t"), F.col("__edges"))), names, [*system, "__breaks", "__edges", "piece"])
    tail = "s2 int, loglik_free double, loglik_one double, lr double, error string"
    keys, steps = [*system, "s1"], range(-reach, reach + 1)
    each = pieces.withColumn("s1", F.explode(F.array(*(F.lit(k) for k in steps)))).repartition(tables.partitions(df.sparkSession), *keys)
    fields = [*keys, *(x.split()[0] for x in tail.split(", "))]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        base, out = {c: part[c].iloc[0] for c in keys}, []
        breaks, edges = part["__breaks"].iloc[0], list(part["__edges"].iloc[0])
        sums, counts = np.zeros((len(edges) + 2, s.size, s.size)), np.zeros(len(edges) + 2, np.int64)
        for piece, g, n in zip(part["piece"], part["g"], part["n"], strict=True):
            sums[piece + 1], counts[piece + 1] = square(g, s.size), n
        sums, counts = sums.cumsum(0), counts.cumsum()
        for s2 in steps:
            row = dict.fromkeys(fields) | base | {"s2": s2}
            ends = [0, *sorted(sum(e <= c for e in edges) for c in (breaks[0] + int(base["s1"]), breaks[1] + s2)), len(edges) + 1]
            at = [(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True) if counts[b] > counts[a]]
            try:
                free, one = rank.both_fits([sums[b] - sums[a] for a, b in at], [int(counts[b] - counts[a]) for a, b in at], s, tol=1e-8, most=200)
                row |= {"loglik_free": free.loglik, "loglik_one": one.loglik, "lr": 2 * (free.loglik - one.loglik)}
            except Exception as e:  # noqa: BLE001  a grid point that fails is a row with its error
                row["error"] = str(e)
            out.append(row)
        return pd.DataFrame(out, columns=fields, dtype=object)

    return each.groupBy(*keys).applyInPandas(run, f"{rank._head(each, keys)}, {tail}")


def break_profile(df: DataFrame, columns: list[str], system: list[str], first: int = 12, last: int = 12, step: int = 1, date: str = "d", fixed: list[str] | None = None) -> DataFrame:
    """(system, k, loglik_free, loglik_one, lr, error): the regime model with one break after row k,
    for every step-th k from `first` to `last` rows before the end.

    One pass sums the rows between neighbouring cuts; prefix sums of whole Grams then give both
    sides of every cut, and the cuts are fitted side by side.
    """
    rows, names, s = design(df, columns, system, date, fixed)
    keys = system or ["whole"]
    rows = rows if system else rows.withColumn("whole", F.lit(0))
    cut = F.greatest(F.ceil((F.col("t") - first) / step), F.lit(0)).cast("int")
    sums = moments.prefix_gram_rows(moments.gram_rows(rows.withColumn("piece", cut), names, [*keys, "piece"]), keys)
    cuts = sums.where(F.col("n_total") - F.col("n_before") >= last).select(*keys, "n_before", "before", "n_total", "total").repartition(tables.partitions(df.sparkSession))

    def job(row):  # noqa: ANN001, ANN202
        left, whole = square(row.before, s.size), square(row.total, s.size)
        out = {"k": int(row.n_before)}
        try:
            free, one = rank.both_fits([left, whole - left], [int(row.n_before), int(row.n_total - row.n_before)], s, tol=1e-9, most=500)
        except (np.linalg.LinAlgError, ValueError) as e:
            return [out | {"error": str(e)}]
        return [out | {"loglik_free": free.loglik, "loglik_one": one.loglik, "lr": 2 * (free.loglik - one.loglik)}]

    return rank._per_row(cuts, keys, "k int, loglik_free double, loglik_one double, lr double, error string", job).drop("whole")


def best_break(profile: DataFrame, system: list[str]) -> DataFrame:
    """(system, k, loglik, n_cuts): where the free likelihood of a profile is highest; the first of equal ones."""
    good = profile.where(F.col("loglik_free").isNotNull() & ~F.isnan("loglik_free"))
    top = F.max(F.struct(F.col("loglik_free").alias("loglik"), (-F.col("k")).alias("less"))).alias("top")
    return good.groupBy(*system).agg(top, F.count("*").alias("n_cuts")).select(*system, (-F.col("top.less")).alias("k"), F.col("top.loglik").alias("loglik"), "n_cuts")


def grid_summary(grid: DataFrame, system: list[str], df: int | None = None) -> DataFrame:
    """Extremes of the LR over a grid; with df, also of its p-value and how many exceed 0.05."""
    p = dist.chi2_sf(F.col("lr"), df) if df else None
    more = [] if p is None else [F.max(p).alias("max_p"), F.min(p).alias("min_p"), F.count_if(p > 0.05).alias("n_above"), F.count_if(F.col("lr").isNull()).alias("n_failed")]
    return grid.groupBy(*system).agg(
        F.min("lr").alias("min_lr"), F.max("lr").alias("max_lr"), F.median("lr").alias("median_lr"), F.min_by(F.struct("s1", "s2"), "lr").alias("at_min"), F.max_by(F.struct("s1", "s2"), "lr").alias("at_max"), F.count("lr").alias("n"), *more
    )


def _scale_one(w: np.ndarray, u: np.ndarray, s: rank.Shape, points: int, tol: float) -> dict:
    """One system's profile search over b, for both restrictions.

    Given b the likelihood has a closed form (batched.scale_search: a grid, then golden
    section); relations, loadings and covariance are then fitted at the best b.
    """
    center = float(u.mean())
    u, out = u - center, {"converged": True}
    for kind, fitted in (("free", rank.fit_free), ("one", rank.fit_one)):
        _, slope, _ = batched.scale_search(w[None], u[None], s, kind == "free", points, tol)
        b = float(slope[0])
        best = fitted([(w * np.exp(b * u)[:, None]).T @ w], [len(w)], s)
        out |= {f"loglik_{kind}": best.loglik, f"b_{kind}": b, f"params_{kind}": rank.fit_params(best, b=np.array([b]), center=center)}
        if kind == "free":
            out["b"] = rank.implied_b(best.beta).tolist()
    return out | {"lr": 2 * (out["loglik_free"] - out["loglik_one"])}


SCALE = f"loglik_free double, b_free double, loglik_one double, b_one double, b array<double>, converged boolean, error string, lr double, params_free {rank.PARAMS}, params_one {rank.PARAMS}"


def scale(df: DataFrame, columns: list[str], system: list[str], driver: str, date: str = "d", fixed: list[str] | None = None, rounds: int = 40, points: int = 17, tol: float = 1e-8, long: int = LONG) -> DataFrame:
    """Covariance scaled by exp(-b (u - mean u)): the profile likelihood over b in [-5, 5].

    A system's answer depends on its own rows alone. Systems of up to `long` rows are searched
    in one task each (a grid, then golden section). For longer ones every (system, restriction)
    has its own bracket, part of a row of a small table: each round sums the weighted Grams of
    all its points in one pass and closes each bracket around its own best point, until all are
    no wider than tol or rounds are used up. Both find the same place if the profile has one
    peak between the neighbours of the best of the `points`.
    """
    rows, names, s = design(df, columns, system, date, fixed)
    keys = system or ["whole"]
    rows = (rows if system else rows.withColumn("whole", F.lit(0))).select(*keys, *names, F.col(driver).alias("__v")).where("__v is not null")
    small, others = by_length(rows, keys, long)
    head = rank._head(small, keys)
    fields = [x.split()[0] for x in SCALE.split(", ")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        row = dict.fromkeys(fields) | {c: part[c].iloc[0] for c in keys}
        try:
            row |= _scale_one(part[names].to_numpy(float), part["__v"].to_numpy(float), s, points, tol)
        except (np.linalg.LinAlgError, ValueError) as e:
            row["error"] = str(e)
        return pd.DataFrame([row], columns=[*keys, *fields], dtype=object)

    out = small.groupBy(*keys).applyInPandas(run, f"{head}, {SCALE}")
    if others is not None:
        out = out.unionByName(_scale_by_passes(others, names, keys, s, rounds, points, tol))
    return out.drop("whole")


BRACKET = ["lo_free", "hi_free", "lo_one", "hi_one"]


def _scale_by_passes(rows: DataFrame, names: list[str], keys: list[str], s: rank.Shape, rounds: int, points: int, tol: float) -> DataFrame:
    """As _scale_one for long systems. A round reads the rows once: every batch sums the Grams of
    all points of its systems' brackets, and a job on those sums closes the brackets."""
    mean = tables.written(rows.groupBy(*keys).agg(F.avg("__v").alias("__mean")), "means")
    rows = tables.joined(rows, mean, keys).select(*keys, *names, (F.col("__v") - F.col("__mean")).alias("__u"))
    half, triangle = s.size * (s.size + 1) // 2, np.triu_indices(s.size)
    ends = {"free": (s.size + 1, s.size + 2), "one": (s.size + 3, s.size + 4)}

    def kernel(part: np.ndarray) -> np.ndarray:
        w, u = part[:, : s.size], part[:, s.size]
        grids = [np.linspace(part[0, lo], part[0, hi], points) for lo, hi in ends.values()]
        return np.concatenate([[len(part)], *(((w * np.exp(b * u)[:, None]).T @ w)[triangle] for grid in grids for b in grid)])

    def job(row):  # noqa: ANN001, ANN202
        out, n, sums = {"error": None}, int(row.sums[0]), np.array(row.sums[1:]).reshape(2 * points, half)
        for turn, (kind, fitted) in enumerate((("free", rank.fit_free), ("one", rank.fit_one))):
            lo, hi = getattr(row, f"lo_{kind}"), getattr(row, f"hi_{kind}")
            best, step = None, (hi - lo) / (points - 1)
            for b, g in zip(np.linspace(lo, hi, points), sums[turn * points :], strict=False):
                try:
                    f = fitted([square(g, s.size)], [n], s)
                except np.linalg.LinAlgError as e:
                    out["error"] = str(e)
                    continue
                if math.isfinite(f.loglik) and (best is None or f.loglik > best[1].loglik):
                    best = (float(b), f)
            if best is None:
                return [out]
            out |= {f"loglik_{kind}": best[1].loglik, f"b_{kind}": best[0], f"lo_{kind}": max(-5.0, best[0] - step), f"hi_{kind}": min(5.0, best[0] + step)}
            out[f"params_{kind}"] = rank.fit_params(best[1], b=np.array([best[0]]))
            if kind == "free":
                out["b"] = rank.implied_b(best[1].beta).tolist()
        return [out | {"error": None}]

    at = tables.written(mean.select(*keys, *(F.lit(-5.0 if c.startswith("lo") else 5.0).alias(c) for c in BRACKET)), "brackets")
    tail = f"{', '.join(f'{c} double' for c in BRACKET)}, loglik_free double, b_free double, loglik_one double, b_one double, b array<double>, error string, params_free {rank.PARAMS}, params_one {rank.PARAMS}"
    span = 10.0
    for _ in range(rounds):
        own = at.select(*keys, *BRACKET).where("lo_free IS NOT NULL")
        sums = moments.kernel_sums(tables.joined(rows, own, keys), [*names, "__u", *BRACKET], keys, kernel)
        before, at = at, tables.written(rank._per_row(tables.joined(sums, own, keys).repartition(tables.partitions(rows.sparkSession)), keys, tail, job), "brackets")
        tables.dropped(before)
        span *= 2 / (points - 1)  # the widest that a bracket can be now
        if span <= tol:
            break
    out = tables.joined(at, mean, keys)
    closed = F.coalesce((F.col("hi_free") - F.col("lo_free") <= tol) & (F.col("hi_one") - F.col("lo_one") <= tol), F.lit(False))
    out = out.withColumns({f"params_{k}": F.col(f"params_{k}").withField("center", F.col("__mean")) for k in ("free", "one")} | {"converged": closed, "lr": 2 * (F.col("loglik_free") - F.col("loglik_one"))})
    return out.drop("__mean", *BRACKET)


def ar1(df: DataFrame, columns: list[str], system: list[str], date: str = "d", fixed: list[str] | None = None, tol: float = 1e-8, most: int = 60) -> DataFrame:
    """Residuals that follow an autoregression with one coefficient rho, cut at 0.98.

    One pass sums products of rows with themselves and with the row before; then relations,
    loadings and rho alternate on these tables.
    """
    rows, names, s = design(df, columns, system, date, fixed)
    keys, k = system or ["whole"], s.size
    lags = [f"__l{i}" for i in range(k)]
    w = panel.ordered(system, date)
    rows = rows.withColumns({x: F.lag(c).over(w) for x, c in zip(lags, names, strict=True)})
    rows = rows if system else rows.withColumn("whole", F.lit(0))

    def kernel(part: np.ndarray) -> np.ndarray:
        later = part[~np.isnan(part[:, k])]
        first = part[np.isnan(part[:, k])][:, :k]
        return np.concatenate([[len(part)], (first.T @ first).ravel(), (later.T @ later).ravel()])

    def job(row):  # noqa: ANN001, ANN202
        n, sums = int(row.sums[0]), np.array(row.sums[1:])
        one, both = sums[: k * k].reshape(k, k), sums[k * k :].reshape(2 * k, 2 * k)
        now, cross, before = both[:k, :k], both[:k, k:], both[k:, k:]
        out = {"spec": "ar1"}

        def moved(rho: float) -> np.ndarray:  # of differenced rows, without the first
            return now - rho * (cross + cross.T) + rho * rho * before

        for kind, fitted in (("free", rank.fit_free), ("one", rank.fit_one)):
            rho, last = 0.0, None
            for step in range(1, most + 1):  # a root of (rho that the residuals have) - rho, by secants
                f = fitted([moved(rho) + (1 - rho * rho) * one], [n], s, tol=1e-9)
                b = np.hstack([np.eye(s.p), -f.alpha @ f.beta.T, -f.psi])
                found = float(np.clip(np.trace(b @ cross @ b.T) / np.trace(b @ before @ b.T), -0.98, 0.98))
                gap = found - rho
                if abs(gap) <= tol:
                    break
                slope = (gap - last[1]) / (rho - last[0]) if last and rho != last[0] else 0.0
                guess = rho - gap / slope if slope < 0 else found
                last, rho = (rho, gap), guess if -0.98 <= guess <= 0.98 else found
            rho = found
            omega, spread = b @ moved(rho) @ b.T / (n - 1), b @ (moved(rho) + (1 - rho * rho) * one) @ b.T
            value = -(n * s.p * math.log(2 * math.pi) + n * np.linalg.slogdet(omega)[1] - s.p * math.log(1 - rho * rho) + np.trace(np.linalg.solve(omega, spread))) / 2
            out |= {f"loglik_{kind}": float(value), f"rho_{kind}": rho, f"converged_{kind}": abs(gap) <= tol, f"params_{kind}": rank.params(f.alpha, f.beta, f.psi, [np.linalg.inv(omega)], rho=rho)}
            if kind == "free":
                out["b"] = rank.implied_b(f.beta).tolist()
        return [out | {"lr": 2 * (out["loglik_free"] - out["loglik_one"])}]

    tail = f"spec string, loglik_free double, loglik_one double, lr double, b array<double>, rho_free double, rho_one double, converged_free boolean, converged_one boolean, error string, params_free {rank.PARAMS}, params_one {rank.PARAMS}"
    return rank._per_row(moments.kernel_sums(rows, [*names, *lags], keys, kernel), keys, tail, job).drop("whole")
