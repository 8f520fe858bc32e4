"""Fits whose covariance moves with a scalar driver: quadratic (free, or kept positive by a
factor) and log-precision.

All of them alternate sums over a system's rows with small algebra:

* the tensor kernel sums ln|W| and every W_ij w_a w_b, after which relations and loadings
  are alternated without touching rows;
* the covariance kernels sum an objective with its derivatives; all step sizes of a line
  search are tried at once.

A system of up to LONG rows is fitted whole by one task of a grouped job, so many systems
run side by side and nothing of them reaches the driver program. Longer systems are read
by passes: a pass sends their parameters to the tasks, which return partial sums that Spark
adds up; the algebra between passes is then done for them in the driver program, whose work
is bounded by the number of rows over LONG. Both ways give the same results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import covariance, moments, rank
from ..operators.unitroot import square
from ..sources import tables
from . import fits

Params = dict[str, dict[str, np.ndarray]]
Kernel = Callable[[np.ndarray, np.ndarray, dict], np.ndarray]
Pass = Callable[[Kernel, Params], dict[str, np.ndarray]]
MODELS = ("quadratic", "quadratic-factor", "log-precision")
STEPS = [2.0 ** (1 - k) for k in range(9)]


def passed(rows: DataFrame, names: list[str], kernel: Kernel, params: Params) -> dict[str, np.ndarray]:
    """The kernel's sums over each system's rows (columns __k, names, __v)."""
    sent = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for key, part in batch.groupby("__k"):
                if key in sent.value:
                    out = kernel(part[names].to_numpy(float), part["__v"].to_numpy(float), sent.value[key])
                    yield pd.DataFrame({"k": key, "pos": np.arange(len(out), dtype=np.int32), "value": out})

    sums = rows.mapInPandas(run, "k string, pos int, value double").groupBy("k", "pos").agg(F.sum("value").alias("value"))
    found: dict[str, dict[int, float]] = {}
    for r in sums.collect():
        found.setdefault(r["k"], {})[r["pos"]] = r["value"]
    sent.unpersist()
    return {k: np.array([x[i] for i in range(len(x))]) for k, x in found.items()}


def quadratic_w(d: np.ndarray, v: np.ndarray) -> np.ndarray:
    p = len(d) - 1
    return d[:p, :p] + v[:, None, None] * (d[:p, p:] + d[p:, :p]) + (v * v)[:, None, None] * d[p, p]


def log_precision_w(b: np.ndarray, m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """L M L with L the diagonal of exp(b v / 2); M holds levels and correlations together."""
    half = np.exp(v[:, None] * b / 2)
    return half[:, :, None] * m * half[:, None, :]


def _path(model: str, theta: dict, v: np.ndarray) -> np.ndarray:
    return log_precision_w(theta["b"], theta["m"], v) if model == "log-precision" else quadratic_w(theta["d"], v)


def _tensor(model: str, p: int) -> Kernel:
    def kernel(w: np.ndarray, v: np.ndarray, theta: dict) -> np.ndarray:
        m = _path(model, theta, v)
        cells = [(w * m[:, i, j, None]).T @ w for i in range(p) for j in range(i, p)]
        return np.concatenate([[len(w), np.linalg.slogdet(m)[1].sum()], *(c[np.triu_indices(w.shape[1])] for c in cells)])

    return kernel


def _mean_steps(total: np.ndarray, s: rank.Shape, f: dict, restriction: tuple[np.ndarray, np.ndarray], rounds: int = 25) -> float:
    """Alternates relations and loadings on a tensor, in place; the log-likelihood."""
    p, size = s.p, s.size
    n, logdet, k = total[0], total[1], 2
    half = size * (size + 1) // 2
    m = np.zeros((p, p, size, size))
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = square(total[k : k + half], size)
            k += half
    hm, h = restriction
    r = f["beta"].shape[1]
    last = -np.inf
    for _ in range(rounds):
        alpha, psi = f["alpha"], f["psi"]
        mx, my, mz = m[:, :, s.x][:, :, :, s.x], m[:, :, s.x][:, :, :, s.y], m[:, :, s.x][:, :, :, s.z]
        a = np.einsum("ia,ijxy,jb->axby", alpha, mx, alpha).reshape(r * s.p1, r * s.p1)
        rest = np.einsum("ijxj->ix", my) - np.einsum("ijxz,jz->ix", mz, psi)
        v = np.einsum("ia,ix->ax", alpha, rest).ravel()
        f["beta"] = rank.affine(a, v, hm, h).reshape(s.p1, r, order="F")
        to = np.zeros((r + s.p2, size))
        to[:r, s.x], to[r:, s.z] = f["beta"].T, np.eye(s.p2)
        ff = np.einsum("cx,ijxy,dy->cidj", to, m, to).reshape((r + s.p2) * p, -1)
        yf = np.einsum("ijjy,dy->di", m[:, :, s.y], to).ravel()
        both = np.linalg.solve(ff, yf).reshape(r + s.p2, p).T
        f["alpha"], f["psi"] = both[:, :r], both[:, r:]
        b = np.hstack([np.eye(p), -f["alpha"] @ f["beta"].T, -f["psi"]])
        now = (logdet - np.einsum("ia,ijab,jb->", b, m, b) - n * p * math.log(2 * math.pi)) / 2
        if now - last < 1e-9 * abs(now):
            break
        last = now
    f["b_matrix"] = b
    return float(now)


def _quadratic_kernel(w: np.ndarray, v: np.ndarray, f: dict) -> np.ndarray:
    """Gradient and curvature of sum ln|W| - e'We in D."""
    e = w @ f["b_matrix"].T
    p = e.shape[1]
    q = np.concatenate([np.broadcast_to(np.eye(p), (len(v), p, p)), np.broadcast_to(v[:, None, None], (len(v), p, 1))], 2)
    s = np.einsum("tia,tij,tjb->tab", q, np.linalg.inv(quadratic_w(f["d"], v)), q)
    qe = np.einsum("tia,ti->ta", q, e)
    return np.concatenate([(s.sum(0) - qe.T @ qe).ravel(), np.einsum("tab,tcd->abcd", s, s).ravel()])


def _trial_kernel(w: np.ndarray, v: np.ndarray, f: dict) -> np.ndarray:
    """The quadratic objective at every trial."""
    e = w @ f["b_matrix"].T
    out = []
    for theta in f["trials"]:
        m = quadratic_w(theta["d"], v)
        good = np.isfinite(m).all() and (np.linalg.eigvalsh(m)[:, 0] > 0).all()
        out.append(np.linalg.slogdet(m)[1].sum() - np.einsum("ti,tij,tj->", e, m, e) if good else -1e300)
    return np.array(out)


def _quadratic_direction(sums: np.ndarray, d: np.ndarray) -> list[dict]:
    m = len(d)
    grad, curve = sums[: m * m].reshape(m, m), sums[m * m :].reshape(m, m, m, m)
    low = [(i, j) for j in range(m) for i in range(j, m)]
    basis = np.zeros((len(low), m, m))
    for k, (i, j) in enumerate(low):
        basis[k, i, j] = basis[k, j, i] = 1
    g = np.einsum("kab,ab->k", basis, grad)
    h = np.einsum("kab,abcd,lcd->kl", basis, curve.transpose(0, 3, 1, 2), basis)
    scale = np.sqrt(np.diag(h))
    step = np.linalg.lstsq(h / np.outer(scale, scale), g / scale, rcond=1e-15)[0] / scale
    move = np.einsum("k,kab->ab", step, basis)
    return [{"d": d + t * move} for t in STEPS]


def nullity(sums: np.ndarray, m: int, cutoff: float = 1e-10) -> int:
    """Directions of symmetric D along which the quadratic likelihood is flat, from the kernel's sums.

    One driver column leaves none; q columns of a path v A leave q (q - 1) / 2.
    """
    low = [(i, j) for j in range(m) for i in range(j, m)]
    basis = np.zeros((len(low), m, m))
    for k, (i, j) in enumerate(low):
        basis[k, i, j] = basis[k, j, i] = 1 if i == j else math.sqrt(0.5)
    h = np.einsum("kab,abcd,lcd->kl", basis, sums[m * m :].reshape(m, m, m, m).transpose(0, 3, 1, 2), basis)
    size = np.linalg.eigvalsh((h + h.T) / 2)
    return int((size <= cutoff * size[-1]).sum())


def factor(d: np.ndarray) -> np.ndarray:
    """L of the nearest positive D = LL'."""
    size, axes = np.linalg.eigh((d + d.T) / 2)
    return axes * np.sqrt(np.maximum(size, 0))


def _factor_direction(sums: np.ndarray, f: dict) -> list[dict]:
    """Trials along a Newton step in L, where D = LL' is positive whatever L is."""
    left = f["l"]
    m = len(left)
    grad, curve = sums[: m * m].reshape(m, m), sums[m * m :].reshape(m, m, m, m).transpose(0, 3, 1, 2)
    grad = (grad + grad.T) / 2
    move = np.zeros((m * m, m, m))  # what each entry of L moves in D
    for i in range(m):
        for j in range(m):
            move[i * m + j, i, :] += left[:, j]
            move[i * m + j, :, i] += left[:, j]
    g = np.einsum("kab,ab->k", move, grad)
    h = np.einsum("kab,abcd,lcd->kl", move, curve, move) - 2 * np.kron(grad, np.eye(m))
    scale = np.sqrt(np.maximum(np.abs(np.diag(h)), 1e-300))
    size, axes = np.linalg.eigh(h / np.outer(scale, scale))
    size = np.where(np.abs(size) > 1e-12 * np.abs(size).max(), np.abs(size), np.inf)  # rotations of L change nothing
    step = (axes @ ((axes.T @ (g / scale)) / size) / scale).reshape(m, m)
    trials = [left + t * step for t in STEPS]
    return [{"l": x, "d": x @ x.T} for x in trials]


def _log_kernel(w: np.ndarray, v: np.ndarray, f: dict) -> np.ndarray:
    """For every trial b: sums of u u' times 1, v and v v, u = exp(b v / 2) e; first n and the sum of v."""
    e = w @ f["b_matrix"].T
    out = [np.array([len(v), v.sum()])]
    for theta in f["trials"]:
        with np.errstate(over="ignore", invalid="ignore"):
            u = np.exp(v[:, None] * theta["b"] / 2) * e
            out += [((u * v[:, None] ** k).T @ u).ravel() for k in range(3)]
    return np.concatenate(out)


def _log_profile(sums: np.ndarray, f: dict) -> None:
    """Takes the best trial b. Given b the best M is n over the sum of u u', so the objective
    and its gradient are those of b alone."""
    p, n, total_v = len(f["b"]), sums[0], sums[1]
    best, found = -np.inf, None
    for k, theta in enumerate(f["trials"]):
        parts = sums[2 + 3 * k * p * p :][: 3 * p * p].reshape(3, p, p)
        if not np.isfinite(parts).all() or np.linalg.eigvalsh(parts[0])[0] <= 0:
            continue
        value = theta["b"].sum() * total_v - n * np.linalg.slogdet(parts[0])[1]
        if value > best:
            best, found = value, (theta["b"], parts)
    f["b"], (a0, a1, a2) = found
    inverse = np.linalg.inv(a0)
    f["m"] = n * (inverse + inverse.T) / 2
    unit = np.eye(p)[:, :, None] * np.eye(p)[:, None, :]  # one diagonal entry each
    first = [(e @ a1 + a1 @ e) / 2 for e in unit]
    g = total_v - n * np.array([np.trace(inverse @ x) for x in first])
    h = np.empty((p, p))
    for i in range(p):
        for j in range(p):
            both = unit[j] @ a2 + a2 @ unit[j]
            h[i, j] = n * (np.trace(inverse @ (unit[i] @ both + both @ unit[i])) / 4 - np.trace(inverse @ first[i] @ inverse @ first[j]))
    size, axes = np.linalg.eigh((h + h.T) / 2)
    f["move"] = axes @ ((axes.T @ g) / np.maximum(np.abs(size), 1e-12 * np.abs(size).max()))


def _log_trials(f: dict) -> list[dict]:
    now = [{"b": f["b"]}]
    return now + [{"b": f["b"] + t * f["move"]} for t in STEPS] if "move" in f else now


def _starts(start: dict[str, tuple[np.ndarray, int]], kind: str, s: rank.Shape, model: str) -> tuple[Params, dict[str, str]]:
    state: Params = {}
    errors: dict[str, str] = {}
    for k, (g, n) in start.items():
        try:
            f = (rank.fit_one if kind == "one" else rank.fit_free)([g], [n], s)
            w = np.linalg.inv(f.omegas[0])
        except (np.linalg.LinAlgError, ValueError) as e:
            errors[k] = str(e)
            continue
        own = {"alpha": f.alpha, "beta": f.beta, "psi": f.psi, "b_matrix": np.hstack([np.eye(s.p), -f.alpha @ f.beta.T, -f.psi])}
        if model == "log-precision":
            own |= {"b": np.zeros(s.p), "m": w}
        else:
            own["d"] = np.block([[w, np.zeros((s.p, 1))], [np.zeros((1, s.p + 1))]])
            if model == "quadratic-factor":  # L's last column must not start at nothing, or it stays there
                own["d"][s.p, s.p] = 1e-3 * np.trace(w) / s.p
                own["l"] = factor(own["d"])
        state[k] = own | {"reference": f.loglik}
    return state, errors


def search(start: dict[str, tuple[np.ndarray, int]], s: rank.Shape, model: str, run: Pass, tol: float, most: int) -> dict[str, dict]:
    """Fits of all keys under both restrictions; start: each key's Gram and rows."""
    hm, h = rank.basis_restriction(s.p1 - 1)
    fixed_beta = (np.zeros((len(h), 0)), rank.spread_basis(np.ones(s.p1 - 1)).ravel("F"))
    results: dict[str, dict] = {k: {"error": None} for k in start}
    for kind in ("one", "free"):
        state, errors = _starts(start, kind, s, model)
        for k, e in errors.items():
            results[k]["error"] = e
        last: dict[str, float] = {}
        open_keys = set(state)
        for step in range(1, most + 1):
            live = {k: state[k] for k in open_keys}
            if model == "log-precision":
                for _ in range(3):
                    for f in live.values():
                        f["trials"] = _log_trials(f)
                    for k, sums in run(_log_kernel, live).items():
                        _log_profile(sums, state[k])
            else:
                for k, sums in run(_quadratic_kernel, live).items():
                    f = live[k]
                    f["flat"] = nullity(sums, s.p + 1)
                    now = {"d": f["d"]} | ({"l": f["l"]} if "l" in f else {})
                    f["trials"] = [now, *(_factor_direction(sums, f) if "l" in f else _quadratic_direction(sums, f["d"]))]
                for k, value in run(_trial_kernel, live).items():
                    state[k] |= live[k]["trials"][int(np.argmax(value))]
            for k, total in run(_tensor(model, s.p), live).items():
                now = _mean_steps(total, s, state[k], fixed_beta if kind == "one" else (hm, h))
                if not math.isfinite(now) or now > state[k]["reference"] + covariance.GUARD:
                    results[k]["error"] = "the likelihood runs away to a singular covariance"
                    open_keys.discard(k)
                if abs(now - last.get(k, -np.inf)) <= tol * (1 + abs(now)):
                    open_keys.discard(k)
                last[k] = now
                results[k][f"iters_{kind}"] = step
                state[k].pop("trials", None)
            if not open_keys:
                break
        for k in state:
            f = state[k]
            own = {"precisions": [f["m"]], "b": f["b"]} if model == "log-precision" else {"d": f["d"]}
            results[k] |= {f"loglik_{kind}": last[k], f"converged_{kind}": k not in open_keys, f"params_{kind}": rank.params(f["alpha"], f["beta"], f["psi"], **own)}
            if kind == "free":
                results[k] |= {"b": rank.implied_b(state[k]["beta"]).tolist(), "nullity": state[k].get("flat")}
    for r in results.values():
        r["lr"] = None if r["error"] else 2 * (r["loglik_free"] - r["loglik_one"])
    return results


FIT = f"spec string, loglik_free double, loglik_one double, lr double, b array<double>, nullity int, iters_free int, iters_one int, converged_free boolean, converged_one boolean, error string, params_free {rank.PARAMS}, params_one {rank.PARAMS}"
FIELDS = [x.split()[0] for x in FIT.split(", ")]


def fit(df: DataFrame, columns: list[str], system: list[str], driver: str, model: str = "quadratic", date: str = "d", fixed: list[str] | None = None, tol: float = 1e-8, most: int = 200, long: int = fits.LONG) -> DataFrame:
    """(system, spec, loglik_free, loglik_one, lr, b, ...) of one of MODELS, with the outer rounds of
    each restriction, whether they met tol before `most` of them, and the flat directions of D."""
    rows, names, s = fits.design(df, columns, system, date, fixed)
    keys = system or ["whole"]
    rows = (rows if system else rows.withColumn("whole", F.lit(0))).select(*keys, *names, F.col(driver).alias("__v")).na.drop(subset=[*names, "__v"])
    small, others = fits.by_length(rows, keys, long)
    head = rank._head(small, keys)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        w, v = part[names].to_numpy(float), part["__v"].to_numpy(float)
        row = dict.fromkeys(FIELDS) | {c: part[c].iloc[0] for c in keys} | {"spec": model}
        try:
            row |= search({"": (w.T @ w, len(w))}, s, model, lambda kernel, params: {k: kernel(w, v, f) for k, f in params.items()}, tol, most)[""]
        except (np.linalg.LinAlgError, ValueError) as e:
            row["error"] = str(e)
        return pd.DataFrame([row], columns=[*keys, *FIELDS], dtype=object)

    out = small.groupBy(*keys).applyInPandas(run, f"{head}, {FIT}")
    if others is not None:
        out = out.unionByName(_by_passes(others, names, keys, s, model, tol, most))
    return out.drop("whole")


def _by_passes(rows: DataFrame, names: list[str], keys: list[str], s: rank.Shape, model: str, tol: float, most: int) -> DataFrame:
    # A key as text keeps nulls and separators apart.
    rows = rows.withColumn("__k", F.to_json(F.struct(*keys))).persist()
    start = {r["__k"]: (square(r["g"], s.size), r["n"]) for r in moments.gram_rows(rows, names, ["__k"]).collect()}
    found = search(start, s, model, lambda kernel, params: passed(rows, names, kernel, params), tol, most)
    out = rows.sparkSession.createDataFrame([(k, *((r | {"spec": model}).get(c) for c in FIELDS)) for k, r in found.items()], f"__k string, {FIT}")
    named = tables.written(rows.select("__k", *keys).distinct(), "systems")
    rows.unpersist()
    return named.join(out, "__k").drop("__k")


def fixed_fits(df: DataFrame, columns: list[str], system: list[str], weights: DataFrame, date: str = "d", fixed: list[str] | None = None) -> DataFrame:
    """Fits with known precisions: weights has (system, date, w), w the upper triangle of each row's precision.

    One aggregation joins the weights and sums the weighted Grams and ln|W|; systems run side by side.
    """
    rows, names, s = fits.design(df, columns, system, date, fixed)
    keys = system or ["whole"]
    p, w = s.p, weights.select(*system, date, F.col("w").alias("__w"))
    rows = tables.joined(rows, w, [*system, date])
    rows = (rows if system else rows.withColumn("whole", F.lit(0))).na.drop(subset=[*names, "__w"])
    cells = [f"__w{k}" for k in range(p * (p + 1) // 2)]
    rows = rows.withColumns({c: F.col("__w")[k] for k, c in enumerate(cells)})

    def kernel(part: np.ndarray) -> np.ndarray:
        x, m = part[:, : s.size], np.zeros((len(part), p, p))
        m[:, *np.triu_indices(p)] = part[:, s.size :]
        m += np.triu(m, 1).transpose(0, 2, 1)
        own = [(x * m[:, i, j, None]).T @ x for i in range(p) for j in range(i, p)]
        upper = np.triu_indices(s.size)
        return np.concatenate([[len(x), np.linalg.slogdet(m)[1].sum()], *(c[upper] for c in own), (x.T @ x)[upper]])

    table, size = moments.kernel_sums(rows, [*names, *cells], keys, kernel), s.size * (s.size + 1) // 2

    def job(row):  # noqa: ANN001, ANN202
        hm, h = rank.basis_restriction(s.p1 - 1)
        ones = (np.zeros((len(h), 0)), rank.spread_basis(np.ones(s.p1 - 1)).ravel("F"))
        total, g, out = np.array(row.sums[:-size]), square(row.sums[-size:], s.size), {"spec": "fixed"}
        for kind, start, restriction in (("one", rank.fit_one, ones), ("free", rank.fit_free, (hm, h))):
            first = start([g], [int(total[0])], s)
            f = {"alpha": first.alpha, "beta": first.beta, "psi": first.psi}
            out[f"loglik_{kind}"] = _mean_steps(total, s, f, restriction, rounds=500)
        return [out | {"lr": 2 * (out["loglik_free"] - out["loglik_one"]), "b": rank.implied_b(f["beta"]).tolist()}]

    return rank._per_row(table, keys, "spec string, loglik_free double, loglik_one double, lr double, b array<double>, error string", job).drop("whole")
