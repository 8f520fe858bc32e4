"""Reduced-rank regressions on Gram tables.

Columns of a table are ordered y (p), x (p1), z (p2). With segments, a system has one Gram
a segment. Grouped functions see these matrices only, never rows; a system whose algebra
fails gives a row with an error text instead of failing the job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.dist import chi2_sf_exact
from ..sources import tables
from .covariance import info_se
from .unitroot import square

#: 90, 95 and 99 percent quantiles of the trace statistic with an unrestricted
#: constant, for 4, 3, 2 and 1 relations left.
TRACE_AT = (90, 95, 99)
TRACE = {4: (44.4929, 47.8545, 54.6815), 3: (27.0669, 29.7961, 35.4628), 2: (13.4294, 15.4943, 19.9349), 1: (2.7055, 3.8415, 6.6349)}

#: 95 and 99 percent quantiles with the constant inside the relations, for 1 to 5.
RESTRICTED_AT = (95, 99)
RESTRICTED = {1: (9.24, 12.97), 2: (19.96, 24.60), 3: (34.91, 41.07), 4: (53.12, 60.16), 5: (76.07, 84.45)}


@dataclass
class Shape:
    p: int
    p1: int
    p2: int

    @property
    def size(self) -> int:
        return self.p + self.p1 + self.p2

    @property
    def y(self) -> list[int]:
        return list(range(self.p))

    @property
    def x(self) -> list[int]:
        return list(range(self.p, self.p + self.p1))

    @property
    def z(self) -> list[int]:
        return list(range(self.p + self.p1, self.size))


def johansen(g: np.ndarray, n: int, s: Shape) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), their vectors, and ln|S00|; z is partialled out first."""
    a = s.y + s.x
    c = g[np.ix_(a, a)] - g[np.ix_(a, s.z)] @ np.linalg.solve(g[np.ix_(s.z, s.z)], g[np.ix_(s.z, a)]) if s.p2 else g[np.ix_(a, a)]
    c = c / n
    s00, s01, s11 = c[: s.p, : s.p], c[: s.p, s.p :], c[s.p :, s.p :]
    left = np.linalg.cholesky(s11)
    half = np.linalg.solve(left, s01.T)
    lam, v = np.linalg.eigh(half @ np.linalg.solve(s00, half.T))
    order = np.argsort(-lam)
    return np.clip(lam[order], 0, 1 - 1e-15), np.linalg.solve(left.T, v[:, order]), float(np.linalg.slogdet(s00)[1])


def decomposed(g: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """As `johansen`, for many Grams at once: eigenvalues (falling) and vectors of each."""
    a = s.y + s.x
    c = g[:, a][:, :, a]
    if s.p2:
        c = c - g[:, a][:, :, s.z] @ np.linalg.solve(g[:, s.z][:, :, s.z], g[:, s.z][:, :, a])
    s00, s01, s11 = c[:, : s.p, : s.p], c[:, : s.p, s.p :], c[:, s.p :, s.p :]
    left = np.linalg.cholesky(s11)
    half = np.linalg.solve(left, s01.transpose(0, 2, 1))
    lam, v = np.linalg.eigh(half @ np.linalg.solve(s00, half.transpose(0, 2, 1)))
    return np.clip(lam[:, ::-1], 0, 1 - 1e-15), np.linalg.solve(left.transpose(0, 2, 1), v[:, :, ::-1])


def eigenvalues(w: np.ndarray, s: Shape) -> np.ndarray:
    """Eigenvalues of many samples' rows y, x, z: samples, rows, columns."""
    return decomposed(w.transpose(0, 2, 1) @ w, s)[0]


def rank_loglik(lam: np.ndarray, logdet: float, n: int, p: int, r: int) -> float:
    return -n / 2 * (p * (1 + math.log(2 * math.pi)) + logdet + float(np.log(1 - lam[:r]).sum()))


def implied_b(beta: np.ndarray) -> np.ndarray:
    """Direction that no relation sees, scaled to one in its first entry."""
    null = np.linalg.svd(beta.T)[2][-1]
    return null[1:] / null[0]


def spread_basis(b: np.ndarray) -> np.ndarray:
    """Relations x_{i+1} - b_i x_1, one a column."""
    return np.vstack([-np.asarray(b, float)[None, :], np.eye(len(b))])


def basis_restriction(r: int) -> tuple[np.ndarray, np.ndarray]:
    """H and h of vec(beta) = H b + h for the spread basis, column by column."""
    p1 = r + 1
    h_matrix, h = np.zeros((p1 * r, r)), np.zeros(p1 * r)
    for i in range(r):
        h_matrix[i * p1, i] = -1
        h[i * p1 + i + 1] = 1
    return h_matrix, h


def affine(m: np.ndarray, v: np.ndarray, r_matrix: np.ndarray | None, r: np.ndarray | None) -> np.ndarray:
    """Minimiser of a quadratic form m, v over x = R f + r (all of x if R is None; r if R has no columns)."""
    if r_matrix is None:
        return np.linalg.solve(m, v)
    if r_matrix.shape[1] == 0:
        return r
    f = np.linalg.solve(r_matrix.T @ m @ r_matrix, r_matrix.T @ (v - m @ r))
    return r_matrix @ f + r


def affine_near(loadings: np.ndarray, g_matrix: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The loadings G q + g nearest to given ones."""
    if not g_matrix.shape[1]:
        return g.reshape(loadings.shape, order="F")
    q = np.linalg.lstsq(g_matrix, loadings.ravel("F") - g, rcond=None)[0]
    return (g_matrix @ q + g).reshape(loadings.shape, order="F")


@dataclass
class Fit:
    alpha: np.ndarray
    beta: np.ndarray
    psi: np.ndarray
    omegas: list[np.ndarray]
    loglik: float
    iters: int
    converged: bool

    @property
    def loadings(self) -> np.ndarray:
        return np.hstack([self.alpha, self.psi])


def loadings_of(grams: list[np.ndarray], s: Shape, beta: np.ndarray) -> np.ndarray:
    """Least-squares loadings (alpha, psi) for given relations."""
    total, r = sum(grams), beta.shape[1]
    k = np.zeros((r + s.p2, s.size))
    k[:r, s.x], k[r:, s.z] = beta.T, np.eye(s.p2)
    return np.linalg.solve(k @ total @ k.T, k @ total[:, s.y]).T


def _omegas(grams: list[np.ndarray], counts: list[int], alpha: np.ndarray, beta: np.ndarray, psi: np.ndarray) -> list[np.ndarray]:
    b = np.hstack([np.eye(len(alpha)), -alpha @ beta.T, -psi])
    return [b @ g @ b.T / n for g, n in zip(grams, counts, strict=True)]


def _loglik(omegas: list[np.ndarray], counts: list[int]) -> float:
    p = len(omegas[0])
    return sum(-n / 2 * (p * (1 + math.log(2 * math.pi)) + np.linalg.slogdet(o)[1]) for o, n in zip(omegas, counts, strict=True))


def fit(grams: list[np.ndarray], counts: list[int], s: Shape, beta: np.ndarray, h_matrix: np.ndarray | None, h: np.ndarray | None, g_matrix: np.ndarray | None = None, g: np.ndarray | None = None, tol: float = 1e-10, most: int = 500, first: np.ndarray | None = None) -> Fit:
    """Three-block ascent from beta (and from loadings, if given): covariances, relations, loadings.

    One Gram a segment gives one covariance a segment; one Gram alone is the iid model.
    """
    r = beta.shape[1]

    def loadings(weights: list[np.ndarray], beta: np.ndarray) -> np.ndarray:
        k = np.zeros((r + s.p2, s.size))
        k[:r, s.x] = beta.T
        k[r:, s.z] = np.eye(s.p2)
        m, v = 0.0, 0.0
        for w, gram in zip(weights, grams, strict=True):
            ff, yf = k @ gram @ k.T, gram[s.y] @ k.T
            m, v = m + np.kron(ff, w), v + (w @ yf).ravel("F")
        return affine(m, v, g_matrix, g).reshape(s.p, r + s.p2, order="F")

    a = loadings_of(grams, s, beta) if first is None else first
    alpha, psi = a[:, :r], a[:, r:]
    omegas, last, done = _omegas(grams, counts, alpha, beta, psi), -np.inf, False
    for step in range(1, most + 1):
        weights = [np.linalg.inv(o) for o in omegas]
        m, v = 0.0, 0.0
        for w, gram in zip(weights, grams, strict=True):
            m = m + np.kron(alpha.T @ w @ alpha, gram[np.ix_(s.x, s.x)])
            v = v + ((gram[np.ix_(s.x, s.y)] - gram[np.ix_(s.x, s.z)] @ psi.T) @ w @ alpha).ravel("F")
        beta = affine(m, v, h_matrix, h).reshape(s.p1, r, order="F")
        a = loadings(weights, beta)
        alpha, psi = a[:, :r], a[:, r:]
        omegas = _omegas(grams, counts, alpha, beta, psi)
        now = _loglik(omegas, counts)
        if step > 1 and abs(now - last) <= tol * (1 + abs(now)):
            done = True
            break
        last = now
    return Fit(alpha, beta, psi, omegas, now, step, done)


def many_loadings(g: np.ndarray, s: Shape, beta: np.ndarray) -> np.ndarray:
    """As `loadings_of`, for many Grams at once."""
    k = np.zeros((len(g), beta.shape[2] + s.p2, s.size))
    k[:, : beta.shape[2], s.x], k[:, beta.shape[2] :, s.z] = beta.transpose(0, 2, 1), np.eye(s.p2)
    return np.linalg.solve(k @ g @ k.transpose(0, 2, 1), k @ g[:, :, s.y]).transpose(0, 2, 1)


def many_fits(grams: list[np.ndarray], counts: list[int], s: Shape, beta: np.ndarray, restriction: tuple[np.ndarray, np.ndarray] | None, first: np.ndarray | None = None, tol: float = 1e-8, most: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `fit`, for many samples at once: relations, loadings and log-likelihood of each.

    grams: for each segment, one Gram a sample; restriction: H and h of the relations (None:
    they stay as given). All samples ascend until each has met tol, or `most` times.
    """
    j, r = len(beta), beta.shape[2]
    q, p = r + s.p2, s.p
    a = many_loadings(sum(grams), s, beta) if first is None else first
    constant, last, done = p * (1 + math.log(2 * math.pi)), np.full(j, -np.inf), np.zeros(j, bool)

    def omegas() -> list[np.ndarray]:
        b = np.concatenate([np.broadcast_to(np.eye(p), (j, p, p)), -a[:, :, :r] @ beta.transpose(0, 2, 1), -a[:, :, r:]], 2)
        return [b @ g @ b.transpose(0, 2, 1) / n for g, n in zip(grams, counts, strict=True)]

    now = omegas()
    for _ in range(most):
        weights = [np.linalg.inv(o) for o in now]
        if restriction is not None:
            hm, h = restriction
            m, v = 0.0, 0.0
            alpha, psi = a[:, :, :r], a[:, :, r:]
            for w, g in zip(weights, grams, strict=True):
                gx = g[:, s.x]
                m = m + np.einsum("jab,jxy->jaxby", alpha.transpose(0, 2, 1) @ w @ alpha, gx[:, :, s.x]).reshape(j, r * s.p1, r * s.p1)
                v = v + ((gx[:, :, s.y] - gx[:, :, s.z] @ psi.transpose(0, 2, 1)) @ w @ alpha).transpose(0, 2, 1).reshape(j, -1)
            f = np.linalg.solve(hm.T @ m @ hm, ((v - m @ h) @ hm)[:, :, None])[:, :, 0]
            beta = (f @ hm.T + h).reshape(j, r, s.p1).transpose(0, 2, 1)
        k = np.zeros((j, q, s.size))
        k[:, :r, s.x], k[:, r:, s.z] = beta.transpose(0, 2, 1), np.eye(s.p2)
        m, v = 0.0, 0.0
        for w, g in zip(weights, grams, strict=True):
            m = m + np.einsum("jcd,jik->jcidk", k @ g @ k.transpose(0, 2, 1), w).reshape(j, q * p, q * p)
            v = v + (w @ g[:, s.y] @ k.transpose(0, 2, 1)).transpose(0, 2, 1).reshape(j, -1)
        a = np.linalg.solve(m, v[:, :, None])[:, :, 0].reshape(j, q, p).transpose(0, 2, 1)
        now = omegas()
        value = sum(-n / 2 * (constant + np.linalg.slogdet(o)[1]) for o, n in zip(now, counts, strict=True))
        done |= np.abs(value - last) <= tol * (1 + np.abs(value))
        last = value
        if done.all():
            break
    return beta, a, last


#: A fit's parameters as they stand in a row: loadings and relations (a line a series), one precision
#: for each segment, the quadratic form d, driver slopes b, the driver's mean, and the autoregression.
PARAMS = "struct<alpha:array<array<double>>,beta:array<array<double>>,psi:array<array<double>>,precisions:array<array<array<double>>>,d:array<array<double>>,b:array<double>,center:double,rho:double>"


def params(alpha: np.ndarray, beta: np.ndarray, psi: np.ndarray, precisions: list[np.ndarray] | None = None, d: np.ndarray | None = None, b: np.ndarray | None = None, center: float | None = None, rho: float | None = None) -> dict:
    listed = lambda x: None if x is None else np.asarray(x, float).tolist()
    return {"alpha": listed(alpha), "beta": listed(beta), "psi": listed(psi), "precisions": None if precisions is None else [listed(w) for w in precisions], "d": listed(d), "b": listed(b), "center": center, "rho": rho}


def fit_params(f: Fit, **more) -> dict:  # noqa: ANN003
    return params(f.alpha, f.beta, f.psi, [np.linalg.inv(o) for o in f.omegas], **more)


def fit_one(grams: list[np.ndarray], counts: list[int], s: Shape, **limits: float) -> Fit:
    """With b at 1."""
    r = s.p1 - 1
    ones = spread_basis(np.ones(r))
    return fit(grams, counts, s, ones, np.zeros((ones.size, 0)), ones.ravel("F"), **limits)


def fit_free(grams: list[np.ndarray], counts: list[int], s: Shape, one: Fit | None = None, **limits: float) -> Fit:
    """With free b, from the closed-form start and from b = 1; from `one` too if it is better than both."""
    r = s.p1 - 1
    hm, h = basis_restriction(r)
    start = implied_b(johansen(sum(grams), sum(counts), s)[1][:, :r])
    best = max((fit(grams, counts, s, spread_basis(b), hm, h, **limits) for b in (start, np.ones(r))), key=lambda f: f.loglik)
    return fit(grams, counts, s, one.beta, hm, h, **limits) if one is not None and one.loglik > best.loglik + 1e-8 else best


def bounded(grams: list[np.ndarray], counts: list[int], s: Shape) -> None:
    """A segment whose regressors give some mix of its series exactly has a likelihood without bound, so there is no fit."""
    for g, n in zip(grams, counts, strict=True):
        length = np.sqrt(np.diag(g))
        if not length[s.y].all():
            raise ValueError("a series doesn't move in a segment")
        w = s.x + s.z
        scale = np.where(length[w] > 0, length[w], 1)
        columns = s.p + int(np.linalg.matrix_rank(g[np.ix_(w, w)] / np.outer(scale, scale), tol=1e-13, hermitian=True))
        if n < columns:
            raise ValueError(f"{n} rows of a segment are too few for {columns} independent columns")


def both_fits(grams: list[np.ndarray], counts: list[int], s: Shape, **limits: float) -> tuple[Fit, Fit]:
    bounded(grams, counts, s)
    one = fit_one(grams, counts, s, **limits)
    return fit_free(grams, counts, s, one, **limits), one


def _head(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def _per_row(df: DataFrame, keys: list[str], tail: str, job) -> DataFrame:  # noqa: ANN001
    """job(row) -> list of dicts for each Gram row; failures become rows with an error."""
    names = [x.split()[0] for x in tail.split(", ")]  # types hold no blank after their commas

    def run(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                base = dict.fromkeys(names) | {c: getattr(r, c) for c in keys}
                try:
                    out += [base | x for x in job(r)]
                except (np.linalg.LinAlgError, ValueError, ZeroDivisionError) as e:
                    out.append(base | {"error": str(e)})
            yield pd.DataFrame(out, columns=[*keys, *names], dtype=object)

    return df.mapInPandas(run, ", ".join(filter(None, [_head(df, keys), tail])))


def trace_test(grams: DataFrame, keys: list[str], s: Shape, table: dict[int, tuple[float, ...]] | None = None, levels: tuple[int, ...] = TRACE_AT) -> DataFrame:
    """(keys, r, eigenvalue, trace, loglik, and cv and decision at each level) for each rank r.

    table: quantiles by the number of relations left (by default those of an unrestricted
    constant); give RESTRICTED and RESTRICTED_AT for a constant inside the relations.
    """
    table = TRACE if table is None else table

    def job(row):  # noqa: ANN001, ANN202
        lam, _, logdet = johansen(square(row.g, s.size), row.n, s)
        out = []
        for r in range(s.p):
            trace = float(-row.n * np.log(1 - lam[r:]).sum())
            cv = table.get(s.p - r, (None,) * len(levels))
            said = {f"cv{p}": c for p, c in zip(levels, cv, strict=True)} | {f"rejects{p}": None if c is None else bool(trace > c) for p, c in zip(levels, cv, strict=True)}
            out.append({"r": r, "eigenvalue": float(lam[r]), "trace": trace, "loglik": rank_loglik(lam, logdet, row.n, s.p, r + 1)} | said)
        return out

    more = ", ".join([*(f"cv{p} double" for p in levels), *(f"rejects{p} boolean" for p in levels)])
    return _per_row(grams, keys, f"r int, eigenvalue double, trace double, loglik double, {more}, error string", job)


def restricted_const(names: list[str], s: Shape) -> tuple[list[str], Shape]:
    """Column order with the constant inside the relations."""
    z = [c for c in names[s.p + s.p1 :] if c != "one"]
    return [*names[: s.p + s.p1], "one", *z], Shape(s.p, s.p1 + 1, s.p2 - 1)


def enough(n: int, s: Shape) -> None:
    """With fewer rows than columns the likelihood has no bound, so there is no fit."""
    if n < s.size:
        raise ValueError(f"{n} rows are too few for {s.size} columns")


def spec_fits(grams: DataFrame, keys: list[str], s: Shape, spec: str = "iid") -> DataFrame:
    """(keys, loglik_free, loglik_one, lr, b, iters) of one Gram a row."""

    def job(row):  # noqa: ANN001, ANN202
        enough(row.n, s)
        free, one = both_fits([square(row.g, s.size)], [row.n], s)
        g = square(row.g, s.size)
        se = info_se(g[np.ix_(s.x, s.x)], free.alpha, np.linalg.inv(free.omegas[0]), basis_restriction(s.p1 - 1)[0])
        return [{"spec": spec, "se": se.tolist(), "loglik_free": free.loglik, "loglik_one": one.loglik, "lr": 2 * (free.loglik - one.loglik), "b": implied_b(free.beta).tolist(), "iters": free.iters, "params_free": fit_params(free), "params_one": fit_params(one)}]

    return _per_row(grams, keys, f"spec string, loglik_free double, loglik_one double, lr double, b array<double>, se array<double>, iters int, error string, params_free {PARAMS}, params_one {PARAMS}", job)


def segment_fits(grams: DataFrame, keys: list[str], s: Shape, segment: str = "segment", spec: str = "regime") -> DataFrame:
    """As spec_fits, with one Gram (and one covariance) a segment."""
    tail = f"spec string, loglik_free double, loglik_one double, lr double, b array<double>, iters int, error string, params_free {PARAMS}, params_one {PARAMS}"
    names = [*keys, *(x.split()[0] for x in tail.split(", "))]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        base = dict.fromkeys(names) | {c: rows[c].iloc[0] for c in keys}
        rows = rows.sort_values(segment)
        try:
            free, one = both_fits([square(g, s.size) for g in rows["g"]], rows["n"].tolist(), s)
            found = {"loglik_free": free.loglik, "loglik_one": one.loglik, "lr": 2 * (free.loglik - one.loglik), "b": implied_b(free.beta).tolist(), "iters": free.iters, "params_free": fit_params(free), "params_one": fit_params(one)}
        except (np.linalg.LinAlgError, ValueError) as e:
            found = {"error": str(e)}
        return pd.DataFrame([base | {"spec": spec} | found], columns=names, dtype=object)

    return grams.groupBy(*keys).applyInPandas(run, ", ".join(filter(None, [_head(grams, keys), tail])))


def _near(beta: np.ndarray, h_matrix: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The relations of the affine set H f + h whose span comes nearest to that of beta."""
    p1, r = beta.shape
    m = np.hstack([np.kron(np.eye(r), beta), -h_matrix])
    if np.any(h):
        x = np.linalg.lstsq(m, h, rcond=None)[0]
    else:  # without a fixed part the scale is free: the direction that fits best
        x = np.linalg.svd(m)[2][-1]
    return (h_matrix @ x[r * r :] + h).reshape(p1, r, order="F")


def dimension(alpha: np.ndarray, beta: np.ndarray, p2: int, h_matrix: np.ndarray | None, g_matrix: np.ndarray | None) -> int:
    """How many directions (alpha beta', psi) can move in, under restrictions of beta and of (alpha, psi)."""
    (p, r), p1 = alpha.shape, len(beta)
    by_beta = np.vstack([np.kron(np.eye(p1), alpha)[:, [j * r + k for k in range(r) for j in range(p1)]], np.zeros((p * p2, p1 * r))])
    by_loadings = np.zeros((p * p1 + p * p2, p * (r + p2)))
    by_loadings[: p * p1, : p * r] = np.kron(beta, np.eye(p))
    by_loadings[p * p1 :, p * r :] = np.eye(p * p2)
    if h_matrix is not None:
        by_beta = by_beta @ h_matrix
    if g_matrix is not None:
        by_loadings = by_loadings @ g_matrix
    both = np.hstack([by_beta, by_loadings])
    length = np.linalg.norm(both, axis=0)  # lengths of directions say nothing about their number
    return int(np.linalg.matrix_rank(both / np.where(length > 0, length, 1), tol=1e-7))


RESTRICTION = "name string, h_matrix array<array<double>>, h array<double>, g_matrix array<array<double>>, g array<double>"


def restricted_fits(grams: DataFrame, keys: list[str], s: Shape, r: int, restrictions: DataFrame) -> DataFrame:
    """(keys, name, loglik, loglik_full, lr, df, p, ...): likelihood-ratio tests of given restrictions at rank r.

    restrictions: (keys, RESTRICTION), a row for each system and name: vec(beta) = H f + h and
    vec(alpha, psi) = G q + g, column by column; a null matrix leaves its part free, one
    without columns fixes it. The degrees are the difference of the dimensions that the two
    models can move in, so redundant columns of H and G count nothing. Restrictions that
    don't fit the shape are rows with an error.
    """
    both = tables.joined(restrictions.withColumnRenamed("g", "g_fixed"), grams, keys)

    def matrix(m, v, rows: int) -> tuple[np.ndarray | None, np.ndarray | None]:  # noqa: ANN001
        if m is None and v is None:
            return None, None
        v = np.zeros(rows) if v is None else np.asarray(v, float)
        m = np.zeros((rows, 0)) if m is None or not len(m) or not len(m[0]) else np.array([list(x) for x in m], float)
        if m.shape[0] != rows or v.shape != (rows,):
            raise ValueError(f"a restriction needs {rows} rows, not {m.shape[0]} and {len(v)}")
        axes, size, _ = np.linalg.svd(m, full_matrices=False)  # redundant columns go
        return axes[:, size > 1e-10 * max(size.max(initial=0.0), 1e-300)], v

    def job(row):  # noqa: ANN001, ANN202
        try:
            return [{"name": row.name} | tested(row)]
        except (np.linalg.LinAlgError, ValueError) as e:
            return [{"name": row.name, "error": str(e)}]

    def tested(row) -> dict:  # noqa: ANN001
        g, n = square(row.g, s.size), int(row.n)
        enough(n, s)
        hm, h = matrix(row.h_matrix, row.h, s.p1 * r)
        gm, fixed = matrix(row.g_matrix, row.g_fixed, s.p * (r + s.p2))
        lam, vectors, logdet = johansen(g, n, s)
        full, beta = rank_loglik(lam, logdet, n, s.p, r), vectors[:, :r]
        start = beta if hm is None else _near(beta, hm, h)
        f = fit([g], [n], s, start, hm, h, gm, fixed, tol=1e-11, most=5000, first=None if gm is None else affine_near(loadings_of([g], s, start), gm, fixed))
        free_alpha = loadings_of([g], s, beta)[:, :r]
        df = dimension(free_alpha, beta, s.p2, None, None) - dimension(f.alpha, f.beta, s.p2, hm, gm)
        lr = 2 * (full - f.loglik)
        return {"loglik": f.loglik, "loglik_full": full, "lr": lr, "df": df, "p": chi2_sf_exact(max(lr, 0.0), df) if df > 0 else None, "iters": f.iters, "converged": f.converged, "params": fit_params(f)}

    tail = f"name string, loglik double, loglik_full double, lr double, df int, p double, iters int, converged boolean, params {PARAMS}, error string"
    return _per_row(both, keys, tail, job)


def companion_roots(grams: DataFrame, keys: list[str], s: Shape, r: int) -> DataFrame:
    """Moduli (falling) of the companion matrix of the rank-r VECM with one lagged difference."""

    def job(row):  # noqa: ANN001, ANN202
        g = square(row.g, s.size)
        beta = johansen(g, row.n, s)[1][:, :r]
        f = fit([g], [row.n], s, beta, None, None)
        gamma = f.psi[:, : s.p]
        top = np.hstack([np.eye(s.p) + f.alpha @ f.beta.T + gamma, -gamma])
        roots = np.abs(np.linalg.eigvals(np.vstack([top, np.hstack([np.eye(s.p), np.zeros((s.p, s.p))])])))
        return [{"roots": np.sort(roots)[::-1].tolist()}]

    return _per_row(grams, keys, "roots array<double>, error string", job)
