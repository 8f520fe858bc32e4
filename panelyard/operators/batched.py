"""Fits of many samples at once whose covariance moves with a driver.

The samples share a shape: w (samples, rows, columns y x z) and v (samples, rows). All of
them take every step together, as arrays over samples and rows, so a step costs no Python
per row, and samples that have converged leave the batch. The steps are those of a single
sample's search: the covariance parameters by Newton steps with a line search, then
relations and loadings on the weighted cross products.
"""

from __future__ import annotations

import math

import numpy as np

from . import rank

State = dict[str, np.ndarray]
Restriction = tuple[np.ndarray, np.ndarray] | None
STEPS = [2.0 ** (1 - k) for k in range(8)]
#: Newton steps are taken in d (quadratic), its factor (quadratic-factor), or the slopes b (log-precision).
MODELS = ("quadratic", "quadratic-factor", "log-precision")


def path(model: str, state: State, v: np.ndarray) -> np.ndarray:
    """The precisions as (p, p, samples, rows)."""
    if model == "log-precision":
        half = np.exp(state["b"].T[:, :, None] * v / 2)
        return half[:, None] * state["m"].transpose(1, 2, 0)[..., None] * half[None]
    d = state["d"].transpose(1, 2, 0)[..., None]
    p = len(d) - 1
    return d[:p, :p] + v * (d[:p, p:] + d[p:, :p]) + v * v * d[p, p]


def log_det(m: np.ndarray) -> np.ndarray:
    """ln|m| of symmetric (p, p, ...) by elimination; -inf where m isn't positive definite."""
    p = len(m)
    a = [[m[i, j] for j in range(p)] for i in range(p)]
    total, good = np.zeros(m.shape[2:]), np.ones(m.shape[2:], bool)
    for k in range(p):
        good &= a[k][k] > 0
        pivot = np.where(a[k][k] > 0, a[k][k], 1.0)
        total += np.log(pivot)
        for i in range(k + 1, p):
            share = a[i][k] / pivot
            for j in range(k + 1, i + 1):
                a[i][j] = a[j][i] = a[i][j] - share * a[j][k]
    return np.where(good & np.isfinite(total), total, -np.inf)


def residuals(w: np.ndarray, state: State) -> np.ndarray:
    """(p, samples, rows)."""
    j, p = len(w), state["alpha"].shape[1]
    b = np.concatenate([np.broadcast_to(np.eye(p), (j, p, p)), -state["alpha"] @ state["beta"].transpose(0, 2, 1), -state["psi"]], 2)
    return (b @ w.transpose(0, 2, 1)).transpose(1, 0, 2)


def objective(m: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Sum over rows of ln|W| - e'We of each sample; -inf if a precision isn't positive."""
    p = len(e)
    form = sum((1 if i == j else 2) * m[i, j] * e[i] * e[j] for i in range(p) for j in range(i, p))
    value = (log_det(m) - form).sum(1)
    return np.where(np.isfinite(value), value, -np.inf)


def _quadratic_moves(state: State, e: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Newton directions of each sample's d, or of its factor l if it has one."""
    p, j, n = e.shape
    inverse = np.linalg.inv(path("quadratic", state, v).transpose(2, 3, 0, 1))
    s = np.empty((j, n, p + 1, p + 1))
    s[..., :p, :p] = inverse
    s[..., p, :p] = s[..., :p, p] = v[..., None] * inverse.sum(-1)
    s[..., p, p] = v * v * inverse.sum((-1, -2))
    q = np.concatenate([e, (v * e.sum(0))[None]])
    m = p + 1
    grad = s.sum(1) - np.einsum("ajt,bjt->jab", q, q)
    flat = s.reshape(j, n, m * m)
    curve = (flat.transpose(0, 2, 1) @ flat).reshape(j, m, m, m, m)  # s_ab s_cd
    curve = curve.transpose(0, 1, 3, 2, 4)  # as s_ac s_bd, by the first and the third place
    if "l" in state:
        left, move = state["l"], np.zeros((j, m * m, m, m))
        for a in range(m):
            for c in range(m):
                move[:, a * m + c, a, :] += left[:, :, c]
                move[:, a * m + c, :, a] += left[:, :, c]
        g = np.einsum("jkab,jab->jk", move, grad)
        half = np.einsum("jkab,jabcd->jkcd", move, curve, optimize=True)
        h = np.einsum("jkcd,jlcd->jkl", half, move, optimize=True) - 2 * np.einsum("jac,bd->jabcd", grad, np.eye(m)).reshape(j, m * m, m * m)
        scale = np.sqrt(np.maximum(np.abs(np.einsum("jkk->jk", h)), 1e-300))
        size, axes = np.linalg.eigh(h / scale[:, :, None] / scale[:, None, :])
        top = np.abs(size).max(1, keepdims=True)
        size = np.where(np.abs(size) > 1e-12 * top, np.abs(size), np.inf)
        step = np.einsum("jab,jb->ja", axes, np.einsum("jba,jb->ja", axes, g / scale) / size) / scale
        return step.reshape(j, m, m)
    low = [(a, c) for c in range(m) for a in range(c, m)]
    basis = np.zeros((len(low), m, m))
    for k, (a, c) in enumerate(low):
        basis[k, a, c] = basis[k, c, a] = 1
    g = np.einsum("kab,jab->jk", basis, grad)
    h = np.einsum("kab,jabcd,lcd->jkl", basis, curve, basis, optimize=True)
    scale = np.sqrt(np.einsum("jkk->jk", h))
    step = np.linalg.pinv(h / scale[:, :, None] / scale[:, None, :], rcond=1e-15, hermitian=True) @ (g / scale)[:, :, None]
    return np.einsum("jk,kab->jab", step[:, :, 0] / scale, basis)


def _quadratic_step(state: State, e: np.ndarray, v: np.ndarray) -> None:
    move = _quadratic_moves(state, e, v)
    key = "l" if "l" in state else "d"
    form = (lambda x: x @ x.transpose(0, 2, 1)) if key == "l" else (lambda x: x)
    best = objective(path("quadratic", state, v), e)
    own, d = state[key].copy(), state["d"].copy()
    for t in STEPS:
        tried = state[key] + t * move
        value = objective(path("quadratic", {"d": form(tried)}, v), e)
        better = value > best
        own[better], d[better], best = tried[better], form(tried)[better], np.where(better, value, best)
    state[key], state["d"] = own, d


def _log_sums(b: np.ndarray, e: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Sums of u u' times 1, v and v v for each sample, u = exp(b v / 2) e."""
    with np.errstate(over="ignore", invalid="ignore"):
        u = np.exp(b[:, :, None] * v[:, None] / 2) * e.transpose(1, 0, 2)
        return [(u * (v**k)[:, None]) @ u.transpose(0, 2, 1) for k in range(3)]


def _log_value(b: np.ndarray, a0: np.ndarray, v: np.ndarray) -> np.ndarray:
    value = b.sum(1) * v.sum(1) - v.shape[1] * log_det(a0.transpose(1, 2, 0))
    return np.where(np.isfinite(value), value, -np.inf)


def _log_step(state: State, e: np.ndarray, v: np.ndarray, turns: int = 3) -> None:
    """Steps in the slopes; levels and correlations m follow from them in closed form."""
    p, n = len(e), v.shape[1]
    sums = _log_sums(state["b"], e, v)
    for _ in range(turns):
        a0, a1, a2 = sums
        inverse = np.linalg.inv(a0)
        unit = np.eye(p)[:, :, None] * np.eye(p)[:, None, :]
        first = [(x @ a1 + a1 @ x) / 2 for x in unit]
        g = v.sum(1)[:, None] - n * np.stack([np.einsum("jab,jba->j", inverse, x) for x in first], 1)
        h = np.empty((len(v), p, p))
        for i in range(p):
            for k in range(p):
                both = unit[k] @ a2 + a2 @ unit[k]
                h[:, i, k] = n * (np.einsum("jab,jba->j", inverse, unit[i] @ both + both @ unit[i]) / 4 - np.einsum("jab,jba->j", inverse @ first[i] @ inverse, first[k]))
        size, axes = np.linalg.eigh((h + h.transpose(0, 2, 1)) / 2)
        size = np.maximum(np.abs(size), 1e-12 * np.abs(size).max(1, keepdims=True))
        move = np.einsum("jab,jb->ja", axes, np.einsum("jba,jb->ja", axes, g) / size)
        best, own = _log_value(state["b"], a0, v), state["b"].copy()
        for t in STEPS:
            tried = state["b"] + t * move
            value = _log_value(tried, _log_sums(tried, e, v)[0], v)
            better = value > best
            own[better], best = tried[better], np.where(better, value, best)
        state["b"] = own
        sums = _log_sums(own, e, v)
    inverse = np.linalg.inv(sums[0])
    state["m"] = n * (inverse + inverse.transpose(0, 2, 1)) / 2


def _mean_steps(w: np.ndarray, m: np.ndarray, state: State, s: rank.Shape, restriction: Restriction, turns: int = 6) -> np.ndarray:
    """Alternates relations and loadings on the weighted cross products; the log-likelihoods."""
    j, n, p, r = len(w), w.shape[1], s.p, state["beta"].shape[2]
    cells = np.empty((j, p, p, s.size, s.size))
    for i in range(p):
        for k in range(i, p):
            cells[:, i, k] = cells[:, k, i] = (w * m[i, k][:, :, None]).transpose(0, 2, 1) @ w
    total = log_det(m).sum(1)
    sx, sy, sz = slice(p, p + s.p1), slice(0, p), slice(p + s.p1, s.size)
    for _ in range(turns):
        alpha, psi = state["alpha"], state["psi"]
        if restriction is not None:
            hm, h = restriction
            half = np.einsum("jia,jikxy->jakxy", alpha, cells[:, :, :, sx, sx], optimize=True)
            a = np.einsum("jakxy,jkb->jaxby", half, alpha, optimize=True).reshape(j, r * s.p1, r * s.p1)
            rest = np.einsum("jikxk->jix", cells[:, :, :, sx, sy]) - np.einsum("jikxz,jkz->jix", cells[:, :, :, sx, sz], psi, optimize=True)
            v = np.einsum("jia,jix->jax", alpha, rest).reshape(j, -1)
            f = np.linalg.solve(hm.T @ a @ hm, ((v - a @ h) @ hm)[:, :, None])[:, :, 0]
            state["beta"] = (f @ hm.T + h).reshape(j, r, s.p1).transpose(0, 2, 1)
        to = np.zeros((j, r + s.p2, s.size))
        to[:, :r, sx], to[:, r:, sz] = state["beta"].transpose(0, 2, 1), np.eye(s.p2)
        half = np.einsum("jcx,jikxy->jciky", to, cells, optimize=True)
        ff = np.einsum("jciky,jdy->jcidk", half, to, optimize=True).reshape(j, (r + s.p2) * p, -1)
        yf = np.einsum("jikky->jiy", cells[:, :, :, sy, :])
        yf = np.einsum("jiy,jdy->jdi", yf, to).reshape(j, -1)
        both = np.linalg.solve(ff, yf[:, :, None])[:, :, 0].reshape(j, r + s.p2, p).transpose(0, 2, 1)
        state["alpha"], state["psi"] = both[:, :, :r], both[:, :, r:]
        if restriction is None:
            break  # with given relations the loadings are exact
    b = np.concatenate([np.broadcast_to(np.eye(p), (j, p, p)), -state["alpha"] @ state["beta"].transpose(0, 2, 1), -state["psi"]], 2)
    half = np.einsum("jia,jikab->jikb", b, cells, optimize=True)
    form = np.einsum("jikb,jkb->j", half, b, optimize=True)
    return (total - form - n * p * math.log(2 * math.pi)) / 2


def search(model: str, w: np.ndarray, v: np.ndarray, s: rank.Shape, start: State, restriction: Restriction, tol: float = 1e-8, most: int = 100) -> tuple[np.ndarray, State]:
    """Log-likelihoods and parameters of each sample's ascent from `start`.

    start: alpha, beta, psi, and d (with its factor l for quadratic-factor) or b and m, one
    for each sample. restriction: H and h of the relations, or None to keep them. A sample
    whose algebra fails or likelihood isn't finite has -inf.
    """
    state = {k: np.array(x, float) for k, x in start.items()}
    last, live = np.full(len(w), -np.inf), np.arange(len(w))
    for _ in range(most):
        own = {k: x[live] for k, x in state.items()}
        ww, vv = (w, v) if len(live) == len(w) else (w[live], v[live])
        e = residuals(ww, own)
        (_log_step if model == "log-precision" else _quadratic_step)(own, e, vv)
        now = _mean_steps(ww, path(model, own, vv), own, s, restriction)
        for k, x in own.items():
            state[k][live] = x
        bad = ~np.isfinite(now)
        done = np.abs(now - last[live]) <= tol * (1 + np.abs(now))
        last[live] = np.where(bad, -np.inf, now)
        live = live[~(done | bad)]
        if not len(live):
            break
    return last, state


# The scale model has a closed form for each slope


def _scale_value(w: np.ndarray, u: np.ndarray, b: np.ndarray, s: rank.Shape, free: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-likelihoods at given slopes, and the free relations' common direction.

    From the triangular factors of weighted rows: their cross products would lose all digits
    where the weights differ much.
    """
    n, p, r = w.shape[1], s.p, s.p1 - 1
    half = b[:, None] * u / 2
    top = half.max(1, keepdims=True)
    x = w[:, :, s.x] if free else w[:, :, s.x] @ rank.spread_basis(np.ones(r))
    rows = np.concatenate([w[:, :, s.z], x, w[:, :, s.y]], 2) * np.exp(half - top)[:, :, None]
    upper = np.linalg.qr(rows, mode="r")
    ryy = upper[:, -p:, -p:]
    with np.errstate(divide="ignore"):
        spread = 2 * np.log(np.abs(np.einsum("jii->ji", ryy))).sum(1) + 2 * p * top[:, 0] - p * math.log(n)
    value, null = spread, None
    if free:
        rxx, rxy = upper[:, s.p2 : s.p2 + s.p1, s.p2 : s.p2 + s.p1], upper[:, s.p2 : s.p2 + s.p1, -p:]
        good = np.isfinite(spread)
        m = np.zeros_like(rxy)
        m[good] = np.linalg.solve(ryy[good].transpose(0, 2, 1), rxy[good].transpose(0, 2, 1)).transpose(0, 2, 1)
        left, size, _ = np.linalg.svd(np.where(np.isfinite(m), m, 0.0))
        value = spread + np.log1p(size[:, -1] ** 2)  # the relation that is left out
        null = np.einsum("jik,ji->jk", rxx, left[:, :, -1])
    return -n / 2 * (p * (1 + math.log(2 * math.pi)) + value), null


def scale_search(w: np.ndarray, u: np.ndarray, s: rank.Shape, free: bool, points: int = 17, tol: float = 1e-6, reach: float = 5.0) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Each sample's highest profile log-likelihood over slopes in [-reach, reach], its slope, and
    the b of its relations if they are free."""
    u = u - u.mean(1, keepdims=True)

    def value(b: np.ndarray) -> np.ndarray:
        found = _scale_value(w, u, b, s, free)[0]
        return np.where(np.isfinite(found), found, -np.inf)

    grid = np.linspace(-reach, reach, points)
    tried = np.stack([value(np.full(len(w), b)) for b in grid])
    top, step, ratio = grid[tried.argmax(0)], grid[1] - grid[0], (math.sqrt(5) - 1) / 2
    lo, hi = np.maximum(top - step, -reach), np.minimum(top + step, reach)
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = value(a), value(b)
    while (hi - lo).max() > tol:
        left = fa > fb
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
        new = np.where(left, hi - ratio * (hi - lo), lo + ratio * (hi - lo))
        f = value(new)
        a, b, fa, fb = np.where(left, new, b), np.where(left, a, new), np.where(left, f, fb), np.where(left, fa, f)
    at = (lo + hi) / 2
    value_at, null = _scale_value(w, u, at, s, free)
    return value_at, at, None if null is None else null[:, 1:] / null[:, :1]
