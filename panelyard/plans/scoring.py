"""Rows scored under fits: residuals, precisions, log-likelihoods and standard errors.

A fit's row holds its parameters as arrays (rank.PARAMS). They are joined to the rows by
system and applied by column expressions, so any number of systems is scored in one pass
and nothing of a fit is a literal of the plan. Fits are as wide as a system's parameters;
a join with them is broadcast only if Spark finds them small.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import covariance, panel, rank
from ..sources import tables
from . import fits

MODELS = ("iid", "regime", "scale", "quadratic", "quadratic-factor", "log-precision", "ar1")


@dataclass(frozen=True)
class Scored:
    """Rows with residuals e0.., fitted differences f0.. and their deterministic part det0.., and the
    precision w of each; the log density of a row needs nothing else."""

    rows: DataFrame
    shape: rank.Shape
    names: list[str]
    system: list[str]
    path: covariance.Path
    model: str

    @property
    def residuals(self) -> list[str]:
        return [f"e{i}" for i in range(self.shape.p)]


def precision(model: str, at: Column, p: int, driver: Column, segment: Column) -> covariance.Path:
    """The precision of a row, from its system's parameters `at`."""
    cells = range(p)
    if model == "regime":
        return [[at["precisions"][segment][i][j] for j in cells] for i in cells]
    if model == "scale":
        factor = F.exp(at["b"][0] * (driver - at["center"]))
        return [[at["precisions"][0][i][j] * factor for j in cells] for i in cells]
    if model.startswith("quadratic"):
        return [[at["d"][i][j] + driver * (at["d"][i][p] + at["d"][p][j]) + driver * driver * at["d"][p][p] for j in cells] for i in cells]
    if model == "log-precision":
        half = [F.exp(at["b"][i] * driver / 2) for i in cells]
        return [[half[i] * at["precisions"][0][i][j] * half[j] for j in cells] for i in cells]
    return [[at["precisions"][0][i][j] for j in cells] for i in cells]


def score(df: DataFrame, columns: list[str], system: list[str], fitted: DataFrame, model: str, kind: str = "free", breaks: panel.Breaks | None = None, driver: str = "v", date: str = "d", fixed: list[str] | None = None) -> Scored:
    """df's rows under the `kind` (free or one) fits of one model; fitted: a table with
    params_free and params_one of each system. Systems without a fit have no rows."""
    rows, names, s = fits.design(df, columns, system, date, fixed)
    p, r = s.p, s.p1 - 1
    if model in ("scale", "quadratic", "quadratic-factor", "log-precision"):
        rows = rows.where(F.col(driver).isNotNull())
    own = fitted.select(*system, F.col(f"params_{kind}").alias("__at")).where("__at IS NOT NULL")
    met = tables.joined(rows, own, system) if system else rows.crossJoin(F.broadcast(own))  # one fit without systems
    at, x, z = F.col("__at"), [names[k] for k in s.x], [names[k] for k in s.z]
    total = lambda terms: sum(terms[1:], terms[0])
    met = met.withColumns({f"__s{k}": total([at["beta"][j][k] * F.col(c) for j, c in enumerate(x)]) for k in range(r)})
    parts = lambda i, which: total([at["psi"][i][m] * F.col(c) for m, c in which])
    lagged, plain = list(enumerate(z))[:p], list(enumerate(z))[p:]
    met = met.withColumns({f"det{i}": parts(i, plain) for i in range(p)})
    met = met.withColumns({f"f{i}": total([at["alpha"][i][k] * F.col(f"__s{k}") for k in range(r)]) + parts(i, lagged) + F.col(f"det{i}") for i in range(p)})
    met = met.withColumns({f"e{i}": F.col(names[i]) - F.col(f"f{i}") for i in range(p)})
    met = panel.with_segments(met, system, [] if breaks is None else breaks, "__segment")
    path = precision(model, at, p, F.col(driver) if driver in df.columns else F.lit(0.0), F.col("__segment"))
    met = met.withColumns({f"w{i}_{j}": path[i][j] for i in range(p) for j in range(i, p)})
    if model == "ar1":
        w = panel.ordered(system, date)
        met = met.withColumns({f"e{i}": F.when(F.col("t") == 1, F.col(f"e{i}") * F.sqrt(1 - at["rho"] * at["rho"])).otherwise(F.col(f"e{i}") - at["rho"] * F.lag(f"e{i}").over(w)) for i in range(p)})
        met = met.withColumn("__first", F.when(F.col("t") == 1, p * F.ln(1 - at["rho"] * at["rho"]) / 2).otherwise(0.0))
    found = [[F.col(f"w{min(i, j)}_{max(i, j)}") for j in range(p)] for i in range(p)]
    return Scored(met.drop(*(f"__s{k}" for k in range(r))), s, names, system, found, model)


def loglik(scored: Scored) -> DataFrame:
    """(system, n, loglik): the rows' Gaussian log densities, which add up to the fit's own loglik."""
    p, e = scored.shape.p, scored.residuals
    density = (F.ln(covariance.determinant(scored.path)) - covariance.quadratic_form(scored.path, e) - p * math.log(2 * math.pi)) / 2
    if scored.model == "ar1":
        density = density + F.col("__first")
    return scored.rows.groupBy(*scored.system).agg(F.count("*").alias("n"), F.sum(density).alias("loglik"))


def standard_errors(scored: Scored, h_matrix: np.ndarray | None = None) -> DataFrame:
    """(system, n, se): standard errors of the relations' parameters under vec(beta) = H b + h.

    They come from H' (sum of alpha' W alpha x xx') H with each row's own precision W, so one
    pass sums every W_ij x_a x_b, and the algebra sees those sums alone. By default H is that
    of the spread basis.
    """
    s = scored.shape
    h_matrix = rank.basis_restriction(s.p1 - 1)[0] if h_matrix is None else h_matrix
    pairs, cells = [(i, j) for i in range(s.p) for j in range(i, s.p)], [(a, b) for a in range(s.p1) for b in range(a, s.p1)]
    x = [scored.names[k] for k in s.x]
    sums = F.array(*(F.sum(F.col(f"w{i}_{j}") * F.col(x[a]) * F.col(x[b])) for i, j in pairs for a, b in cells))
    table = scored.rows.groupBy(*scored.system).agg(F.count("*").alias("n"), F.first("__at.alpha").alias("alpha"), sums.alias("sums"))
    system = scored.system
    names = [*system, "n", "se", "error"]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                base = {c: getattr(row, c) for c in [*system, "n"]} | {"se": None, "error": None}
                alpha, own = np.array([list(v) for v in row.alpha]), np.array(row.sums, float).reshape(len(pairs), len(cells))
                m = np.zeros((s.p, s.p, s.p1, s.p1))
                for (i, j), line in zip(pairs, own, strict=True):
                    for (a, b), value in zip(cells, line, strict=True):
                        m[i, j, a, b] = m[i, j, b, a] = m[j, i, a, b] = m[j, i, b, a] = value
                info = np.einsum("ik,ijab,jl->kalb", alpha, m, alpha).reshape(alpha.shape[1] * s.p1, -1)
                try:
                    base["se"] = np.sqrt(np.diag(np.linalg.inv(h_matrix.T @ info @ h_matrix))).tolist()
                except np.linalg.LinAlgError as error:
                    base["error"] = str(error)
                out.append(base)
            yield pd.DataFrame(out, columns=names, dtype=object)

    return table.mapInPandas(run, ", ".join(filter(None, [rank._head(table, system), "n bigint, se array<double>, error string"])))
