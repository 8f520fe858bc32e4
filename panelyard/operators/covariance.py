"""Covariance models that move with a scalar driver, as column expressions over rows.

A precision path is a matrix of column expressions built from given parameters; nothing
of it is collected. Residual columns are e (p of them), the driver is v.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables

#: A likelihood this far above its reference runs away to a singular covariance.
GUARD = 5000.0
Path = list[list[Column]]


def _sum(xs: list[Column]) -> Column:
    return sum(xs[1:], xs[0])


def constant_path(precision: list[list[float]]) -> Path:
    return [[F.lit(float(x)) for x in row] for row in precision]


def regime_path(precisions: list[list[list[float]]], segment: str) -> Path:
    """The precision of each row's segment."""
    p = len(precisions[0])
    pick = lambda i, j: F.coalesce(*(F.when(F.col(segment) == k, F.lit(float(m[i][j]))) for k, m in enumerate(precisions)))
    return [[pick(i, j) for j in range(p)] for i in range(p)]


def scale_path(precision: list[list[float]], b: float, centred: Column) -> Path:
    """Precision times exp(b u), for a centred driver u."""
    return [[F.lit(float(x)) * F.exp(F.lit(b) * centred) for x in row] for row in precision]


def log_precision_path(a: list[float], b: list[float], corr: list[list[float]], v: Column) -> Path:
    """L C L with L the diagonal of exp((a + b v) / 2)."""
    half = [F.exp((F.lit(x) + F.lit(y) * v) / 2) for x, y in zip(a, b, strict=True)]
    return [[half[i] * F.lit(float(corr[i][j])) * half[j] for j in range(len(a))] for i in range(len(a))]


def quadratic_path(d: list[list[float]], v: Column) -> Path:
    """Q'DQ with Q' = [I, v 1]; d has one row and column more than there are residuals."""
    p = len(d) - 1
    return [[F.lit(float(d[i][j])) + v * F.lit(float(d[i][p] + d[p][j])) + v * v * F.lit(float(d[p][p])) for j in range(p)] for i in range(p)]


def determinant(w: Path) -> Column:
    """By permutations; for up to four residuals."""
    p = len(w)
    terms = []
    for order in permutations(range(p)):
        sign = (-1) ** sum(order[i] > order[j] for i in range(p) for j in range(i + 1, p))
        term = F.lit(float(sign))
        for i, j in enumerate(order):
            term = term * w[i][j]
        terms.append(term)
    return _sum(terms)


def quadratic_form(w: Path, e: list[str]) -> Column:
    return _sum([w[i][j] * F.col(e[i]) * F.col(e[j]) for i in range(len(e)) for j in range(len(e))])


def gaussian_loglik(df: DataFrame, e: list[str], w: Path, keys: list[str]) -> DataFrame:
    """Sum of the rows' Gaussian log densities under a precision path."""
    row = (F.ln(determinant(w)) - quadratic_form(w, e) - len(e) * math.log(2 * math.pi)) / 2
    return df.na.drop(subset=e).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(row).alias("loglik"))


def log_precision_sums(df: DataFrame, e: list[str], a: list[float], b: list[float], v: Column, keys: list[str]) -> DataFrame:
    """(keys, n, sum_h, uu, vuu, sum_v): the sums of which the log-precision objective and its
    derivatives are made, h = a + b v and u = exp(h / 2) e; uu and vuu as upper triangles."""
    p = len(e)
    h = [F.lit(x) + F.lit(y) * v for x, y in zip(a, b, strict=True)]
    u = [F.exp(h[i] / 2) * F.col(e[i]) for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    return df.na.drop(subset=e).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(_sum(h)).alias("sum_h"), F.array(*(F.sum(u[i] * u[j]) for i, j in pairs)).alias("uu"), F.array(*(F.sum(v * u[i] * u[j]) for i, j in pairs)).alias("vuu"), F.sum(v).alias("sum_v")
    )


def scale_profile(df: DataFrame, e: list[str], u: str, grid: list[float], keys: list[str]) -> DataFrame:
    """(keys, b, loglik) of the scale model for every b of a grid, in one pass (two residuals at most)."""
    spark, p = df.sparkSession, len(e)
    rows = tables.with_mean(df.na.drop(subset=[*e, u]), keys, u, "__mean").withColumn("__u", F.col(u) - F.col("__mean"))
    each = rows.crossJoin(F.broadcast(spark.createDataFrame([(float(b),) for b in grid], "b double")))
    w = F.exp(F.col("b") * F.col("__u"))
    m = {(i, j): F.avg(w * F.col(e[i]) * F.col(e[j])) for i in range(p) for j in range(i, p)}
    det = m[0, 0] if p == 1 else m[0, 0] * m[1, 1] - m[0, 1] * m[0, 1]
    return each.groupBy(*keys, "b").agg((-F.count("*") / 2 * (p * (1 + math.log(2 * math.pi)) + F.ln(det))).alias("loglik"))


def ar1(df: DataFrame, e: list[str], system: list[str], date: str = "d") -> DataFrame:
    """rho (one for all residuals, cut at 0.98) and the innovations' covariance."""
    w = Window.partitionBy(*system).orderBy(date)
    lagged = df.withColumns({f"__l{i}": F.lag(c, 1).over(w) for i, c in enumerate(e)}).na.drop(subset=["__l0"])
    p = len(e)
    cross = lambda x, y: F.sum(x * y)
    now, before = [F.col(c) for c in e], [F.col(f"__l{i}") for i in range(p)]
    sums = lagged.groupBy(*system).agg(
        F.count("*").alias("n"),
        _sum([cross(a, b) for a, b in zip(now, before, strict=True)]).alias("__ab"),
        _sum([cross(b, b) for b in before]).alias("__bb"),
        *(cross(now[i], now[j]).alias(f"__n{i}{j}") for i in range(p) for j in range(i, p)),
        *(cross(before[i], before[j]).alias(f"__b{i}{j}") for i in range(p) for j in range(i, p)),
        *(cross(now[i], before[j]).alias(f"__c{i}{j}") for i in range(p) for j in range(p)),
    )
    rho = F.greatest(F.least(F.col("__ab") / F.col("__bb"), F.lit(0.98)), F.lit(-0.98))
    cov = [(F.col(f"__n{i}{j}") - F.col("rho") * (F.col(f"__c{i}{j}") + F.col(f"__c{j}{i}")) + F.col("rho") * F.col("rho") * F.col(f"__b{i}{j}")) / F.col("n") for i in range(p) for j in range(i, p)]
    return sums.withColumn("rho", rho).select(*system, "n", "rho", F.array(*cov).alias("omega"))


def positive_path(df: DataFrame, w: Path, keys: list[str]) -> DataFrame:
    """Whether every row's precision is positive definite: leading minors, native."""
    minors = [determinant([row[: k + 1] for row in w[: k + 1]]) for k in range(len(w))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.least(*minors) if len(minors) > 1 else minors[0]).alias("least_minor"))


def validity_screen(df: DataFrame, w: Path, keys: list[str], floor: float = 1e-8) -> DataFrame:
    """Least over mean of the smallest eigenvalue of each row's covariance."""
    p = len(w)
    head = df.select(*keys, *(w[i][j].alias(f"w{i}_{j}") for i in range(p) for j in range(p)))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def run(batches):  # noqa: ANN001, ANN202
        for part in batches:
            m = part[[f"w{i}_{j}" for i in range(p) for j in range(p)]].to_numpy(float).reshape(-1, p, p)
            top = np.linalg.eigvalsh(m)[:, -1]
            yield pd.concat([part[keys].reset_index(drop=True), pd.DataFrame({"smallest": 1 / top})], axis=1)

    each = head.mapInPandas(run, ", ".join(filter(None, [names, "smallest double"])))
    return each.groupBy(*keys).agg((F.min("smallest") / F.avg("smallest")).alias("ratio")).withColumn("valid", F.col("ratio") >= floor)


def block_guard(screen: DataFrame, fits: DataFrame, keys: list[str], reference: str = "reference", loglik: str = "loglik") -> DataFrame:
    """A screen joined with fits: valid only if the ratio is, and the log-likelihood is finite
    and no more than GUARD above a reference (the eigenvalue solution's)."""
    ll = F.col(loglik)
    sane = ll.isNotNull() & ~F.isnan(ll) & (F.abs(ll) < F.lit(float("inf"))) & (ll <= F.col(reference) + GUARD)
    return tables.joined(fits, screen, keys).withColumn("valid", F.col("valid") & F.coalesce(sane, F.lit(False)))


def flat_directions(df: DataFrame, v: str, loadings: list[list[float]], keys: list[str], cutoff: float = 1e-10) -> DataFrame:
    """(keys, n, nullity): how many directions of a symmetric D leave every precision Q D Q' as it is,
    for Q = [I, v A] with loadings A of one row a residual and q columns: q (q - 1) / 2 of full rank.

    The Gram of the map over rows needs the sums of the driver's first four powers only.
    """
    a = np.array(loadings, float)
    p, q = a.shape
    m = p + q
    units = []
    for i in range(m):
        for j in range(i, m):
            d = np.zeros((m, m))
            d[i, j] = d[j, i] = 1 if i == j else math.sqrt(0.5)
            units.append([d[:p, :p], d[:p, p:] @ a.T + a @ d[p:, :p], a @ d[p:, p:] @ a.T])
    parts = np.array(units)  # direction, power of v, p, p
    cross = np.einsum("iaxy,jbxy->ijab", parts, parts)
    powers = df.where(F.col(v).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.sum(F.pow(F.col(v), F.lit(k))) for k in range(5))).alias("__s"))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in powers.drop("__s").schema.fields)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            found = []
            for s in batch["__s"]:
                unit = math.sqrt(s[2] / s[0]) or 1.0  # the driver's scale changes no dimension
                weight = np.array([[s[i + j] / s[0] / unit ** (i + j) for j in range(3)] for i in range(3)])
                size = np.linalg.eigvalsh(np.einsum("ijab,ab->ij", cross, weight))
                found.append(int((size <= cutoff * size[-1]).sum()))
            yield batch.drop(columns="__s").assign(nullity=np.array(found, np.int32))

    return powers.mapInPandas(run, f"{head}, nullity int")


def vecm_path(df: DataFrame, x: list[str], z: list[str], pi: list[list[float]], psi: list[list[float]]) -> DataFrame:
    """Fitted differences Pi x + Psi z as columns f0, f1, ..."""
    fit = lambda i: _sum([F.lit(a) * F.col(c) for a, c in zip(pi[i], x, strict=True)] + [F.lit(a) * F.col(c) for a, c in zip(psi[i], z, strict=True)])
    return df.withColumns({f"f{i}": fit(i) for i in range(len(pi))})


def info_se(g_xx: np.ndarray, alpha: np.ndarray, precision: np.ndarray, h_matrix: np.ndarray) -> np.ndarray:
    """Standard errors of relation parameters: (H'(a'Wa x XX')H) inverse, root of the diagonal."""
    m = np.kron(alpha.T @ precision @ alpha, g_xx)
    return np.sqrt(np.diag(np.linalg.inv(h_matrix.T @ m @ h_matrix)))
