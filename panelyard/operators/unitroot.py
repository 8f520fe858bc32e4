"""Unit-root, lag-length and residual tests.

Row work is one superset Gram table a system (plans.moments); every lag length, seasonal
block or regression reads a part of it. The grouped function works on those small
matrices, so its parallel axis is systems.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dist import chi2_sf, chi2_sf_exact, normal_cdf_exact, TAU_LARGE, TAU_MAX, TAU_MIN, TAU_SMALL, TAU_STAR
from ..sources import tables
from . import moments, panel


def square(g: list[float], k: int) -> np.ndarray:
    """The symmetric matrix of a Gram row."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = g
    return out + np.triu(out, 1).T


def solve(g: np.ndarray, y: list[int], x: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the columns y on x, and the residual cross products."""
    b = np.linalg.solve(g[np.ix_(x, x)], g[np.ix_(x, y)])
    return b, g[np.ix_(y, y)] - g[np.ix_(y, x)] @ b


def ols(df: DataFrame, y: str, x: list[str], system: list[str]) -> DataFrame:
    """(system, n, b, se, s2) of y on x (give a constant column yourself)."""
    k = len(x) + 1
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*system).schema.fields)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            g = square(r.g, k)
            b, ee = solve(g, [0], list(range(1, k)))
            s2 = float(ee[0, 0]) / (r.n - (k - 1))
            se = np.sqrt(s2 * np.diag(np.linalg.inv(g[1:, 1:])))
            out.append({**{c: getattr(r, c) for c in system}, "n": r.n, "b": b[:, 0].tolist(), "se": se.tolist(), "s2": s2})
        return pd.DataFrame(out, columns=[*system, "n", "b", "se", "s2"])

    schema = ", ".join(filter(None, [names, "n bigint, b array<double>, se array<double>, s2 double"]))
    return moments.gram_rows(df, [y, *x], system).mapInPandas(lambda it: (run(r) for r in it if len(r)), schema)


def ols_one(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """Slope, intercept, slope's error and R2 of one regressor, by built-in aggregates."""
    s2 = (F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)) / (F.regr_count(y, x) - 2)
    return df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.sqrt(s2 / F.regr_sxx(y, x)).alias("se"), F.regr_r2(y, x).alias("r2")
    )


def adf0(long: DataFrame, keys: list[str], value: str = "value", date: str = "d", critical: float = -2.87) -> DataFrame:
    """Unit-root t statistic without lags, with a constant, and the 5 percent decision."""
    w = Window.partitionBy(*keys).orderBy(date)
    moved = long.withColumns({"dx": F.col(value) - F.lag(value).over(w), "lx": F.lag(value).over(w)})
    fit = ols_one(moved, "dx", "lx", keys)
    return fit.withColumn("t", F.col("slope") / F.col("se")).select(*keys, "n", "t", (F.col("t") < critical).alias("rejects"))


#: Asymptotic quantiles of the t statistic at 1, 5 and 10 percent, with a
#: constant (c), and with a constant and a trend (ct).
ADF_AT = (1, 5, 10)
ADF = {"c": (-3.43, -2.86, -2.57), "ct": (-3.96, -3.41, -3.13)}


def adf(long: DataFrame, keys: list[str], lags: int, trend: str = "c", value: str = "value", date: str = "d") -> DataFrame:
    """(keys, n, t, decisions): unit-root t statistic with a fixed number of lags, a constant and, with ct, a trend.

    One Gram a series, of differences, the lagged level, its differences' lags and the terms.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    out = long.withColumns({"dx": F.col(value) - F.lag(value).over(w), "lx": F.lag(value).over(w), "one": F.lit(1.0), "at": (F.row_number().over(w) - 2 - lags).cast("double")})
    more = [f"z{i}" for i in range(1, lags + 1)]
    out = out.withColumns({z: F.lag("dx", i).over(w) for i, z in enumerate(more, 1)})
    columns = ["dx", "lx", *more, "one", *(["at"] if trend == "ct" else [])]
    k, head = len(columns), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.select(*keys).schema.fields)

    def run(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            found = []
            for r in rows.itertuples():
                g, t = square(r.g, k), None
                try:
                    b, ee = solve(g, [0], list(range(1, k)))
                    s2 = float(ee[0, 0]) / (r.n - (k - 1))
                    t = float(b[0, 0]) / math.sqrt(s2 * np.linalg.inv(g[1:, 1:])[0, 0])
                except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
                    pass  # too few rows or constant values: no statistic
                found.append({**{c: getattr(r, c) for c in keys}, "n": r.n, "t": t})
            yield pd.DataFrame(found, columns=[*keys, "n", "t"])

    stats = moments.gram_rows(out, columns, keys).mapInPandas(run, ", ".join(filter(None, [head, "n bigint, t double"])))
    return stats.withColumns({f"rejects{p}": F.col("t") < c for p, c in zip(ADF_AT, ADF[trend], strict=True)})


def schwert(n: int) -> int:
    """The largest lag that is tried for a series of n values."""
    return max(min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2), 0)


def _adf_choice(gram: Callable[[int], tuple[np.ndarray, int]], top: int) -> dict:
    """Lag, rows, t and p of one series; gram(k): the Gram of difference, level, one and lags 1
    to `top`, and the number, of the rows that have k lags. No statistic where rows are too few
    or the values don't vary."""
    none = {"lag": None, "n": None, "t": None, "p": None}
    common, n = gram(top)
    best, chosen = np.inf, None
    for k in range(top + 1):
        x = [1, 2, *range(3, 3 + k)]
        if n <= len(x):
            break
        try:
            _, ee = solve(common, [0], x)
        except np.linalg.LinAlgError:
            continue
        if ee[0, 0] <= 1e-14 * max(common[0, 0], 1e-300):
            continue
        aic = n * (math.log(2 * math.pi * float(ee[0, 0]) / n) + 1) + 2 * len(x)
        if aic < best - 1e-12:
            best, chosen = aic, k
    if chosen is None:
        return none
    g, m = gram(chosen)
    x = [1, 2, *range(3, 3 + chosen)]
    try:
        b, ee = solve(g, [0], x)
        variance = float(ee[0, 0]) / (m - len(x)) * np.linalg.inv(g[np.ix_(x, x)])[0, 0]
    except np.linalg.LinAlgError:
        return none
    if not variance > 0:
        return none
    t = float(b[0, 0]) / math.sqrt(variance)
    poly = TAU_SMALL if t <= TAU_STAR else TAU_LARGE
    p = 1.0 if t > TAU_MAX else 0.0 if t < TAU_MIN else normal_cdf_exact(sum(c * t**i for i, c in enumerate(poly)))
    return {"lag": chosen, "n": m, "t": t, "p": p}


def _series_grams(x: np.ndarray, top: int) -> Callable[[int], tuple[np.ndarray, int]]:
    """`gram` of `_adf_choice` from a series' values in order."""
    dx = np.diff(x)
    w = np.zeros((len(dx), 3 + top))
    w[:, 0], w[:, 1], w[:, 2] = dx, x[:-1], 1.0
    for k in range(1, top + 1):
        w[k:, 2 + k] = dx[:-k]
    return lambda k: (w[k:].T @ w[k:], len(w) - k)


ADF_AIC = "lag int, n bigint, t double, p double"


def adf_aic(series: DataFrame, keys: list[str], value: str = "value", date: str = "d", max_lag: int | None = None, long: int = tables.LONG) -> DataFrame:
    """(keys, lag, n, t, p): lag by AIC on one common sample, then the t statistic on the longest sample.

    The largest lag is a series' own (`schwert` of its length, and max_lag at most), so no
    series' answer depends on others. Null and NaN values are left out, and so are series without
    any other; a series that is too short or doesn't vary has a row without a statistic. Series of up to `long` values are one
    task each, with Grams as wide as their own lags; of longer ones one pass sums, for every
    number of lags, the Gram of the rows that have it, and only those sums meet in a task.
    """
    clean = series.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, date, F.col(value).cast("double").alias("__x"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.select(*keys).schema.fields)
    fields, limit = [*keys, "lag", "n", "t", "p"], np.inf if max_lag is None else max_lag

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(date)["__x"].to_numpy(float)
        top = int(min(schwert(len(x)), limit))
        found = _adf_choice(_series_grams(x, top), top)
        return pd.DataFrame([{**{c: rows[c].iloc[0] for c in keys}, **found}], columns=fields, dtype=object)

    short, others = tables.by_length(clean, keys, long)
    out = short.groupBy(*keys).applyInPandas(run, f"{names}, {ADF_AIC}")
    return out if others is None else out.unionByName(_adf_long(others, keys, date, limit, names, fields))


def _adf_long(rows: DataFrame, keys: list[str], date: str, limit: float, names: str, fields: list[str]) -> DataFrame:
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    most = int(min(schwert(counts.agg(F.max("__n")).first()[0]), limit))
    own = F.least(F.greatest(F.least(F.ceil(12 * F.pow(F.col("__n") / 100, F.lit(0.25))), F.floor(F.col("__n") / 2) - 2), F.lit(0)), F.lit(most)).cast("int")
    w = Window.partitionBy(*keys).orderBy(date)
    moved = rows.withColumns({"dx": F.col("__x") - F.lag("__x").over(w), "lx": F.lag("__x").over(w), "__t": F.row_number().over(w)})
    lags = [f"z{i}" for i in range(1, most + 1)]
    moved = tables.joined(moved.withColumns({z: F.lag("dx", i).over(w) for i, z in enumerate(lags, 1)}), counts.select(*keys, own.alias("__top")), keys)
    columns, k = ["dx", "lx", "one", *lags], 3 + most
    filled = moved.where("__t >= 2").withColumns({"one": F.lit(1.0), **{z: F.coalesce(z, F.lit(0.0)) for z in lags}})
    # Rows by how many lags they have, their series' largest at most: sums over `have` give every sample's Gram.
    grams = moments.gram_rows(filled.withColumn("have", F.least(F.col("__t") - 2, F.col("__top"))), columns, [*keys, "have"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        by = {int(h): (square(g, k), int(n)) for h, g, n in zip(part["have"], part["g"], part["n"], strict=True)}

        def gram(lag: int) -> tuple[np.ndarray, int]:
            parts = [v for h, v in by.items() if h >= lag]
            return sum(v[0] for v in parts), sum(v[1] for v in parts)

        found = _adf_choice(gram, max(by))
        return pd.DataFrame([{**{c: part[c].iloc[0] for c in keys}, **found}], columns=fields, dtype=object)

    return grams.groupBy(*keys).applyInPandas(run, f"{names}, {ADF_AIC}")


def vecm_gram(df: DataFrame, columns: list[str], k_max: int, system: list[str], date: str = "d", first: int | None = None, seasonal: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Superset Gram of a VECM: differences, lagged levels, lagged differences, constant, seasonals."""
    design = panel.numbered(panel.lag_design(df, columns, k_max, system, date), system, date).withColumn("one", F.lit(1.0))
    names = [f"y_{c}" for c in columns] + [f"x_{c}" for c in columns] + [f"z{i}_{c}" for i in range(1, k_max) for c in columns] + ["one", *(seasonal or [])]
    if first is not None:
        design = design.where(F.col("t") > first)
    return moments.gram_rows(design, names, system), names


def loglik(ee: np.ndarray, n: int) -> float:
    p = len(ee)
    return -n / 2 * (p * (1 + math.log(2 * math.pi)) + np.linalg.slogdet(ee / n)[1])


def vecm_ols(df: DataFrame, columns: list[str], k_max: int, system: list[str], date: str = "d", fixed: list[str] | None = None, first: int | None = None) -> DataFrame:
    """(system, k, loglik, aic, bic, hq) for lag lengths 1 to k_max on one common sample:
    rows after number `first` (the fewest that all lags need by default)."""
    fixed = fixed or []
    grams, names = vecm_gram(df, columns, k_max, system, date, first=k_max if first is None else first, seasonal=fixed)
    p, size = len(columns), len(names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*system).schema.fields)

    def run(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            out = []
            for r in rows.itertuples():
                g = square(r.g, size)
                for k in range(1, k_max + 1):
                    x = [*range(p, 2 * p + (k - 1) * p), *range(2 * p + (k_max - 1) * p, size)]
                    _, ee = solve(g, list(range(p)), x)
                    ll, m = loglik(ee, r.n), p * len(x) + p * (p + 1) // 2  # the covariance counts
                    out.append({**{c: getattr(r, c) for c in system}, "k": k, "n": r.n, "loglik": ll, "aic": 2 * m - 2 * ll, "bic": m * math.log(r.n) - 2 * ll, "hq": 2 * m * math.log(math.log(r.n)) - 2 * ll})
            yield pd.DataFrame(out, columns=[*system, "k", "n", "loglik", "aic", "bic", "hq"])

    return grams.mapInPandas(run, ", ".join(filter(None, [kinds, "k int, n bigint, loglik double, aic double, bic double, hq double"])))


def lag_table(fits: DataFrame, system: list[str]) -> DataFrame:
    """The lag length that each criterion prefers."""
    return fits.groupBy(*system).agg(*(F.min_by("k", c).alias(f"k_{c}") for c in ("aic", "bic", "hq")))


def seasonal_table(df: DataFrame, columns: list[str], k: int, system: list[str], kinds: list[str], date: str = "d", first: int | None = None, season_lag: int = 1) -> DataFrame:
    """(system, seasonal, loglik, m) of a k-lag VECM with each block, from one superset Gram.

    Seasonal terms are those of the date season_lag rows before, as in the lag table.
    """
    blocks = {kind: panel.seasonal_columns(kind) for kind in kinds}
    every = list(dict.fromkeys(c for cs in blocks.values() for c in cs))
    full = df.withColumn("__season", F.lag(date, season_lag).over(panel.ordered(system, date)) if season_lag else F.col(date))
    for kind in ("quarter", "month"):
        if kind in kinds:
            full = panel.dummies(full, kind, "__season")
    waves = max((int(kind[7:]) for kind in kinds if kind.startswith("fourier")), default=0)
    if waves:
        full = panel.fourier(full, waves, "__season")
    grams, names = vecm_gram(full, columns, k, system, date, first=first if first is not None else k, seasonal=every)
    p, size, base = len(columns), len(names), len(names) - len(every) - 1
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*system).schema.fields)

    def run(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            out = []
            for r in rows.itertuples():
                g = square(r.g, size)
                for kind, cs in blocks.items():
                    x = [*range(p, base + 1), *(base + 1 + every.index(c) for c in cs)]
                    _, ee = solve(g, list(range(p)), x)
                    out.append({**{c: getattr(r, c) for c in system}, "seasonal": kind, "loglik": loglik(ee, r.n), "m": p * len(x) + p * (p + 1) // 2, "n": r.n})
            yield pd.DataFrame(out, columns=[*system, "seasonal", "loglik", "m", "n"])

    return grams.mapInPandas(run, ", ".join(filter(None, [head, "seasonal string, loglik double, m int, n bigint"])))


def seasonal_lr(table: DataFrame, system: list[str], large: str, small: str, p: int) -> DataFrame:
    """LR of one seasonal block against another in a table of them, with its degrees and p-value."""
    pick = lambda kind, c: F.max(F.when(F.col("seasonal") == kind, F.col(c)))
    out = table.groupBy(*system).agg((2 * (pick(large, "loglik") - pick(small, "loglik"))).alias("lr"), (pick(large, "m") - pick(small, "m")).alias("df"))
    # The degrees are the block's columns times p, so few values occur.
    degrees = p * len(panel.seasonal_columns(large)) - p * len(panel.seasonal_columns(small))
    return out.withColumn("p", chi2_sf(F.greatest("lr", F.lit(0.0)), degrees))


def residuals(df: DataFrame, columns: list[str], k: int, system: list[str], date: str = "d", fixed: list[str] | None = None) -> DataFrame:
    """df's rows with e_<column>: residuals of the k-lag VECM, coefficients joined by system."""
    fixed = ["one", *(fixed or [])]
    grams, names = vecm_gram(df, columns, k, system, date, first=k, seasonal=fixed[1:])
    p, size = len(columns), len(names)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*system).schema.fields)

    def run(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            yield pd.DataFrame([{**{c: getattr(r, c) for c in system}, "b": solve(square(r.g, size), list(range(p)), list(range(p, size)))[0].T.tolist()} for r in rows.itertuples()], columns=[*system, "b"])

    coefs = grams.mapInPandas(run, ", ".join(filter(None, [head, "b array<array<double>>"])))
    design = panel.numbered(panel.lag_design(df, columns, k, system, date), system, date).withColumn("one", F.lit(1.0)).where(F.col("t") > k)
    rows = tables.joined(design, coefs, system)
    fit = lambda i: sum((F.col("b")[i][j] * F.col(c) for j, c in enumerate(names[p:])), F.lit(0.0))
    return rows.withColumns({f"e_{c}": F.col(f"y_{c}") - fit(i) for i, c in enumerate(columns)}).drop("b")


def hosking(rows: DataFrame, columns: list[str], lags: int, k: int, system: list[str], date: str = "d") -> DataFrame:
    """Multivariate portmanteau Q of residual columns, with its p-value."""
    p = len(columns)
    w = Window.partitionBy(*system).orderBy(date)
    lagged = rows.withColumns({f"__{s}_{c}": F.lag(c, s).over(w) for s in range(1, lags + 1) for c in columns})
    sums = [F.array(*(F.sum(F.col(a) * F.col(b if s == 0 else f"__{s}_{b}")) for a in columns for b in columns)).alias(f"c{s}") for s in range(lags + 1)]
    tables = lagged.groupBy(*system).agg(F.count("*").alias("n"), *sums)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*system).schema.fields)

    def run(batches):  # noqa: ANN001, ANN202
        for part in batches:
            out = []
            for r in part.itertuples():
                c = [np.array(getattr(r, f"c{s}"), float).reshape(p, p) / r.n for s in range(lags + 1)]
                inv = np.linalg.inv(c[0])
                q = r.n**2 * sum(np.trace(c[s].T @ inv @ c[s] @ inv) / (r.n - s) for s in range(1, lags + 1))
                df = p * p * (lags - (k - 1))
                out.append({**{x: getattr(r, x) for x in system}, "q": q, "df": df, "p": chi2_sf_exact(q, df)})
            yield pd.DataFrame(out, columns=[*system, "q", "df", "p"])

    return tables.mapInPandas(run, ", ".join(filter(None, [head, "q double, df int, p double"])))


def ljung_box(long: DataFrame, keys: list[str], lags: int, value: str = "value", date: str = "d") -> DataFrame:
    """Portmanteau of one series, about its mean, in built-in aggregates."""
    w = Window.partitionBy(*keys).orderBy(date)
    centred = tables.with_mean(long, keys, value, "__mean").withColumn("__e", F.col(value) - F.col("__mean"))
    lagged = centred.withColumns({f"__l{s}": F.lag("__e", s).over(w) for s in range(1, lags + 1)})
    n = F.count("*")
    q = sum((F.pow(F.sum(F.col("__e") * F.col(f"__l{s}")) / F.sum(F.col("__e") * F.col("__e")), F.lit(2)) / (n - s) for s in range(1, lags + 1)), F.lit(0.0))
    return lagged.groupBy(*keys).agg(n.alias("n"), (n * (n + 2) * q).alias("q"))


def arch_lm(long: DataFrame, keys: list[str], value: str = "value", date: str = "d") -> DataFrame:
    """n R2 of squares on their first lag."""
    w = Window.partitionBy(*keys).orderBy(date)
    sq = long.withColumn("__s", F.col(value) * F.col(value))
    sq = sq.withColumn("__l", F.lag("__s").over(w)).where(F.col("__l").isNotNull())
    return sq.groupBy(*keys).agg(F.count("*").alias("n"), (F.count("*") * F.regr_r2("__s", "__l")).alias("lm"))


def arch_lm_q(long: DataFrame, keys: list[str], q: int, value: str = "value", date: str = "d") -> DataFrame:
    """n R2 of squares on q lags, by a Gram table."""
    w = Window.partitionBy(*keys).orderBy(date)
    sq = long.withColumn("__s", F.col(value) * F.col(value)).withColumn("__one", F.lit(1.0))
    names = [f"__l{i}" for i in range(1, q + 1)]
    grams = moments.gram_rows(sq.withColumns({c: F.lag("__s", i).over(w) for i, c in enumerate(names, 1)}), ["__s", "__one", *names], keys)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.select(*keys).schema.fields)

    def run(batches):  # noqa: ANN001, ANN202
        for part in batches:
            out = []
            for r in part.itertuples():
                g = square(r.g, q + 2)
                _, ee = solve(g, [0], list(range(1, q + 2)))
                tss = g[0, 0] - g[0, 1] ** 2 / r.n
                lm = r.n * (1 - float(ee[0, 0]) / tss)
                out.append({**{x: getattr(r, x) for x in keys}, "lm": lm, "p": chi2_sf_exact(lm, q)})
            yield pd.DataFrame(out, columns=[*keys, "lm", "p"])

    return grams.mapInPandas(run, ", ".join(filter(None, [head, "lm double, p double"])))
