"""Cross-product (Gram) tables: the one pass over rows that all fits share.

A Gram table is long: keys, i, j (i <= j, numbers of columns), value. All sums of one table
come from one aggregation with partial sums on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables
from . import covariance
from .quantiles import quantiles


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def gram(df: DataFrame, columns: list[str], keys: list[str], weight: Column | None = None) -> DataFrame:
    """Sums of w * column_i * column_j for every i <= j, with the rows' number n.

    Rows with a null in any column are left out.
    """
    w = F.lit(1.0) if weight is None else weight
    clean = df.na.drop(subset=columns)
    sums = [F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in _pairs(len(columns))]
    wide = clean.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{i}_{j}").alias("value")) for i, j in _pairs(len(columns))))
    return wide.select(*keys, "n", F.explode(cells).alias("c")).select(*keys, "n", "c.i", "c.j", "c.value")


def gram_rows(df: DataFrame, columns: list[str], keys: list[str], weight: Column | None = None) -> DataFrame:
    """As gram, with one row a key and the sums as an array, for grouped algebra."""
    w = F.lit(1.0) if weight is None else weight
    sums = F.array(*(F.sum(w * F.col(columns[i]) * F.col(columns[j])) for i, j in _pairs(len(columns))))
    return df.na.drop(subset=columns).groupBy(*keys).agg(F.count("*").alias("n"), sums.alias("g"))


def kernel_sums(df: DataFrame, columns: list[str], keys: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(keys, sums): the sum over rows of a kernel's vector, for more sums than one aggregation takes.

    The kernel sees a batch's rows of one key at once; batches' vectors are added up by Spark.
    """
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for _, part in batch.groupby(keys, dropna=False, sort=False):
                found = kernel(part[columns].to_numpy(float))
                yield pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "vector": [found.tolist()]})[[*keys, "vector"]].astype({k: object for k in keys})

    each = df.select(*keys, *columns).mapInPandas(run, f"{head}, vector array<double>")
    summed = each.select(*keys, F.posexplode("vector").alias("pos", "value")).groupBy(*keys, "pos").agg(F.sum("value").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))  # as many as the kernel has sums
    return summed.groupBy(*keys).agg(F.transform(ordered, lambda x: x["value"]).alias("sums"))


def driver_power_gram(df: DataFrame, columns: list[str], driver: str, keys: list[str], powers: int = 2) -> DataFrame:
    """Grams weighted by the driver's powers 0 to `powers`, as rows with a column power."""
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(powers))).alias("power"))
    return gram(each, columns, [*keys, "power"], F.pow(F.col(driver), F.col("power")))


def prefix_gram(df: DataFrame, a: str, b: str, system: list[str], at: list[int] | DataFrame, block: int = 1000) -> DataFrame:
    """Sums of a * b over rows 1 to k, for each k in `at` (rows numbered by t): a list, or a
    table (system, k) of each system's own.

    Blocks of rows are summed first; only blocks and the rows of cut blocks are ordered.
    """
    rows = df.select(*system, "t", (F.col(a) * F.col(b)).alias("p"), F.floor((F.col("t") - 1) / block).alias("__b"))
    blocks = rows.groupBy(*system, "__b").agg(F.sum("p").alias("s"))
    w = Window.partitionBy(*system).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(*system, "__b", F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias("before"))
    own = isinstance(at, DataFrame)
    edges = (at if own else df.sparkSession.createDataFrame([(k,) for k in at], "k int")).withColumn("__b", F.floor((F.col("k") - 1) / block))
    part = (rows.join(edges, [*system, "__b"]) if own else rows.join(F.broadcast(edges), "__b")).where("t <= k").groupBy(*system, "__b", "k").agg(F.sum("p").alias("part"))
    return part.join(before, [*system, "__b"]).select(*system, "k", (F.col("before") + F.col("part")).alias("value"))


def prefix_gram_rows(pieces: DataFrame, keys: list[str], piece: str = "piece", block: int = 256) -> DataFrame:
    """(keys, piece, n, g, n_before, before, n_total, total): whole Grams of pieces (n, g) with those of
    all pieces up to and with each one, and of all.

    Pieces are summed in blocks, a system's blocks are cumulated, and each block cumulates its
    own pieces from there; no task holds more than a block of pieces or a system's blocks.
    """
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*keys).schema.fields)
    own = ", ".join(filter(None, [head, "__b bigint, n bigint, g array<double>"]))
    stack = lambda part: np.array(part["g"].tolist(), float)

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        return pd.DataFrame([{**{k: first[k] for k in [*keys, "__b"]}, "n": int(part["n"].sum()), "g": stack(part).sum(0).tolist()}], columns=[*keys, "__b", "n", "g"], dtype=object)

    def cumulated(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__b")
        ends, counts = stack(part).cumsum(0), part["n"].to_numpy(np.int64).cumsum()
        out = part[[*keys, "__b"]].astype(object)
        out["n_start"], out["start"] = [0, *counts[:-1].tolist()], [np.zeros(ends.shape[1]).tolist(), *ends[:-1].tolist()]
        out["n_total"], out["total"] = int(counts[-1]), [ends[-1].tolist()] * len(part)
        return out

    def placed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(piece)
        ends = stack(part).cumsum(0) + np.array(part["start"].iloc[0], float)
        counts = part["n"].to_numpy(np.int64).cumsum() + int(part["n_start"].iloc[0])
        out = part[[*keys, piece, "n", "g", "n_total", "total"]].astype(object)
        out["n_before"], out["before"] = counts.tolist(), ends.tolist()
        return out[[*keys, piece, "n", "g", "n_before", "before", "n_total", "total"]]

    rows = pieces.withColumn("__b", F.floor(F.col(piece) / block))
    starts = rows.groupBy(*keys, "__b").applyInPandas(summed, own).groupBy(*keys).applyInPandas(cumulated, ", ".join(filter(None, [head, "__b bigint, n_start bigint, start array<double>, n_total bigint, total array<double>"])))
    kind = pieces.schema[piece].dataType.simpleString()
    met = tables.joined(rows, starts, [*keys, "__b"])
    return met.groupBy(*keys, "__b").applyInPandas(placed, ", ".join(filter(None, [head, f"{piece} {kind}, n bigint, g array<double>, n_before bigint, before array<double>, n_total bigint, total array<double>"])))


def lag_gram(df: DataFrame, columns: list[str], lag: int, system: list[str], date: str = "d") -> DataFrame:
    """Sums of column_i at t times column_j at t - lag, all i, j."""
    w = Window.partitionBy(*system).orderBy(date)
    lagged = df.withColumns({f"__l{j}": F.lag(c, lag).over(w) for j, c in enumerate(columns)})
    n = len(columns)
    sums = [F.sum(F.col(columns[i]) * F.col(f"__l{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(n)]
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{i}_{j}").alias("value")) for i in range(n) for j in range(n)))
    return lagged.groupBy(*system).agg(*sums).select(*system, F.explode(cells).alias("c")).select(*system, "c.i", "c.j", "c.value")


def residual_cov(df: DataFrame, residuals: list[str], keys: list[str]) -> DataFrame:
    """E'E / T in long form."""
    return gram(df, residuals, keys).withColumn("value", F.col("value") / F.col("n"))


def correlations(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Smallest off-diagonal correlation of the columns, and the condition number of their covariance."""
    k = len(columns)
    pairs = [F.corr(columns[i], columns[j]) for i, j in _pairs(k) if i < j]
    cells = F.array(*(F.covar_pop(columns[i], columns[j]) for i, j in _pairs(k)))
    table = df.groupBy(*keys).agg((F.least(*pairs) if len(pairs) > 1 else pairs[0]).alias("min_corr"), cells.alias("__cov"))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.drop("__cov").schema.fields)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out = []
            for cov in batch["__cov"]:
                m = np.zeros((k, k))
                m[np.triu_indices(k)] = [np.nan if x is None else x for x in cov]
                size = np.linalg.eigvalsh(m.T) if np.isfinite(m).all() else np.array([np.nan])
                out.append(float(size[-1] / size[0]) if size[0] > 0 else None)
            yield batch.drop(columns="__cov").assign(condition=pd.array(out, dtype="Float64"))

    return table.mapInPandas(run, f"{head}, condition double")


def regime_variances(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Rows, log determinant of the columns' covariance, and mean variance of each segment."""
    cells = {(i, j): F.covar_pop(columns[i], columns[j]).alias(f"__c{i}_{j}") for i, j in _pairs(len(columns))}
    table = df.groupBy(*keys).agg(F.count("*").alias("n"), *cells.values())
    at = lambda i, j: F.col(f"__c{min(i, j)}_{max(i, j)}")
    k = range(len(columns))
    total = sum((at(i, i) for i in k), F.lit(0.0))
    det = covariance.determinant([[at(i, j) for j in k] for i in k])
    return table.select(*keys, "n", F.ln(det).alias("logdet"), (total / len(columns)).alias("mean_variance"))


def weight_spread(df: DataFrame, weight: str, keys: list[str]) -> DataFrame:
    """Ratio of the 90th to the 10th percentile of a weight."""
    return quantiles(df, keys, weight, {"__hi": 0.9, "__lo": 0.1}).select(*keys, (F.col("__hi") / F.col("__lo")).alias("spread"))
