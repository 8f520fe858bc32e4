"""Panel shaping: alignment, lags, seasonals, drivers, segments. Rows are keyed by system
(a list of columns, may be empty for one system) and ordered by a date column.

Windows are always partitioned by the system, so systems are independent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..sources import tables
from .quantiles import with_quantiles


def ordered(system: list[str], date: str = "d") -> WindowSpec:
    return Window.partitionBy(*system).orderBy(date)


def align(long: DataFrame, series: list[str], system: list[str], date: str = "d", name: str = "series", value: str = "value") -> DataFrame:
    """Long rows to one row a date, dates on which all series are present."""
    wide = long.groupBy(*system, date).pivot(name, series).agg(F.first(value))
    return wide.na.drop(subset=series)


def outer_align(parts: list[DataFrame], on: list[str]) -> DataFrame:
    """Full-outer join of single-series tables."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, on, "outer")
    return out


def inner_align(parts: list[DataFrame], on: list[str]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, on)
    return out


def coverage(long: DataFrame, keys: list[str], date: str = "d", value: str = "value") -> DataFrame:
    return long.groupBy(*keys).agg(
        F.min(date).alias("first"), F.max(date).alias("last"), F.count(value).alias("n"), F.coalesce(F.bool_or(F.col(value) <= 0), F.lit(False)).alias("any_nonpositive")
    )


def logs(df: DataFrame, columns: list[str], prefix: str = "l_") -> DataFrame:
    return df.withColumns({prefix + c: F.ln(c) for c in columns})


def diffs(df: DataFrame, columns: list[str], system: list[str], date: str = "d", prefix: str = "d_") -> DataFrame:
    w = ordered(system, date)
    return df.withColumns({prefix + c: F.col(c) - F.lag(c).over(w) for c in columns})


def numbered(df: DataFrame, system: list[str], date: str = "d") -> DataFrame:
    """t: the row's number, from 1, in its system."""
    return df.withColumn("t", F.row_number().over(ordered(system, date)))


def lag_design(df: DataFrame, columns: list[str], k: int, system: list[str], date: str = "d") -> DataFrame:
    """y_ (differences), x_ (levels a row before) and z1_.. z{k-1}_ (lagged differences)."""
    w = ordered(system, date)
    out = df.withColumns({f"y_{c}": F.col(c) - F.lag(c).over(w) for c in columns} | {f"x_{c}": F.lag(c).over(w) for c in columns})
    return out.withColumns({f"z{i}_{c}": F.lag(f"y_{c}", i).over(w) for i in range(1, k) for c in columns})


def common_sample(df: DataFrame, first: int, system: list[str], date: str = "d") -> DataFrame:
    """Rows from number `first` on, the same for every lag length."""
    return numbered(df, system, date).where(F.col("t") >= first)


def fourier(df: DataFrame, harmonics: int, date: str = "d") -> DataFrame:
    angle = lambda j: F.lit(2 * math.pi * j) * F.month(date) / 12
    return df.withColumns({f"c{j}": F.cos(angle(j)) for j in range(1, harmonics + 1)} | {f"s{j}": F.sin(angle(j)) for j in range(1, harmonics + 1)})


def dummies(df: DataFrame, kind: str, date: str = "d") -> DataFrame:
    """none, quarter (2 to 4), month (2 to 12) or fourier1 to fourier3."""
    if kind == "none":
        return df
    if kind.startswith("fourier"):
        return fourier(df, int(kind[7:]), date)
    part, top = (F.quarter(date), 4) if kind == "quarter" else (F.month(date), 12)
    return df.withColumns({f"{kind[0]}{k}": (part == k).cast("double") for k in range(2, top + 1)})


def seasonal_columns(kind: str) -> list[str]:
    if kind == "none":
        return []
    if kind.startswith("fourier"):
        return [f"{a}{j}" for j in range(1, int(kind[7:]) + 1) for a in "cs"]
    return [f"{kind[0]}{k}" for k in range(2, {"quarter": 4, "month": 12}[kind] + 1)]


def deterministics(df: DataFrame, system: list[str], date: str = "d") -> DataFrame:
    return df.withColumns({"const": F.lit(1.0), "trend": (F.row_number().over(ordered(system, date)) - 1).cast("double")})


def spreads(df: DataFrame, columns: list[str], weights: list[float] | None = None, prefix: str = "spread_") -> DataFrame:
    """Each later column less b times the first."""
    b = weights or [1.0] * (len(columns) - 1)
    return df.withColumns({f"{prefix}{c}": F.col(c) - w * F.col(columns[0]) for c, w in zip(columns[1:], b, strict=True)})


def volatility_driver(df: DataFrame, columns: list[str], system: list[str], date: str = "d", kind: str = "level") -> DataFrame:
    """v: mean absolute change a row before, over its mean; kind log: its centred log."""
    w = ordered(system, date)
    mean = sum((F.abs(F.lag(c).over(w) - F.lag(c, 2).over(w)) for c in columns), F.lit(0.0)) / len(columns)
    out = tables.with_mean(df.withColumn("v", mean), system, "v", "__mean").withColumn("v", F.col("v") / F.col("__mean")).drop("__mean")
    if kind == "log":
        out = tables.with_mean(out.withColumn("v", F.ln("v")), system, "v", "__mean").withColumn("v", F.col("v") - F.col("__mean")).drop("__mean")
    return out


def cap_driver(df: DataFrame, observed: DataFrame, system: list[str], column: str = "v") -> DataFrame:
    """The driver cut at the largest observed value of its system."""
    top = observed.groupBy(*system).agg(F.max(column).alias("__top"))
    out = tables.joined(df, top, system)
    return out.withColumn(column, F.least(column, "__top")).drop("__top")


Breaks = list[int] | tuple[int, ...] | DataFrame


def segment(t: Column, breaks: list[int] | Column) -> Column:
    """Number of the segment, from 0; a break k ends a segment after row k. breaks: a list, or an array column."""
    if isinstance(breaks, Column):
        return F.aggregate(breaks, F.lit(0), lambda n, k: n + F.when(t > k, 1).otherwise(0))
    return sum((F.when(t > k, 1).otherwise(0) for k in breaks), F.lit(0))


def with_breaks(rows: DataFrame, system: list[str], breaks: Breaks, name: str = "__breaks") -> DataFrame:
    """rows with their system's breaks as an array: one list for all, or a table (system, breaks)
    of each one's own; a system that isn't in it has none."""
    none = F.array().cast("array<int>")
    if not isinstance(breaks, DataFrame):
        return rows.withColumn(name, F.array(*map(F.lit, breaks)).cast("array<int>") if len(breaks) else none)
    own = breaks.select(*system, F.col("breaks").cast("array<int>").alias(name))
    return tables.joined(rows, own, system, "left").withColumn(name, F.coalesce(name, none))


def with_segments(rows: DataFrame, system: list[str], breaks: Breaks, name: str = "segment", t: str = "t") -> DataFrame:
    """rows with the number of their segment under their system's breaks."""
    if not isinstance(breaks, DataFrame):
        return rows.withColumn(name, segment(F.col(t), list(breaks)))
    return with_breaks(rows, system, breaks).withColumn(name, segment(F.col(t), F.col("__breaks"))).drop("__breaks")


def segments_by_range(rows: DataFrame, edges: DataFrame, t: str = "t") -> DataFrame:
    """Rows joined to their segment (lo, hi] by a range condition; edges is a short table."""
    return rows.join(F.broadcast(edges), (F.col(t) > F.col("lo")) & (F.col(t) <= F.col("hi")))


def break_dates(rows: DataFrame, breaks: DataFrame, system: list[str], date: str = "d") -> DataFrame:
    """The date of row k + 1 of each break k, as yyyy-mm."""
    named = numbered(rows, system, date).select(*system, "t", date)
    return breaks.join(named, [*[breaks[c] == named[c] for c in system], named["t"] == breaks["k"] + 1]).select(*[breaks[c] for c in system], "k", F.date_format(date, "yyyy-MM").alias("break_date"))


def large_moves(df: DataFrame, columns: list[str], system: list[str], threshold: float, date: str = "d") -> DataFrame:
    """(system, date, series, move) of log changes beyond the threshold."""
    moved = diffs(df, columns, system, date, "")
    long = moved.unpivot([*system, date], columns, "series", "move")
    return long.where(F.abs("move") > threshold)


def period_vol(df: DataFrame, columns: list[str], cut: str, system: list[str], date: str = "d") -> DataFrame:
    """Sample deviation of changes, in full and before and from a date."""
    long = diffs(df, columns, system, date, "").unpivot([*system, date], columns, "series", "move")
    early = F.col(date) < F.lit(cut).cast("date")
    return long.groupBy(*system, "series").agg(
        F.stddev_samp("move").alias("sd_all"), F.stddev_samp(F.when(early, F.col("move"))).alias("sd_early"), F.stddev_samp(F.when(~early, F.col("move"))).alias("sd_late")
    )


def compare_series(df: DataFrame, a: str, b: str, system: list[str], date: str = "d") -> DataFrame:
    """How close two log series are: gaps, equal values, and their changes."""
    w = ordered(system, date)
    out = df.withColumns({"gap": F.col(a) - F.col(b), "ra": F.col(a) - F.lag(a).over(w), "rb": F.col(b) - F.lag(b).over(w)})
    table = out.groupBy(*system).agg(
        F.stddev_samp("gap").alias("sd_gap"),
        F.count_if(F.col("gap") == 0).alias("n_equal"),
        F.corr("ra", "rb").alias("corr"),
        (F.stddev_samp("ra") / F.stddev_samp("rb")).alias("sd_ratio"),
    )
    return with_quantiles(table, out.withColumn("__gap", F.abs(F.expm1("gap"))), system, "__gap", {"median_gap": 0.5})


def bases_table(df: DataFrame, columns: list[str], system: list[str], date: str = "d") -> DataFrame:
    """Levels and bases in long form, for plots."""
    out = spreads(df, columns, prefix="basis_")
    return out.unpivot([*system, date], [*columns, *(f"basis_{c}" for c in columns[1:])], "line", "value")
