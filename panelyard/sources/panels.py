"""Readers and writers of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def melt_months(wide: DataFrame, year: str, cells: list[str]) -> DataFrame:
    """One row a year with twelve cells to (date, value), blank and NA cells left out."""
    each = wide.select(year, F.posexplode(F.array(*(F.col(c).cast("string") for c in cells))).alias("m", "v"))
    value = F.expr("try_cast(v AS double)")
    return each.select(F.make_date(F.col(year).cast("int"), F.col("m") + 1, F.lit(1)).alias("d"), value.alias("value")).where("value is not null")


def read_year_month_matrix(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(series, d, value) from text files of a year and twelve cells a line; NA is missing."""
    out = None
    for series, path in paths.items():
        cells = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") >= 2)
        one = melt_months(cells.select(F.col("c")[0].alias("year"), *(F.get("c", F.lit(k)).alias(f"m{k}") for k in range(1, 13))), "year", [f"m{k}" for k in range(1, 13)])
        one = one.select(F.lit(series).alias("series"), "d", "value")
        out = one if out is None else out.unionByName(one)
    return out


def parse_date_values(lines: DataFrame, keys: list[str], line: str = "value", unit: str | None = "month") -> DataFrame:
    """(keys, d, value) from lines of a date and a number; others are left out.

    A monthly series may carry any day of its month, so dates are moved to the start of
    their unit (None: kept as they are).
    """
    part = F.split(F.trim(F.col(line)), r"\s+")
    d = F.get(part, F.lit(0)).try_cast("date")
    out = lines.select(*keys, (F.trunc(d, unit) if unit else d).alias("d"), F.get(part, F.lit(1)).try_cast("double").alias("value"), F.size(part).alias("__n"))
    return out.where("__n = 2 and d is not null and value is not null").drop("__n")


def read_date_value(spark: SparkSession, path: str, series: str, unit: str | None = "month") -> DataFrame:
    lines = spark.read.text(path).select(F.lit(series).alias("series"), "value")
    return parse_date_values(lines, ["series"], unit=unit)


def with_logs(panel: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return panel.withColumns({f"l_{c}": F.round(F.ln(c), digits) for c in columns})


def write_panel(panel: DataFrame, path: str, columns: list[str], fmt: str = "parquet", by: list[str] | None = None) -> None:
    with_logs(panel, columns).write.partitionBy(*(by or [])).format(fmt).option("header", True).save(path)


def load_panel(spark: SparkSession, path: str, columns: list[str], date: str = "d") -> DataFrame:
    """Only the named columns; the scan reads no others."""
    return spark.read.parquet(path).select(date, *columns)


def export_samples(df: DataFrame, system: list[str], columns: list[str], t: str = "t") -> DataFrame:
    """Long coordinates (system, t, column, value) for paired comparisons elsewhere."""
    return df.unpivot([*system, t], columns, "column", "value")
