"""Exact quantiles of long groups, without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables

ACCURACY = 10_000


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], place: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, one column for each name): quantiles with linear interpolation, nulls left out.

    place gives the wanted position among n sorted values, from 0, where it isn't (n - 1) p;
    it must be within a row of that. A sketch gives bounds around each quantile that hold its ranks for sure; one more pass
    counts the values below the bounds and the equal ones between them, and only those
    counts (a few of ACCURACY parts of the rows) are ordered.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    eps = 2 / ACCURACY
    marks = [min(max(p + e, 0.0), 1.0) for p in probs.values() for e in (-eps, eps)]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", marks, ACCURACY).alias("__m"))
    cells = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), F.col("__m")[2 * k].alias("lo"), F.col("__m")[2 * k + 1].alias("hi")) for k, (name, p) in enumerate(probs.items())))
    bounds = sketch.select(*keys, "__n", F.explode(cells).alias("__c")).select(*keys, "__n", "__c.*")
    # Short groups need no bounds: all of their values are counted.
    few = F.col("__n") <= ACCURACY
    bounds = bounds.withColumns({"lo": F.when(few, float("-inf")).otherwise(F.col("lo")), "hi": F.when(few, float("inf")).otherwise(F.col("hi"))})
    met = tables.joined(rows, bounds, keys).where("__v <= hi")
    spot = F.when(F.col("__v") >= F.col("lo"), F.col("__v"))  # null: below the bounds
    counts = met.groupBy(*keys, "name", spot.alias("__v")).agg(F.count("*").alias("c"), F.first("__n").alias("__n"), F.first("p").alias("p"))
    w = Window.partitionBy(*keys, "name").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto, at = F.sum("c").over(w), place(F.col("__n")) if place else (F.col("__n") - 1) * F.col("p")
    ranked = counts.withColumns({"__upto": upto, "__at": at}).where("__v is not null")
    low = F.min(F.when(F.col("__upto") > F.floor("__at"), F.col("__v")))
    high = F.min(F.when(F.col("__upto") > F.ceil("__at"), F.col("__v")))
    found = ranked.groupBy(*keys, "name").agg(low.alias("low"), high.alias("high"), F.first("__at").alias("__at"))
    found = found.withColumn("__q", F.col("low") + (F.col("__at") - F.floor("__at")) * (F.col("high") - F.col("low")))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("__q"))).alias(name) for name in probs))


def with_quantiles(table: DataFrame, df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """A summary table of df by keys, with quantiles of one column added."""
    return tables.joined(table, quantiles(df, keys, value, probs), keys, "left")
