"""A registry of covariance specifications, and every system's fits under each in one table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..operators import panel
from ..sources import tables
from . import driven, fits

HEAD = ["loglik_free", "loglik_one", "lr", "p", "b", "converged", "error"]


@dataclass(frozen=True)
class Spec:
    """driver: what the covariance moves with (level, log or None); needs: the sums it reads;
    fit(rows, columns, system, breaks, date, fixed) gives a table with loglik_free, loglik_one, lr and b."""

    driver: str | None
    needs: str
    fit: Callable[..., DataFrame]


SPECS: dict[str, Spec] = {}


def register(name: str, driver: str | None, needs: str) -> Callable:
    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SPECS[name] = Spec(driver, needs, f)
        return f

    return put


@register("iid", None, "one Gram a system")
def _iid(rows, columns, system, breaks, date, fixed):  # noqa: ANN001, ANN202
    return fits.iid(rows, columns, system, date, fixed)


@register("regime", None, "one Gram a segment")
def _regime(rows, columns, system, breaks, date, fixed):  # noqa: ANN001, ANN202
    return fits.regime(rows, columns, system, breaks, date, fixed)


def _scale(rows, columns, system, breaks, date, fixed):  # noqa: ANN001, ANN202
    return fits.scale(rows, columns, system, "v", date, fixed)


def _driven(model: str) -> Callable[..., DataFrame]:
    return lambda rows, columns, system, breaks, date, fixed: driven.fit(rows, columns, system, "v", model, date, fixed)


TENSOR = "weighted Grams for each pair of residuals, and the objective's derivatives"
register("quadratic", "level", TENSOR)(_driven("quadratic"))
register("quadratic-factor", "level", TENSOR)(_driven("quadratic-factor"))
register("scale-log", "log", "one weighted Gram for each b tried")(_scale)
register("log-precision-log", "log", TENSOR)(_driven("log-precision"))
register("scale", "level", "one weighted Gram for each b tried")(_scale)
register("log-precision", "level", TENSOR)(_driven("log-precision"))


@register("ar1", None, "Grams of rows with themselves and with the row before")
def _ar1(rows, columns, system, breaks, date, fixed):  # noqa: ANN001, ANN202
    return fits.ar1(rows, columns, system, date, fixed)


#: The eight that are compared with each other.
EIGHT = ["iid", "regime", "quadratic", "quadratic-factor", "scale-log", "log-precision-log", "scale", "log-precision"]


def spec_fits(df: DataFrame, columns: list[str], system: list[str], breaks: list[int], date: str = "d", fixed: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """(system, spec, loglik_free, loglik_one, lr, p, b, converged, error) of registered specifications.

    All of them use the same rows, as a driver's first value comes with the second lag. p is
    of the chi-square with as many degrees as relations. converged is null where a fit has
    no such column. A fit that fails is a row with its error. What df comes from is read once.
    """
    return _spec_fits(tables.written(df, "panel"), columns, system, breaks, date, fixed, names)


def _spec_fits(df: DataFrame, columns: list[str], system: list[str], breaks: list[int], date: str, fixed: list[str] | None, names: list[str] | None) -> DataFrame:
    """spec_fits of rows that are cheap to read many times."""
    drivers = {k: panel.volatility_driver(df, columns, system, date, k) for k in ("level", "log")}
    out = None
    for name in names or EIGHT:
        spec = SPECS[name]
        one = spec.fit(drivers[spec.driver] if spec.driver else df, columns, system, breaks, date, fixed)
        if "converged_free" in one.columns:
            one = one.withColumn("converged", F.col("converged_free") & F.col("converged_one"))
        for c, t in (("converged", "boolean"), ("error", "string")):
            if c not in one.columns:
                one = one.withColumn(c, F.lit(None).cast(t))
        one = one.withColumns({"spec": F.lit(name), "p": dist.chi2_sf(F.greatest("lr", F.lit(0.0)), len(columns) - 1)}).select(*system, "spec", *HEAD)
        out = one if out is None else out.unionByName(one)
    return out


def with_recorded(found: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Adds diff_free and diff_one to recorded (keys, loglik_free, loglik_one); null where nothing is recorded."""
    old = recorded.select(*keys, *(F.col(f"loglik_{k}").alias(f"recorded_{k}") for k in ("free", "one")))
    each = tables.joined(found, old, keys, "left")
    return each.withColumns({f"diff_{k}": F.col(f"loglik_{k}") - F.col(f"recorded_{k}") for k in ("free", "one")})


def seasonal_grid(df: DataFrame, columns: list[str], system: list[str], breaks: list[int], kinds: list[str], names: list[str] | None = None, date: str = "d") -> DataFrame:
    """spec_fits with each seasonal block."""
    df, out = tables.written(df, "panel"), None
    for kind in kinds:
        one = _spec_fits(panel.dummies(df, kind, date), columns, system, breaks, date, panel.seasonal_columns(kind), names)
        one = one.withColumn("seasonal", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def seasonal_summary(grid: DataFrame, system: list[str]) -> DataFrame:
    """(system, spec, n, spread, n_rejects, gap): the p-values' range over the blocks, how many
    are under 0.05, and the smallest distance to another specification's in the same block."""
    grid = tables.written(grid.select(*system, "spec", "seasonal", "p"), "grid")  # it is read three times
    other = grid.select(*system, "seasonal", F.col("spec").alias("other"), F.col("p").alias("q"))
    gaps = tables.joined(grid, other, [*system, "seasonal"]).where("spec <> other").groupBy(*system, "spec").agg(F.min(F.abs(F.col("p") - F.col("q"))).alias("gap"))
    own = grid.groupBy(*system, "spec").agg(F.count("p").alias("n"), (F.max("p") - F.min("p")).alias("spread"), F.count_if(F.col("p") < 0.05).alias("n_rejects"))
    return tables.joined(own, gaps, [*system, "spec"], "left")
