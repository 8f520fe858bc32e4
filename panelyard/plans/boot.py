"""Bootstrap p-values of a panel's own statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import moments, rank, replication, resample
from ..sources import results, tables
from . import fits


def rank_pvalues(levels: DataFrame, columns: list[str], system: list[str], b: int, seed: int, date: str = "d", chunk: int = 250) -> DataFrame:
    """P-values of the observed trace statistic for every rank r0 from 0 to p - 1, in one job."""
    levels, draws = tables.written(levels, "panel"), None
    for r0 in range(len(columns)):
        one = resample.bootstrap_rank(levels, columns, system, r0, b, seed, date, chunk).withColumn("r0", F.lit(r0))
        draws = one if draws is None else draws.unionByName(one)
    rows, names, s = fits.design(levels, columns, system, date)
    observed = rank.trace_test(moments.gram_rows(rows, names, system), system, s).select(*system, F.col("r").alias("r0"), F.col("trace").alias("observed"))
    keys = [*system, "r0"]
    draws = tables.written(draws, "draws")  # the summary reads them several times
    found = replication.bootstrap_pvalue(tables.joined(draws, observed, keys), keys, "observed")
    return tables.joined(found, observed, keys)


def lr_pvalues(levels: DataFrame, columns: list[str], system: list[str], breaks: list[int], b: int, seed: int, date: str = "d", chunk: int = 250) -> DataFrame:
    """P-values of each system's LR of b = 1 under the iid and the regime model."""
    levels, out = tables.written(levels, "panel"), None
    for spec, cuts in (("iid", []), ("regime", breaks)):
        fitted = fits.regime(levels, columns, system, cuts, date) if cuts else fits.iid(levels, columns, system, date)
        observed = fitted.select(*system, F.col("lr").alias("observed"))
        draws = tables.written(resample.bootstrap_lr(levels, columns, system, cuts, b, seed, date, chunk), "draws")
        each = tables.joined(draws, observed, system)
        one = replication.bootstrap_pvalue(each, [*system, "observed"], "observed").withColumn("spec", F.lit(spec))
        out = one if out is None else out.unionByName(one)
    return out


def resumed_lr(levels: DataFrame, columns: list[str], system: list[str], breaks: list[int], b: int, seed: int, path: str, date: str = "d", chunk: int = 250) -> DataFrame:
    """The draws of bootstrap_lr, kept as a table: only blocks with missing replicates are drawn
    and appended, so a stopped job goes on and a larger b adds to a smaller one."""
    plan = levels.select(*system).distinct().withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(b))))

    def job(missing: DataFrame) -> DataFrame:
        only = missing.select(*system, F.floor((F.col("j") - 1) / chunk).cast("int").alias("block")).distinct()
        draws = resample.bootstrap_lr(levels, columns, system, breaks, b, seed, date, chunk, only)
        return tables.joined(draws, missing, [*system, "j"], "left_semi")

    return results.resume_append(plan, path, [*system, "j"], job, [])
